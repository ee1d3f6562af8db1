"""Tags of all texts of a chunk at once equal the best path of each text by itself, and no run is walked word by word."""

from __future__ import annotations

import numpy as np

from orthoflow.llm import secrets as S


def best_path(scores, steps):
    best, back = scores[0].astype(np.float64), []
    for row in scores[1:]:
        paths = best[:, None] + steps
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    tags = [int(best.argmax())]
    for pointers in reversed(back):
        tags.append(int(pointers[tags[-1]]))
    return tags[::-1]


def test_texts_side_by_side_equal_each_text_alone():
    draw = np.random.default_rng(4)
    steps = draw.normal(0, 1.5, (3, 3))
    field = S.Field(np.zeros((1, 3), np.float32), steps)
    lengths = [0, 1, 7, 0, 40, 3, 1, 200, 0]
    first = np.concatenate(([0], np.cumsum(lengths)))
    for lead in (0.0, 4.0, 30.0):  # all words in doubt, runs of some, none
        scores = draw.normal(0, 3, (first[-1], 3)).astype(np.float32)
        scores[:, S.OUT] += lead
        wanted = [tag for a, b in zip(first[:-1], first[1:]) if a < b for tag in best_path(scores[a:b], steps)]
        assert field.tags_of_texts(scores, first).tolist() == wanted


def test_runs_of_a_chunk_take_as_many_steps_as_the_longest(monkeypatch):
    field = S.Field(np.zeros((1, 3), np.float32), np.zeros((3, 3)))
    calls = []
    monkeypatch.setattr(S.Field, "paths", lambda self, *args, walk=S.Field.paths: calls.append(len(args[1])) or walk(self, *args))
    scores = np.tile(np.array([[0, 1, 0], [99, 0, 0]], np.float32), (500, 1))
    tags = field.tags_of_texts(scores, np.arange(0, 1001, 100))
    assert calls == [500] and tags.tolist() == [S.BEGIN, S.OUT] * 500
