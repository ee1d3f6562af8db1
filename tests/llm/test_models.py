"""Secret scan, quality classifier and language model: brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from orthoflow.llm import quality, recurrent_lm, secrets
from orthoflow.llm.common import hash_of, text_chunks, word_hashes, word_spans

HEX = "0123456789abcdef"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "x") for i, t in rows], "doc_id long, text string, lang string, score double, spans string")


def test_words_and_hashes_follow_the_contract():
    texts = ["A b\tC", None, "", "x\x1cy z \x0b", "no space", "\r\n"]
    array = pa.array(texts)
    got = []
    for _, offsets, data in text_chunks(array, limit=4):
        starts, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for k in range(len(offsets) - 1):
            got.append(hashes[first[k]:first[k + 1]].tolist())
    want = [[hash_of(w.lower()) for w in (t or "").encode().split()] for t in texts]
    assert got == want and got[0][0] == hash_of(b"a") and len(got[3]) == 1


def brute_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(found)]


def secret_rows(seed=2, n=150):
    random.seed(seed)
    words = ["the", "quick", "ärger", "of", "and", "2024", "x1", "mail7@example.com", "É", "word", "(706)"]
    rows = []
    for i in range(n):
        own = random.choices(words, k=random.randint(0, 60))
        for _ in range(random.choice([0, 0, 1, 2])):
            value = "".join(random.choices(HEX, k=random.choice([5, 23, 24, 40])))
            own.insert(random.randint(0, len(own)), random.choice([
                f'token = "{value}"', f"API_KEY:{value}", f"Passwd='{value}'", value, "AKIA" + "A1B2C3D4" * random.choice([1, 2]), "secret: short"]))
        rows.append((i, random.choice([" ", "\n"]).join(own)))
    return rows + [(500, None), (501, ""), (None, "token=abcdefg"), (502, "token=abcdef token=abcdef"), (503, "toKen=abcdefg toKen=abcdefg"),
                   (504, "a" * 70_000 + " tail")]


def test_base_spans_stay_and_added_ones_do_not_overlap(spark):
    rows = secret_rows()
    got = secrets.find_secrets(documents(spark, rows).repartition(3)).collect()
    by_id = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute_base(t)
        assert [s for s in by_id[i] if s[0] != "crf"] == base
        for _, s, e in (x for x in by_id[i] if x[0] == "crf"):
            assert 0 <= s < e <= len(t) and not any(a < e and s < b for _, a, b in base)
    assert secrets.find_secrets(documents(spark, [])).count() == 0
    assert all(not r["spans"] for r in secrets.find_secrets(documents(spark, [(1, "plain words 12345"), (2, None)])).collect())


def test_field_finds_secrets_that_no_pattern_names(spark):
    rows = secret_rows(5, 400)
    plain = [(1000 + i, t.replace("token =", "pwd =")) for i, t in rows if t and i is not None and 'token = "' in t and len(t) < 60_000]
    field = secrets.train(documents(spark, rows))
    short = re.compile(r'pwd = "([0-9a-f]{23})"')
    hidden = [(i, t) for i, t in plain if short.search(t)]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(documents(spark, hidden), field).collect()}
    caught = sum(any(s["start"] <= short.search(t).start(1) < s["end"] for s in found[i]) for i, t in hidden)
    assert hidden and caught >= 0.6 * len(hidden)


def test_rare_secrets_are_learned_from_the_whole_corpus(spark):
    """The only document with base spans lies outside the sample, and the field is still trained."""
    from pyspark.sql import functions as F

    rows = [(i, f"plain words {i} and 77{i} more") for i in range(60)]
    table = documents(spark, rows)
    last = table.select("doc_id").orderBy(F.xxhash64("doc_id").desc()).first()[0]
    secret = " ".join(f'line {k} password = "a1b2c3d4e5{k}" end' for k in range(9))
    field = secrets.train(documents(spark, [(i, secret if i == last else t) for i, t in rows]), sample=5)
    assert field.trained
    assert not secrets.train(table, sample=5).trained


def test_quality_columns_of_any_name(spark):
    rows = [(i, ("good clean text " if i % 2 else "junk junk spam ") * 9 + str(i)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.train(documents(spark, rows), labels)
    plain = {r["doc_id"]: r["score"] for r in quality.scored(documents(spark, rows).select("doc_id", "text"), model).collect()}
    odd = documents(spark, rows).select("doc_id", "text").selectExpr("doc_id", "text", "1 as _whole_text", "2 as __whole_text")
    got = quality.scored(odd, model).collect()
    assert {r["doc_id"]: r["score"] for r in got} == plain and {(r["_whole_text"], r["__whole_text"]) for r in got} == {(1, 2)}


def test_viterbi_is_the_best_path_and_the_shortcut_is_exact():
    random_ = np.random.default_rng(3)
    for _ in range(60):
        field = secrets.Field(np.zeros((1, 3), np.float32), random_.normal(0, 2, (3, 3)))
        scores = random_.normal(0, 2, (6, 3))
        scores[:, 0] += random_.choice([0, 12], 6)

        def value(path):
            return sum(scores[k, y] for k, y in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=6), key=value)
        tags = field.tags(scores)
        assert tuple(tags.get(k, 0) for k in range(6)) == best


def labelled(seed=6, n=400):
    random.seed(seed)
    words = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        own, good = random.choices(words, k=random.randint(5, 50)), random.random() < 0.7
        if not good:
            own = random.choice([[w + "%%%" for w in own], [w.upper() + "!!" for w in own], [w for w in own for _ in range(8)]])
        docs.append((i, " ".join(own)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_on_the_held_out_fold(spark):
    docs, labels = labelled()
    docs += [(900, None), (901, ""), (None, "a b"), (902, "x" * 50_000)]
    labels += [(3, None, 1), (None, 1, 0), (labels[5][0], labels[5][1], 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(documents(spark, docs), table).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    none = quality.quality_scores(documents(spark, docs[:3]), table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(documents(spark, []), table).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = labelled(7, 200)
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    one = quality.quality_scores(documents(spark, docs), spark.createDataFrame(labels, kind)).collect()
    two = quality.quality_scores(documents(spark, docs), spark.createDataFrame(flipped, kind)).collect()
    assert sorted((r["doc_id"], r["score"]) for r in one) == sorted((r["doc_id"], r["score"]) for r in two)


def test_dual_descent_reaches_the_primal_optimum():
    random_ = np.random.default_rng(1)
    x, y = random_.normal(size=(60, 4)), None
    y = np.where(x @ [1, -2, 0.5, 0] + 0.3 * random_.normal(size=60) > 0, 1.0, -1.0)
    rows, values = [np.arange(4)] * 60, list(x)
    w, b = quality.dual_descent(rows, values, y, np.full(60, 0.5), 500, 1)

    def primal(v):
        return v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v[:4] + v[4])).sum()

    best = primal(np.append(w[:4], b))
    assert all(primal(np.append(w[:4], b) + random_.normal(0, 0.05, 5)) >= best - 1e-3 for _ in range(300))


def lm_rows(seed=4, n=120):
    random.seed(seed)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(n):  # each word is mostly followed by the next one
        at, own = random.randrange(40), []
        for _ in range(random.randint(0, 60)):
            own.append(words[at].upper() if random.random() < 0.1 else words[at])
            at = (at + 1) % 40 if random.random() < 0.9 else random.randrange(40)
        rows.append((i, " ".join(own) + (f" rare{i}" if i % 3 == 0 else "")))
    return rows + [(700, None), (701, ""), (None, "w1 w2"), (702, "w3 " * 5000)]


def test_language_model_scores(spark):
    rows = lm_rows()
    got = recurrent_lm.lm_scores(documents(spark, rows).repartition(2), head=20).collect()
    fold = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 for i, _ in rows}
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + [None] for i, t in rows}
    counts = Counter(w for i, own in tokens.items() if fold[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own) for i, own in tokens.items()}
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (fold[r["doc_id"]] == 0) and r["train_tokens"] == n and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * max(1, abs(base[r["doc_id"]]))
        assert r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert recurrent_lm.lm_scores(documents(spark, [])).count() == 0


def test_class_factored_output_is_a_distribution():
    vocabulary = recurrent_lm.Vocabulary([b"a", b"b"], np.array([5, 3]), 2, 14, 7)
    net = recurrent_lm.Network.start(vocabulary)
    states = np.random.default_rng(0).normal(size=(1, recurrent_lm.STATE)).astype(np.float32)
    every = np.arange(recurrent_lm.NAMED + 1)
    total = np.exp(net.output(np.repeat(states, len(every), axis=0), every)).sum()
    assert abs(total - 1) < 1e-4


def test_named_words_grow_with_the_corpus():
    def vocabulary(distinct):  # all words equally frequent
        return recurrent_lm.Vocabulary([b"%d" % k for k in range(distinct)], np.full(distinct, 3), 5, 3 * distinct + 5, distinct + 1)

    small, large = vocabulary(2000), vocabulary(20_000)
    assert small.named() >= 1024 and recurrent_lm.Vocabulary([], np.array([], np.int64), 0, 0, 0).named() >= 1024
    assert 3 * (large.named() - 1) + 5 >= recurrent_lm.COVER * large.total and large.named() < 20_000
    net = recurrent_lm.Network.start(large)
    assert len(net.table) == large.named() + 1 and net.word_w.shape[0] * recurrent_lm.CLASS_SIZE == large.named()
    every = np.arange(large.named() + 1)
    states = np.random.default_rng(0).normal(size=(1, recurrent_lm.STATE)).astype(np.float32)
    assert abs(np.exp(net.output(np.repeat(states, len(every), axis=0), every)).sum() - 1) < 1e-3


def test_state_is_carried_across_windows():
    vocabulary = recurrent_lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 3, 2]), 2, 14, 7)
    net = recurrent_lm.Network.start(vocabulary)
    docs = [np.array([1, 2, 3, 1, 2, 0], np.int32), np.array([0], np.int32), np.array([3, 3, 0], np.int32)]
    inputs, targets, keep, doc = recurrent_lm.packed(docs, 2)
    h = np.zeros((inputs.shape[1], recurrent_lm.STATE), np.float32)
    whole, _ = net.run(inputs, keep, h)
    first, h = net.run(inputs[:2], keep[:2], h)
    rest, _ = net.run(inputs[2:], keep[2:], h)
    assert np.allclose(whole, np.concatenate([first, rest]), atol=1e-6)
    alone = recurrent_lm.packed([docs[2]], 1)
    single, _ = net.run(alone[0], alone[2], np.zeros((1, recurrent_lm.STATE), np.float32))
    lane, at = np.argwhere((doc == 2).T)[0]
    assert np.allclose(single[:, 0], whole[at:at + 3, lane], atol=1e-6)
