"""Exact, near and line deduplication against brute force, with nulls, ties, hot groups and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from orthoflow.llm import exact_dedup, line_dedup, near_dedup

DOCS = "doc_id long, text string, lang string, _key string, slot int"
SPACE = re.compile("[\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in rows], DOCS)


def texts_with_copies(seed=1, n=120):
    random.seed(seed)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        if rows and random.random() < 0.5:
            base = (random.choice(rows)[1] or "").split(" ")
            for _ in range(random.choice([0, 0, 1, 3])):
                base[random.randrange(len(base))] = random.choice(words)
            text = random.choice([" ", "\t", "  \n"]).join(base) if random.random() < 0.3 else " ".join(base)
        else:
            text = " ".join(random.choices(words, k=random.randint(1, 60)))
        rows.append((i * 3 + 2, text.upper() if random.random() < 0.1 else text))
    return rows + [(1, None), (4, ""), (7, " \n\t "), (10, "one"), (13, "ONE"), (16, "one two"), (19, " x y"), (22, "w " * 30_000)]


@pytest.mark.parametrize("bucket_rows", [2, 8192])
def test_exact_groups(spark, bucket_rows):
    rows = texts_with_copies() + [(5000 + i, "hot  text") for i in range(60)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(frame(spark, rows).repartition(5), bucket_rows).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    assert len(got) == len(rows)
    for norm, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_ties_null_ids_and_kept_rows(spark):
    rows = [(3, "a"), (3, "a"), (None, "a"), (None, "b"), (9, "c d"), (8, "c\td")]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == sorted([
        ("3", "3", 3), ("3", "3", 3), ("None", "3", 3), ("None", "None", 1), ("9", "8", 2), ("8", "8", 2)])
    assert sum(r["kept"] for r in got) == 3
    kept = exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "_key", "slot"]
    assert sorted((str(r["doc_id"]), r["text"], r["_key"]) for r in kept.collect()) == [("3", "a", "k"), ("8", "c\td", "k"), ("None", "b", "k")]
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_colliding_keys_are_told_apart_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([5, 5, 5, 5, 6]), pa.array([1, 2, 3, 4, 5]), pa.array(["x", "y", "x", "y", "x"])], ["_key", "_entry", "_text"])
    assert [b.column("_class").to_pylist() for b in exact_dedup._owner(iter([batch]))] == [[1, 2, 1, 2, 5]]


def test_directory_doubles_and_covers_all_prefixes():
    depth, table = exact_dedup.directory({0: 10, 1: 1, 8: 3, 15: 3}, 4, 4)
    assert depth == 4 and set(table) == set(range(16))
    assert table[0] != table[1] and table[2] == table[3] and table[8] == table[11]


def shingle_set(text, width):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and both * den >= num * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("width", "num", "den", "tile"), [(3, 85, 100, 4_000_000), (5, 4, 5, 700)])
def test_near_components(spark, width, num, den, tile):
    rows = texts_with_copies(3, 150)
    base = [f"w{i}" for i in range(120)]
    random.seed(9)
    for i in range(60):  # variants of one text: near the text, less near each other
        own = list(base)
        for _ in range(2):
            own[random.randrange(120)] = f"v{i}"
        rows.append((9000 + i, " ".join(own)))
    got = {r["doc_id"]: r for r in near_dedup.near_components(frame(spark, rows).repartition(3), width, num, den, tile=tile).collect()}
    want = brute_components(rows, width, num, den)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_nulls_ties_empty(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, None), (6, None), (1, "a  b c D e f")]
    got = near_dedup.near_components(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == sorted([
        ("None", 2, "None", True), ("2", 2, "1", False), ("2", 2, "1", False), ("5", 0, "5", True), ("6", 0, "6", True), ("1", 2, "1", True)])
    kept = near_dedup.one_of_each(frame(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "6", "None"]
    assert near_dedup.near_components(frame(spark, [])).count() == 0


def test_one_id_with_two_texts(spark):
    """The sets of one id are one document; the stage that drops judges each text by itself."""
    a, b, c = " ".join("abcdefghij"), " ".join("klmnopqrst"), " ".join("uvwxyzabcd")
    rows = [(3, b), (5, a), (5, b), (5, b), (8, a), (9, c), (9, a), (11, c)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(frame(spark, rows)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (8, 3, False), (9, 3, False), (11, 3, False)}
    kept = sorted((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(frame(spark, rows)).collect())
    assert [t for _, t in kept if t == b] == [b] and kept[0] == (3, b)
    assert sorted({t for _, t in kept}) == sorted({a, b, c}) and len(kept) == 3
    alone = [(5, a), (5, b), (7, c)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(frame(spark, alone)).collect()) == sorted(alone)


def test_bayesian_bounds_grow_with_matches():
    steps = near_dedup.least_matches(85, 100, 1e-6)
    assert steps[0][0] == near_dedup.BATCH and all(b[1] > a[1] for a, b in zip(steps, steps[1:]))
    assert all(0 < least < 0.85 * n for n, least in steps)


def line_key(line):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    return key if len(key) >= 10 else None


def brute_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and line_key(line):
                held[line_key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or not (len(held.get(line_key(x), ())) >= 2 and min(held[line_key(x)]) < i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows(seed=4, n=60):
    random.seed(seed)
    pool = [f"{'Shared' if k % 2 else 'other'} line number {k}" for k in range(15)] + ["short", "", "  ", "éééééééééé", "ééééééééé", " padded line here "]
    rows = []
    for i in range(n):
        lines = [random.choice(pool) if random.random() < 0.7 else f"line of its own {i} {j}" for j in range(random.randint(0, 8))]
        rows.append((i, "\n".join(random.choice([x, x.upper(), f" \t{x}\r"]) for x in lines)))
    return rows + [(1000, None), (1001, ""), (None, "shared line number 1\nx")]


def lines_of(result):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in result.collect()), key=str)


def test_lines_against_brute_force(spark):
    rows = line_rows()
    docs = frame(spark, rows).repartition(4)
    assert lines_of(line_dedup.dedup_lines(docs, line_dedup.insert(docs))) == brute_lines(rows)
    empty = frame(spark, [])
    assert line_dedup.dedup_lines(empty, line_dedup.insert(empty)).count() == 0


def test_lines_insert_and_delete_are_reversible(spark):
    rows = line_rows(8)
    first, second = [r for r in rows if (r[0] or 0) % 3], [r for r in rows if not (r[0] or 0) % 3]
    index = line_dedup.insert(frame(spark, second), line_dedup.insert(frame(spark, first)))
    docs = frame(spark, rows)
    assert lines_of(line_dedup.dedup_lines(docs, index)) == brute_lines(rows)
    back = line_dedup.delete(index, spark.createDataFrame([(i,) for i, _ in second if i is not None], "doc_id long"))
    left = frame(spark, first)
    assert lines_of(line_dedup.dedup_lines(left, back)) == brute_lines(first)
    fresh = line_dedup.insert(left)
    assert sorted(map(tuple, back.counts.collect()), key=str) == sorted(map(tuple, fresh.counts.collect()), key=str)


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    random.seed(1)
    digests = [random.randbytes(16) for _ in range(30_000)]
    own = line_dedup.Cuckoo()
    for d in digests:
        own.add(d)
    assert not own.full and all(d in own for d in digests)
    for d in digests[:15_000]:
        own.remove(d)
    assert all(d in own for d in digests[15_000:])
    assert sum(d in own for d in digests[:15_000]) < 50
