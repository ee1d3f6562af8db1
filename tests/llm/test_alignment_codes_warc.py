"""Token alignment, vector codes and WARC archives against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, Not, StringStartsWith

from orthoflow.llm import token_alignment, vector_codes, warc
from orthoflow.llm.groups import group_key, with_group

FOLDER = "/root/testdata/sf0.001"


# --- alignment

def plain_alignment(rows):
    """Groups by sets of end offsets, links by comparing every end."""
    v = token_alignment.Vocabularies.load()
    tokens, out = {}, {}
    for k, (_, text) in enumerate(rows):
        tokens[k] = ([], [])
        if text:
            (a,), (b,) = v.encode([f" {text}"])
            wanted = (" " + text).encode()
            if b"".join(v.a.tokens[i] for i in a) == wanted == b"".join(v.b.tokens[i] for i in b):
                tokens[k] = (a, b)
    def ends(side, ids):
        at, all_ = 0, []
        for i in ids:
            at += len(side.tokens[i])
            all_.append(at)
        return all_
    links, counts = {}, Counter()
    for k, (a, b) in tokens.items():
        at_b = dict(zip(ends(v.b, b), b))
        links[k] = [(i, at_b[e]) for i, e in zip(a, ends(v.a, a)) if e in at_b]
        counts.update(links[k])
    highest = defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    for k, (a, b) in tokens.items():
        ea, eb = ends(v.a, a), ends(v.b, b)
        cuts = sorted(set(ea) & set(eb))
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(a, ea) if last < e <= c) + "|" + ",".join(str(j) for j, e in zip(b, eb) if last < e <= c))
            last = c
        out[k] = (len(a), len(b), len(cuts), len(links[k]), sum(counts[x] == highest[x[1]] for x in links[k]), sum(counts[x] for x in links[k]),
                  hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
    return [(i, *out[k]) for k, (i, _) in enumerate(rows)]


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark):
    random.seed(3)
    odd = ["", None, " ", "a", "\n", "  two  blanks ", "naïve café", "日本語のテキスト", "🙂🙃 emoji", "<|endoftext|> </s> <unk>", "▁ low line", "\t\x00 nul",
           "x" * 3000, "ab" * 2000, "é" * 500, "word " * 4000, "supercalifragilistic antidisestablishmentarianism", "1234567890 " * 20]
    words = ["the", "Quality", "zum", "über", "élève", "data", "token", "ization", "日", "🙂", "0x1F", "--", "...", "http://x.y/z?q=1"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100 + k, " ".join(random.choices(words, k=random.randint(1, 60)))) for k in range(60)]
    rows += [(100, "the data"), (None, "the data"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, links string, n_a int").repartition(4)
    got = token_alignment.alignment(docs)
    assert tuple(got.columns) == FIELDS
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_alignment(rows)))


def test_alignment_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r) for r in token_alignment.alignment(docs.repartition(3)).collect()}
    assert got == {r[0]: r for r in plain_alignment(rows)}
    assert sum(r[2] > 0 for r in got.values()) > 100


def test_alignment_of_no_rows(spark):
    assert token_alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_cuts_by_halving(seed):
    rng = np.random.default_rng(seed)
    a, b = [np.unique(np.concatenate([rng.integers(1, 400, rng.integers(1, 120)), [400, 700]])) for _ in range(2)]
    a = np.unique(np.concatenate([a, rng.integers(401, 700, seed * 3)]))
    first = int(np.searchsorted(a, 400))
    cuts = token_alignment.shared_cuts(a, b, np.array([0, first + 1]), np.array([first, len(a) - 1]))
    assert a[cuts].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_cuts_far_from_the_middle():
    n = 50_000
    a = np.arange(1, n + 1)
    for b in (np.array([n]), np.array([1, n]), np.concatenate([np.arange(n - 9, n + 1)]), np.array([n // 2, n])):
        assert a[token_alignment.shared_cuts(a, b, np.array([0]), np.array([n - 1]))].tolist() == b.tolist()


def test_pairs_cover_all_suffixes():
    a, b = token_alignment.Side([b"ab", b"b", b"", b"cab"]), token_alignment.Side([b"b", b"xcab", b"a", b"b"])
    pairs = token_alignment.Pairs(a, b)
    assert {(int(k) // 4, int(k) % 4) for k in pairs.keys} == {(0, 0), (0, 3), (1, 0), (1, 3), (3, 0), (3, 3), (3, 1), (0, 1), (1, 1)}
    assert len(pairs.keys) < 1_200_000


# --- vector codes

def plain_codes(rows, rounds=6, parts=8, entries=16):
    kept = [(i, [math.floor(4096 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    share = len(kept[0][1]) // parts
    cut = [[v[p * share:(p + 1) * share] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, np.array(kept[k][1], np.float32).tobytes()))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for row in cut:
                mine[near(row[p], books[p])[1]].append(row[p])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else y for e, y in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    found, by_label = [], Counter()
    for (i, _, c), row in zip(kept, cut):
        best = [near(row[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), c))
        by_label[c] += found[-1][2]
    return [(i, code, error, by_label[c], digest) for i, code, error, c in found]


VECTORS = "vec_id long, embedding array<float>, label int, code string, n int"


def codes(spark, rows, schema=VECTORS, **more):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    return [tuple(r) for r in vector_codes.vector_codes(frame, **more).collect()]


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    def vector():
        return [float(np.float32(x)) for x in rng.normal(0, 0.3, 16)]
    rows = [(int(k), vector(), int(rng.integers(0, 4)) if k % 7 else None) for k in rng.permutation(150)]
    rows += [(200 + k, rows[0][1], 2) for k in range(60)]
    rows += [(-5, None, 1), (-4, [1.0] * 15 + [None], 1), (-3, [float("nan")] + [0.0] * 15, 1), (-2, [float("inf")] * 16, 1)]
    rows += [(None, vector(), None), (300, [0.0] * 16, 3), (301, [-0.0] * 16, 3), (302, [-1.0] * 16, 3)]
    assert sorted(map(str, codes(spark, rows))) == sorted(map(str, plain_codes(rows)))


def test_codes_of_few_rows_ragged_rows_and_none(spark):
    assert codes(spark, []) == []
    assert codes(spark, [(1, None, 1), (2, [None], 1)]) == []
    few = [(1, [1.0, 2.0] * 8, 1), (2, [1.0, 2.0] * 8, None), (2, [0.5] * 16, None)]
    assert sorted(map(str, codes(spark, few))) == sorted(map(str, plain_codes(few)))
    ragged = [(1, [1.0] * 5, 1), (2, [2.0] * 11, 1), (3, [], 2)]
    padded = [(i, v + [0.0] * (16 - len(v)), c) for i, v, c in ragged]
    assert sorted(codes(spark, ragged)) == sorted(plain_codes(padded))
    assert [r[:4] for r in codes(spark, [(1, [], 1)])] == [(1, "00" * 8, 0, 0)]


def test_codes_of_huge_components(spark):
    rows = [(k, [(-1.0) ** j * 10.0 ** (k % 9) * (j + 1) for j in range(8)], k % 2) for k in range(30)]
    schema = VECTORS.replace("float", "double")
    assert sorted(codes(spark, rows, schema)) == sorted(plain_codes(rows))
    beyond = codes(spark, [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1)], schema, entries=1)
    assert {r[2] for r in beyond} == {vector_codes.LARGEST} == {r[3] for r in beyond}


@pytest.mark.parametrize("k", [1, 2, 16, 40])
def test_orchard_finds_the_nearest(k):
    rng = np.random.default_rng(k)
    entries = rng.integers(-6, 7, (k, 3))
    points = rng.integers(-9, 10, (500, 3))
    at, distance = vector_codes.orchard(points, entries)
    every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_groups_hot_and_cold(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else f"c{k}", 7) for k in range(3000)], "id long, g string, total int").withColumn("key", group_key("g"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("total"))
    got = with_group(rows, groups, "key", "n", F.col("id"))
    assert got.columns == ["id", "g", "key", "total"]
    largest = {}
    for k in range(3000):
        largest["hot" if k % 3 else None if k % 2 else f"c{k}"] = k
    assert sorted((r["id"], r["total"]) for r in got.collect()) == [(k, largest["hot" if k % 3 else None if k % 2 else f"c{k}"]) for k in range(3000)]


# --- WARC

def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive(spark, rows, **more):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/archive"
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, key string, n int")
    warc.write_archive(frame.repartition(3), folder, **more)
    return folder


PAGES = [(1, "http://a/x y", "<p>one"), (2, "http://a/é\r\nWARC-Type: fake", "<p>one"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
         (6, "u", "\r\n\r\n\r\n"), (7, "u", "ü🙂" * 50_000), (8, "u", "ü🙂" * 50_000), (8, "v", "ü🙂" * 50_000), (None, "u", "<p>one"), (None, "w", "null only"), (None, "w", "null only")]
PAGES += [(k, "u", "hot page") for k in range(100, 400)]


def plain_pages(rows, least=0):
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max((x for x in (keep.get(h or ""), i) if x is not None), default=None)
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= least and i != keep[h or ""]
        yield i, len(body), sha1_32(body), "revisit" if again else "response", keep[h or ""] if again else None, None if again else True


@pytest.mark.parametrize("least", [0, 1, 9])
def test_archive_round_trip(spark, least):
    folder = archive(spark, PAGES, least_bytes=least)
    got = warc.archived_pages(spark, folder)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_matches"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_pages(PAGES, least)))
    uris = {r["target_uri"] for r in warc.read_archive(spark, folder, ["target_uri"]).collect()}
    assert {"http://a/x%20y", "http://a/%C3%A9%0D%0AWARC-Type:%20fake", ""} <= uris


def test_archive_without_records(spark):
    folder = archive(spark, [])
    assert warc.archived_pages(spark, folder).collect() == []
    assert warc.read_archive(spark, folder).collect() == []


def test_predicates_are_pushed_and_unwanted_blocks_are_passed_over(spark, capfd):
    folder = archive(spark, PAGES)
    frame = warc.read_archive(spark, folder, ["record_id", "record_type", "content_length", "payload"]).filter(
        (F.col("record_type") == "response") & F.col("record_id").isin("<urn:page:7>", "<urn:page:8>", "<urn:page:4>") & (F.col("content_length") < 1000))
    assert [(r["record_id"], bytes(r["payload"])) for r in frame.collect()] == [("<urn:page:4>", b"")]
    frame.explain()
    plan = capfd.readouterr().out
    assert "Filter" not in plan.split("BatchScan")[0] and "record_type" in plan

    class Counted:
        def __init__(self, data):
            self.data, self.at, self.bytes = data, 0, 0

        def read(self, n):
            out = self.data[self.at:self.at + n]
            self.at += len(out)
            self.bytes += len(out)
            return out

        def seek(self, at):
            self.at = at

    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 1000000\r\n\r\n" + b"x" * 1_000_000 + b"\r\n\r\n"
    source = Counted((record % b"metadata") * 20 + record % b"response")
    wanted = warc.Wanted(["record_type", "payload"], dict(warc.HEADERS), [("record_type", "=", "response")])
    rows = list(warc.records(warc.Cursor(source, True), "f", wanted))
    assert [r[0] for r in rows] == ["response"] and len(rows[0][1]) == 1_000_000
    assert source.bytes < 1_000_000 + 50 * warc.BUFFER < len(source.data) // 4


def test_tests_of_predicates():
    names = {"record_type": "warc-type"}
    assert warc.as_test(EqualTo(("record_type",), "response"), names) == ("record_type", "=", "response")
    assert warc.as_test(EqualTo(("headers", "x"), "response"), names) is None
    assert warc.as_test(EqualTo(("payload",), b""), names) is None
    assert warc.as_test(Not(In(("record_type",), ("a", None))), names) is None
    assert warc.as_test(Not(IsNotNull(("record_type",))), names) == ("record_type", "null", True)
    starts = warc.as_test(Not(StringStartsWith(("record_type",), "re")), names)
    wanted = warc.Wanted([], names, [starts])
    assert [wanted.keeps({"warc-type": t}) for t in ("request", "metadata")] == [False, True] and not wanted.keeps({})


def test_foreign_archives(spark):
    """Gzip members, odd header case and folding, chunked and gzip coding, records that are no HTTP, blank lines between."""
    zipped = gzip.compress(b"hello " * 100)
    chunked = b"%x\r\n" % 20 + zipped[:20] + b"\r\n%x;ext=1\r\n" % (len(zipped) - 20) + zipped[20:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    parts = [
        b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n",
        b"\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Note: one\r\n two\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(p) for p in parts))
    with open(f"{folder}/b.warc", "wb") as f:
        f.write(b"".join(parts))
    frame = warc.read_archive(spark, folder, fields=["X-Note"], partition_bytes=1)
    assert frame.rdd.getNumPartitions() == 2
    rows = frame.orderBy("file", "record_type").collect()
    assert [r["record_type"] for r in rows] == ["response", "warcinfo"] * 2
    for r in rows[::2]:
        assert bytes(r["payload"]) == b"hello " * 100 and r["http_status"] == 404 and r["x_note"] == "one two" and r["headers"]["warc-type"] == "response"
    assert [bytes(r["payload"]) for r in rows[1::2]] == [b"a: b"] * 2
    assert frame.filter(F.col("x_note").isNull()).count() == 2
    assert warc.decode_payload(zlib.compress(b"x")[2:-4], {"content-encoding": "deflate"}) == b"x"
    assert warc.decode_payload(b"no gzip", {"content-encoding": "gzip"}) == b"no gzip"


@pytest.mark.parametrize("broken", [b"GIF89a" * 9, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])
def test_broken_archives_fail_by_name(spark, broken):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/broken.warc", "wb") as f:
        f.write(broken)
    with pytest.raises(Exception, match="broken.warc: "):
        warc.read_archive(spark, folder, ["record_type"]).collect()
