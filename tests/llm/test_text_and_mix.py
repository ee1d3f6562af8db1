"""Chat formatting, token counts, mixing, decontamination and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from orthoflow.llm import chat, decontaminate, exact_dedup, mixing, near_dedup, queries, quality, token_counts

SMALL = "/root/testdata/sf0.001"


def turns_of(rows):
    return sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2], v[3]))


def test_chat_round_trip(spark):
    random.seed(3)
    bits = ["</s>", "[INST]", "\\", "\\\\[", "<<TURN x>>", "<</TURN>>", "<<s>", " ok ", "\n", "é", "<<SYS>>", ">", "<"]
    rows = [(c, t, random.choice(["system", "user", "assistant", "assistant", "tool > \\ x", None]), "".join(random.choices(bits, k=5)))
            for c in range(12) for t in range(random.randint(1, 9))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(400)]  # one long conversation
    rows += [(90, 1, "user", None), (91, None, None, None), (92, 1, "user", "b"), (92, 1, "user", "a"), (92, 1, "user", "a"), (None, 0, "user", "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, position string").repartition(7)
    segments = chat.format_turns(frame)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    by_conv = defaultdict(list)
    for c, t, r, x in turns_of(rows):
        by_conv[c].append((r, x))
    assert set(got) == set(by_conv)
    template = chat.Template()
    for c, own in by_conv.items():
        learned = "".join(x for r, x in own if r == "assistant")
        invalid = sum(not template.expects(own[k - 1][0] if k else None, r) for k, (r, _) in enumerate(own))
        text = "".join(template.opening(r) + template.escape(x) + template.closing(r) for r, x in own)
        row = got[c]
        assert row["n_turns"] == len(own) and row["n_invalid"] == invalid and row["formatted_chars"] == len(text)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert row["loss_chars"] == len(learned) and row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    pattern = template.pattern()
    for r in segments.filter("part = 1").collect():
        assert not pattern.search(r["segment"]) and r["loss"] == (r["role"] == "assistant")
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_escape_is_reversible():
    random.seed(1)
    template = chat.Template()
    for _ in range(3000):
        text = "".join(random.choices(["<", "s", ">", "/", "[", "INST", "]", "\\", "SYS", "TURN ", "\n"], k=9))
        assert chat.unescape(template.escape(text)) == text and not template.pattern().search(template.escape(text))


def test_edited_trees_equal_a_fresh_encoding():
    random.seed(5)
    count, encode = token_counts.counter(), token_counts.encoder().encode_ordinary
    bits = ["word", " ", "  ", "\n", "\t", "é", "it's", "12", "!!", " \n ", "\x1c", " ", "longer words", "'ll"]
    for _ in range(250):
        text = "".join(random.choices(bits, k=random.choice([0, 1, 5, 300])))
        tree = token_counts.CountTree.of(text, count)
        assert tree.tokens[1] == len(encode(text))
        for _ in range(6):
            a = random.randint(0, len(text) + 3)
            b, new = a + random.choice([0, 0, 1, 3, 40]), "".join(random.choices(bits, k=random.randint(0, 3)))
            tree.edit(a, b, new)
            start, stop = min(a, len(text)), min(b, len(text))
            text = text[:start] + new + text[stop:]
            assert "".join(tree.texts) == text and tree.tokens[1] == len(encode(text))
            chars, tokens, total = tree.arrays()
            assert sum(chars) == len(text) and sum(tokens) == total


def test_only_touched_regions_are_encoded_again():
    count = token_counts.counter()
    tree = token_counts.CountTree.of("some words of text " * 5000, count)
    tree.edit(40_000, 40_005, "new")
    assert 0 < tree.encoded < 1000


def test_token_count_tables(spark):
    rows = [(1, "a text of words", 1), (2, None, 2), (None, "x", 3), (3, "long " * 20_000, 4), (1, "a text of words", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_encoded_ int")
    edits = spark.createDataFrame([(1, 2, 0, 1, None), (1, 1, 2, 6, "page"), (3, 1, 50, 70, " cut "), (9, 1, 0, 0, "x"), (2, 1, None, 3, "q")],
                                  "doc_id long, seq int, start long, stop long, insert string")
    got = token_counts.apply_edits(token_counts.with_edits(token_counts.build_trees(docs), edits)).collect()
    encode = token_counts.encoder().encode_ordinary
    assert len(got) == 5 and all(r["n_tokens"] == len(encode(r["text"])) for r in got)
    assert sorted(r["text"] for r in got if r["doc_id"] in (1, 2)) == ["", " page of words", " page of words"]
    assert token_counts.apply_edits(token_counts.with_edits(token_counts.build_trees(docs.limit(0)), edits)).count() == 0


def test_token_count_query_on_whole_texts(spark):
    got = queries.op4_token_counts(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    encode = token_counts.encoder().encode_ordinary
    assert len(got) == len(texts) and all(r["n_tokens_before"] == len(encode(texts[r["doc_id"]])) for r in got)


def sources(spark, sizes):
    rows = [(i * 7 + k * 100_000, name, "t") for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, source string, slot string")


def fluid(w, pieces, t):
    """Exact pieces of every source after t slots: shares by weight, those of dry sources shared by the others."""
    done, left, live = {}, Fraction(t), dict(w)
    while live:
        v = left / sum(live.values())
        dry = {k for k in live if Fraction(pieces[k]) / live[k] <= v}
        if not dry:
            return done | {k: x * v for k, x in live.items()}
        k = min(dry, key=lambda k: Fraction(pieces[k]) / live[k])
        done[k], left = Fraction(pieces[k]), left - pieces[k]
        del live[k]
    return done


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1, None: 1}])
def test_mix_follows_the_weights(spark, weights):
    sizes = {"a": 500, "b": 330, "c": 61, None: 47, "d": 1}
    rows = mixing.mix_sources(sources(spark, sizes), weights, block_docs=4, parts=20).collect()
    assert len(rows) == sum(sizes.values()) == len({r["doc_id"] for r in rows})
    deal = deals(rows)
    if weights:
        w = {k: Fraction(weights.get(k, Fraction(10, 20))) for k in sizes}
    else:
        w = {k: Fraction(math.floor(math.sqrt(n) * 2 ** 20 + 0.5)) for k, n in sizes.items()}
    pieces = {k: math.ceil(n / 2) for k, n in sizes.items()}
    small = {k for k, x in w.items() if x * 20 < sum(w.values())}
    grouped = {k: x for k, x in w.items() if k not in small} | ({"pool": sum(w[k] for k in small)} if small else {})
    stock = {k: pieces.get(k) or sum(pieces[j] for j in small) for k in grouped}
    used = defaultdict(int)
    for at in range(0, len(deal), 20):
        cycle, before = deal[at:at + 20], dict(used)
        quota = defaultdict(int)
        for source in cycle:
            quota["pool" if source in small else source] += 1
        for t, source in enumerate(cycle, 1):  # in a cycle: less than one piece from the quota, at every slot
            used["pool" if source in small else source] += 1
            assert all(abs(used[k] - before.get(k, 0) - Fraction(q * t, len(cycle))) < 1 for k, q in quota.items())
        exact = fluid(grouped, stock, at + len(cycle))
        assert all(abs(used[k] - x) < 1 for k, x in exact.items()), at  # at its end: less than one from the exact weight


def deals(rows):
    """Sources by slot, after checks that slots, blocks and places have no gaps."""
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in rows}, key=lambda s: s[0])
    assert [s[0] for s in slots] == list(range(len(slots)))
    taken, places = defaultdict(int), defaultdict(list)
    for _, source, block in slots:
        assert block == taken[source]
        taken[source] += 1
    for r in rows:
        places[r["slot"]].append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return [s[1] for s in slots]


def most_off(deal, w):
    used, worst = defaultdict(int), 0
    for t, source in enumerate(deal, 1):
        used[source] += 1
        worst = max(worst, *(abs(used[k] - t * x / sum(w.values())) for k, x in w.items()))
    return worst


def test_pipeline_mix_does_not_drift_from_the_weights(spark):
    sizes = {"hot": 64_000} | {f"s{k}": 6_400 for k in range(20)}
    rows = corpus_pipeline.mix_to_weights(spark, sources(spark, sizes), "").select("doc_id", "source", "slot", "block", "place").collect()
    assert len(rows) == sum(sizes.values()) == len({r["doc_id"] for r in rows})
    deal = deals(rows)
    w = {k: math.sqrt(n) for k, n in sizes.items()}
    assert most_off(deal[:int(1600 / w["s0"] * sum(w.values())) - 400], w) < 2  # pieces: less than a block, before a source runs dry


def test_mix_stays_within_a_block_over_a_thousand_cycles(spark):
    w = {"a": math.sqrt(2), "b": 1, "c": 0.3, "d": math.pi, None: 0.21}
    sizes = {k: int(9_000 * x) for k, x in w.items()}
    deal = deals(mixing.mix_sources(sources(spark, sizes), w, block_docs=2, parts=40).collect())
    assert len(deal) == sum(sizes.values()) > 1_000 * 40
    assert most_off(deal[:-60], w) < 2


def test_mix_keeps_small_weights_and_shares_what_is_left(spark):
    sizes, w = {"a": 1000, "b": 3000, None: 5000, "e": 3}, {"a": 2, "b": 1, None: 3, "e": 0.0005}
    rows = mixing.mix_sources(sources(spark, sizes), w, block_docs=1).collect()
    deal = deals(rows)
    assert len(rows) == sum(sizes.values()) == len(deal)
    assert deal[:2900].count("e") <= 1  # 2,900 slots have a quarter of a piece for it
    end = max(t for t, s in enumerate(deal) if s == "a") + 1
    assert most_off(deal[:end // 400 * 400], w) < 2
    left = [s for s in deal[-(-end // 400) * 400:] if s != "e"]
    assert most_off(left[:3000], {"b": 1, None: 3}) < 3  # from a cycle's end, which may be one off
    assert mixing.mix_sources(sources(spark, {"a": 9}).limit(0)).count() == 0
    assert [r["slot"] for r in mixing.mix_sources(sources(spark, {"a": 9, None: 1}), {"q": 1}, block_docs=4).orderBy("slot").collect()].count(0) >= 1


def test_mix_of_more_sources_than_slots_of_a_cycle(spark):
    sizes = {f"s{k}": 30 for k in range(70)} | {"hot": 900}
    w = {k: 1 if k != "hot" else 20 for k in sizes}
    deal = deals(mixing.mix_sources(sources(spark, sizes), w, block_docs=2, parts=30).collect())
    assert len(deal) == sum(sizes.values())
    assert most_off(deal[:2600], w) < 2


def test_mix_edges(spark):
    rows = [(None, "a", "x"), (1, None, "y"), (1, "a", "z"), (1, "a", "z"), (1, "a", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, _key string")
    got = mixing.mix_sources(frame)
    assert got.columns == ["doc_id", "source", "_key", "slot", "block", "place"] and got.count() == 5
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_equals_the_plain_recurrence():
    random.seed(2)
    import numpy as np

    for _ in range(200):
        a, b = random.choices(range(6), k=random.randint(1, 12)), random.choices(range(6), k=random.randint(1, 30))
        score, end = decontaminate.local_alignment(np.array(a), np.array(b))
        assert score == smith_waterman(a, b) and smith_waterman(a, b[:end]) == score


def test_decontamination_against_brute_force(spark):
    random.seed(6)
    words = [f"word{k}" for k in range(2000)] + ["the", "of"] * 400
    items = [(i, " ".join(random.choices(words, k=random.randint(15, 40)))) for i in range(12)] + [(50, None), (51, " "), (52, "twoword item")]
    docs = []
    for i in range(150):
        own = random.choices(words, k=random.randint(0, 120))
        if i % 3 == 0:
            copy = random.choice(items[:12])[1].split()
            for _ in range(len(copy) // random.choice([4, 8, 1000])):
                at = random.randrange(len(copy))
                copy[at:at + 1] = random.choice([[], ["changed"], [copy[at].upper(), "added"]])
            at = random.randint(0, len(own))
            own[at:at] = copy
        docs.append((i, random.choice([" ", "\n\t"]).join(own)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "x twoword  ITEM y"), (503, "y " * 40_000 + items[1][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(table.repartition(3), bench, block_bytes=1500).collect()}
    for i, t in docs:
        own = (t or "").lower().split()
        for k, x in items:
            item = (x or "").lower().split()
            if not item or len(own) > 1000:
                continue
            share = smith_waterman(item, own) / (2 * len(item))
            assert ((i, k) in got) == (share >= decontaminate.RATIO or share * 2 * len(item) >= decontaminate.PASSAGE), (i, k, share)
            if (i, k) in got:
                assert abs(got[i, k]["score"] - share) < 1e-9
                span = own[got[i, k]["start_word"]:got[i, k]["end_word"]]
                assert smith_waterman(item, span) == round(share * 2 * len(item))
    assert (503, 1) in got
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i is None or not any((i, k) in got for k, _ in items)}
    assert decontaminate.matches(table, bench.limit(0)).count() == 0 and decontaminate.matches(table.limit(0), bench).count() == 0


def test_a_part_of_a_long_item_is_found(spark):
    """13 words of an item of 200 count; 12 do not, nor do common words alone."""
    random.seed(8)
    item = [f"rare{k}" for k in range(200)]
    filler = [f"own{k}" for k in range(300)]
    docs = [(n, " ".join(filler[:50] + item[70:70 + n] + filler[50:150])) for n in (12, 13, 40)] + [(99, " ".join(filler))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short and other item of words")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontaminate.matches(table, bench).collect()}
    assert got == {(13, 1, 50, 63), (40, 1, 50, 90)}
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == {12, 99}


def test_invalid_turns_are_counted_from_the_machine(spark):
    rows = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (2, 0, "assistant", "x"), (2, 1, "user", "y"), (3, 0, "tool", "t"), (3, 1, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_invalid"] for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "benchmark", "mix"]
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    good = stage["quality"](spark, docs, SMALL)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    first = stage["exact"](spark, good, SMALL)
    smallest = {}
    for r in good.collect():
        norm = re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")
        smallest[norm] = min(smallest.get(norm, r["doc_id"]), r["doc_id"])
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(smallest.values())
    near = stage["near"](spark, first, SMALL)
    groups = near_dedup.near_components(first).collect()
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in groups}
    clean = stage["benchmark"](spark, near, SMALL)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.matches(near, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - hit
    mixed = stage["mix"](spark, clean, SMALL)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in clean.collect())
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect())) and exact_dedup.exact_groups(whole).filter("NOT kept").count() == 0
    empty = docs.limit(0)
    for _, run in corpus_pipeline.STAGES:
        empty = run(spark, empty, SMALL)
    assert empty.count() == 0


def test_whole_rows_meet_their_slots_where_they_were_ranked(spark):
    """No exchange between the ranks inside a range and the join with the slots, also where nothing is broadcast."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mix_sources(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        rows = mixed.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join, ranked = plan.index("ShuffledHashJoin"), plan.index("Window [row_number()")
    assert join < ranked and "Exchange" not in plan[join:ranked]
    assert sorted(r["doc_id"] for r in rows) == list(range(300)) and len({(r["slot"], r["place"]) for r in rows}) == 300
