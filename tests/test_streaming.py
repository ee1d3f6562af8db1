"""A stream gives the same records, accepted sets, counts and rankings as the batch path, over batches, restarts and replays."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.operators import intake as K
from orthoflow.operators import relations as R
from orthoflow.streaming import intake as ST
from orthoflow.streaming.log import KeyedLog

SCHEMA = "dataset_id string, sample_id string, row_number long, name string, predict_label string, probability string, threshold string, annotate string"


def rows_of(start, n):
    return [("d", f"s{i % 3}", i, f"p{i}", ["K00001", f"K{i % 50:05d} + K00003", "bad", ""][i % 4], f"0.{i % 10}", "0.5", "*" if i % 5 == 0 else "") for i in range(start, start + n)]


def base_folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def accepted_of(records):
    return sorted(tuple(r) for r in records.filter("status = 'accepted'").select("sample_id", "ko_id").distinct().collect())


def test_batches_restart_and_ranking(spark):
    """Several micro-batches, a restart with new files, and a ranking from the log."""
    base = base_folder()
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    pairs, counts = ST.accepted_log(spark, f"{base}/pairs", buckets=4, compact_every=3), ST.counts_log(spark, f"{base}/counts", buckets=4, compact_every=3)
    everything = []
    for start in (0, 150):
        everything += rows_of(start, 150)
        spark.createDataFrame(rows_of(start, 150), SCHEMA).repartition(2).write.mode("append").parquet(f"{base}/in")
        ST.store_accepted(ST.stream_records(read()), pairs, f"{base}/c1").awaitTermination()
        ST.store_counts(ST.stream_records(read()), counts, f"{base}/c2").awaitTermination()
        records = K.detailed_records(K.parse_detailed(spark.createDataFrame(everything, SCHEMA)))
        assert sorted(tuple(r) for r in pairs.read(ST.ACCEPTED).collect()) == accepted_of(records)
        wanted = sorted((r.sample_id, r.status, r["count"]) for r in records.groupBy("sample_id", "status").count().collect())
        assert sorted((r.sample_id, r.status, r.n) for r in counts.read(ST.COUNTS).collect()) == wanted
    assert [n for kind, n in pairs.folders() if kind == "delta"] == [0, 1, 2, 3] and ("base", 2) in pairs.folders()
    # Every pair was written once: later batches hold new ones only.
    raw = reduce(DataFrame.unionByName, [spark.read.parquet(f"{base}/pairs/delta-{n}") for n in range(4)])
    assert raw.count() == raw.select("sample_id", "ko_id").distinct().count()
    relations = spark.createDataFrame([("ko_to_pathway", f"ko:K{k:05d}", f"path:ko{k % 7:05d}", 0, k) for k in range(50)],
                                      "relationship string, source_id string, target_id string, batch_index long, line_number long")
    accepted = records.filter("status = 'accepted'").select("sample_id", "ko_id").distinct()
    batch = R.rank_targets(R.target_overlap(accepted, R.normalized_relations(relations, "ko_to_pathway")))
    columns = ["sample_id", "target_id", "rank", "detected_kos"]
    assert sorted(map(tuple, ST.ranked_targets(pairs, relations, "ko_to_pathway").select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_replays_compaction_and_vacuum(spark):
    base = base_folder()
    counts = ST.counts_log(spark, base, buckets=3, compact_every=2)
    batch = lambda n: spark.createDataFrame([("s1", "accepted", n), (f"s{n}", "invalid", 1)], ST.COUNTS)
    for n in range(5):
        counts.write(batch(n), n)
    wanted = sorted((r.sample_id, r.status, r.n) for r in counts.read(ST.COUNTS).collect())
    assert ("s1", "accepted", 10) in wanted and len(wanted) == 6
    counts.write(batch(4), 4)  # the same batch again
    assert sorted((r.sample_id, r.status, r.n) for r in counts.read(ST.COUNTS).collect()) == wanted
    assert [p.rsplit("/", 1)[1] for p in counts.live()] == ["base-3", "delta-4"]
    assert [p.rsplit("/", 1)[1] for p in counts.live(2)] == ["base-1", "delta-2"]
    assert counts.raw(ST.COUNTS, buckets=[0]).filter("bucket <> 0").isEmpty()
    assert counts.vacuum() == 2 and sorted((r.sample_id, r.status, r.n) for r in counts.read(ST.COUNTS).collect()) == wanted
    assert ST.counts_log(spark, f"{base}/none").read(ST.COUNTS).count() == 0
    empty = KeyedLog(spark, f"{base}/empty", "k", lambda rows: rows)
    empty.write(spark.createDataFrame([], "k string, v long"), 0)
    assert empty.read("k string, v long").count() == 0


def test_replayed_batch_does_not_see_itself(spark):
    """A batch that is run again finds the same new pairs, though its own rows are there already."""
    base = base_folder()
    log = ST.accepted_log(spark, base, buckets=2)
    rows = lambda *kos: spark.createDataFrame([("s", k, "accepted") for k in kos], "sample_id string, ko_id string, status string")
    log.write(ST.new_pairs(rows("K1", "K2"), log, 0), 0)
    for _ in range(2):
        fresh = ST.new_pairs(rows("K2", "K3"), log, 1)
        assert [r["ko_id"] for r in fresh.collect()] == ["K3"]
        log.write(fresh, 1)
    assert sorted(r["ko_id"] for r in log.read(ST.ACCEPTED).collect()) == ["K1", "K2", "K3"]


def test_diagnostics_are_stored_once(spark):
    base = base_folder()
    batch = spark.createDataFrame(rows_of(0, 100), SCHEMA)
    batch.write.parquet(f"{base}/in")
    ST.store_diagnostics(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), f"{base}/diagnostics", f"{base}/c3").awaitTermination()
    stored = spark.read.parquet(f"{base}/diagnostics")
    assert stored.count() == K.row_diagnostics(K.parse_detailed(batch), K.detailed_legend()).count()
    assert ST.diagnostic_preview(stored, 3).count() == 3
    ST.append_to(ST.stream_records(spark.readStream.schema(SCHEMA).parquet(f"{base}/in")).select("row_number", F.col("ko_id")), f"{base}/records", f"{base}/c4").awaitTermination()
    assert spark.read.parquet(f"{base}/records").count() == K.detailed_records(K.parse_detailed(batch)).count()
