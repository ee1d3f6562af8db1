"""Streaming intake of annotation rows with the same Column expressions as the batch path.

Nothing but the accepted sets, the counts and the diagnostics table is kept, in logs in the shared folder
(:mod:`orthoflow.streaming.log`): no query holds state, and all writes are idempotent per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.operators import intake as K
from orthoflow.operators import relations as R
from orthoflow.streaming.log import KeyedLog

ACCEPTED = "sample_id string, ko_id string"
COUNTS = "sample_id string, status string, n long"


def stream_records(rows: DataFrame) -> DataFrame:
    """Classified records of a stream of detailed annotation rows; stateless."""
    return K.detailed_records(K.parse_detailed(rows))


def accepted_log(spark: SparkSession, path: str, buckets: int = 64, compact_every: int = 16) -> KeyedLog:
    """Accepted (sample, KO) pairs, each once."""
    return KeyedLog(spark, path, "sample_id", lambda rows: rows.select("sample_id", "ko_id").distinct(), buckets, compact_every)


def counts_log(spark: SparkSession, path: str, buckets: int = 64, compact_every: int = 16) -> KeyedLog:
    """Counts per sample and status: each batch adds its own."""
    return KeyedLog(spark, path, "sample_id", lambda rows: rows.groupBy("sample_id", "status").agg(F.sum("n").alias("n")), buckets, compact_every)


def new_pairs(batch: DataFrame, log: KeyedLog, number: int) -> DataFrame:
    """Accepted pairs of a batch that no batch before it has: an anti join with the buckets it touches."""
    pairs = log.bucketed(batch.filter("status = 'accepted'").select("sample_id", "ko_id").distinct())
    touched = [r["bucket"] for r in pairs.select("bucket").distinct().collect()]  # at most as many as there are buckets
    known = log.raw(ACCEPTED, number - 1, touched).select("bucket", "sample_id", "ko_id")
    return pairs.join(known, ["bucket", "sample_id", "ko_id"], "left_anti").drop("bucket")


def store_accepted(records: DataFrame, log: KeyedLog, checkpoint: str):
    """Append each batch's new accepted pairs to the log and stop after the data that is there now."""
    def store(batch: DataFrame, number: int) -> None:
        held = batch.select("sample_id", "ko_id", "status").persist()  # read twice: buckets touched, pairs
        try:
            log.write(new_pairs(held, log, number), number)
        finally:
            held.unpersist()

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_counts(records: DataFrame, log: KeyedLog, checkpoint: str):
    """Write each batch's own counts: only keys that occur in it."""
    def store(batch: DataFrame, number: int) -> None:
        log.write(batch.groupBy("sample_id", "status").agg(F.count("*").alias("n")), number)

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ranked_targets(log: KeyedLog, relations: DataFrame, relationship: str) -> DataFrame:
    """Rankings of what a stream has accepted so far, as the batch path ranks them."""
    return R.rank_targets(R.target_overlap(log.read(ACCEPTED), R.normalized_relations(relations, relationship)))


def append_to(frame: DataFrame, path: str, checkpoint: str):
    """Start an append query into Parquet and stop after the data that is there now."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()


def store_diagnostics(rows: DataFrame, path: str, checkpoint: str):
    """Append every row diagnostic to a table, one folder per micro-batch so a replay replaces it."""
    parsed = K.parse_detailed(rows)

    def store(batch: DataFrame, version: int) -> None:
        K.row_diagnostics(batch, K.detailed_legend()).write.mode("overwrite").parquet(f"{path}/batch={version}")

    return parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def diagnostic_preview(diagnostics: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` diagnostics by source row beside the exact total (a top-n report)."""
    first = diagnostics.orderBy("dataset_id", "row_number", "code", "field").limit(limit).withColumn("one", F.lit(1))
    total = diagnostics.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return first.join(F.broadcast(total), "one").drop("one")
