"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

A source's documents are shuffled by a hash of their ids and cut into pieces of half a block (``block_docs`` rows).
Pieces are the quanta of a proportionate-fair schedule. Slots are cut into *cycles* of ``parts`` slots, which are
scheduled apart from each other:

* **Quotas from cumulative targets.** At the end of every cycle the exact target of each source is a fraction of the
  integer weights; the ends are rounded together (rounded prefix sums), so a source is less than one piece off and the
  sources sum up to the slots. Nothing adds up over the cycles.
* **Releases and deadlines.** With q pieces in a cycle of B slots, piece i (from 0) is released at slot
  floor(i * B / q) and due at slot ceil((i + 1) * B / q). Each slot goes to the released piece with the earliest
  deadline, so inside the cycle a source is less than one piece off its quota's line.

Together a source is less than two pieces, that is one block of an even ``block_docs``, off its exact weight after any
number of slots, however many there are. (With ``block_docs=1`` a piece cannot be halved; the bound is two rows.)

* When a source runs dry the others share the slots by their weights. In the cycle in which that happens its last
  pieces are spread over the cycle.
* A source due less than one slot a cycle is in a *pool*, which is scheduled as one source with the sum of their
  weights until it is empty; inside it piece i has the virtual time (i + 1/2) / weight. So at most ``parts`` sources
  and the pool are in one row, however many sources there are.
* No row is left out or repeated. A document's rank in its source comes from counts of small hash ranges plus a rank
  inside the range, so a source with a third of all rows is spread over 4,096 groups. The slots of a range's pieces are
  brought to the task that ranked it, so whole rows are shuffled once before they are written in order.

Result: the columns of ``docs`` and ``slot`` (the piece's place in the mix, from 0), ``block`` (the piece's number in
the source) and ``place`` (the row's place in the piece). Columns of these names are replaced.

Without weights the targets follow the square root of the sources' sizes. A null source is a source of its
own and can be weighted by the key None. Sources without a positive weight get one slot of ``parts``. Null ids are
ordered first, rows that repeat an id follow each other by their other columns. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.llm.common import materialise, unused
from orthoflow.session import CO_PARTITION_SETTING

BLOCK_DOCS = 8
PARTS = 400
RANGES = 3  # hexadecimal digits of the hash that name a range
ROOT_SCALE = 1 << 20  # default weights are integers in units of 2 ** -20
GIVEN_SCALE = 1 << 40  # given weights are integers out of 2 ** 40
POOL = ""  # the plan's name of the pool; names of sources have a mark in front


def _source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("?"))


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / F.greatest(b, F.lit(1))).cast("long")


def _exact_div(a: Column, b: Column) -> Column:
    """Floor of a / b for decimals without fraction; 0 for a divisor of 0."""
    return F.coalesce(F.call_function("div", a, F.when(b != 0, b)), F.lit(0)).cast("long")


def _wide(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def schedule(quotas: Column) -> Column:
    """The order of one cycle: for every slot the number of the source that gets it and its turn (both from 0), by EDF.

    The fold holds each source's next piece: its turn, release and deadline. Values used more than once are bound
    by a lambda over an array of one element, as a column is evaluated wherever it stands.
    """
    zero = F.lit(0).cast("long")
    n = F.size(quotas).cast("long")

    def piece(turn: Column, q: Column, slots: Column, number: Column) -> Column:
        release = F.when(turn < q, _floor_div(turn * slots, q)).otherwise(slots)
        deadline = _floor_div((turn + 1) * slots + q - 1, q)
        return F.struct(turn.alias("turn"), release.alias("release"), (deadline * n + number).alias("due"), q.alias("q"))  # deadline, then number

    def start(slots: Column) -> Column:
        return F.struct(
            slots.alias("slots"), F.transform(quotas, lambda q, s: piece(zero, q, slots, s.cast("long"))).alias("next"),
            F.array().cast("array<struct<number:int,turn:bigint>>").alias("order"))

    def step(state: Column, t: Column) -> Column:
        def take(chosen: Column) -> Column:
            turn = F.struct(chosen.alias("number"), state["next"][chosen]["turn"].alias("turn"))
            after = F.transform(state["next"], lambda x, s: F.when(
                s == chosen, piece(x["turn"] + 1, x["q"], state["slots"], s.cast("long"))).otherwise(x))
            return F.struct(state["slots"].alias("slots"), after.alias("next"), F.concat(state["order"], F.array(turn)).alias("order"))

        first = F.array_min(F.transform(state["next"], lambda x: F.when(x["release"] <= t, x["due"]))) % n
        return F.transform(F.array(first.cast("int")), take)[0]

    def fold(slots: Column) -> Column:
        return F.aggregate(F.sequence(zero, slots - 1), start(slots), step)["order"]

    return F.transform(F.array(F.aggregate(quotas, zero, lambda a, q: a + q)), fold)[0]


def _weight(weights: dict | None, parts: int) -> Column:
    """The integer weight of a source of ``_n`` rows."""
    if not weights:
        return F.floor(F.sqrt("_n") * ROOT_SCALE + 0.5).cast("long")
    given = {k: float(v) for k, v in weights.items() if v is not None and 0 < float(v) < math.inf}
    total = math.fsum(given.values())
    pairs = [x for k, v in given.items() for x in (
        F.lit("?" if k is None else f"={k}"), F.lit(max(1, math.floor(GIVEN_SCALE * (v / total) + 0.5))))]
    least = F.lit(GIVEN_SCALE // parts).cast("long")
    return F.coalesce(F.create_map(*pairs)[F.col("_key")].cast("long"), least) if pairs else least


def _plan(sources: DataFrame) -> DataFrame:
    """One row: the scheduled sources in the order of their names (at most ``parts``, and the pool first).

    Each has its weight w, its pieces b and the slot d from which on it is dry: those that run dry before it are out
    by then, the others have their weights' shares.
    """
    entries = sources.groupBy(F.when(F.col("_small"), POOL).otherwise(F.col("_key")).alias("key")).agg(
        F.sum("_b").alias("b"), F.sum("_w").alias("w"))
    order = W.orderBy(F.col("b").cast("double") / F.col("w").cast("double"), "key")  # at most ``parts`` rows and the pool
    gone, later = F.sum("b").over(order), F.sum("w").over(W.partitionBy()) - F.sum("w").over(order)
    waits = _exact_div(_wide(later) * _wide(F.col("b")) + F.col("w") - 1, _wide(F.col("w")))
    return entries.withColumn("d", gone + waits).agg(F.array_sort(F.collect_list(F.struct("key", "w", "b", "d"))).alias("listed"))


def _totals(listed: Column, t: Column) -> tuple[Column, Column]:
    """(pieces of the sources dry at slot ``t``, weight of the others)."""
    zero = F.lit(0).cast("long")
    return (F.aggregate(listed, zero, lambda a, s: a + F.when(s["d"] <= t, s["b"]).otherwise(0)),
            F.aggregate(listed, zero, lambda a, s: a + F.when(s["d"] > t, s["w"]).otherwise(0)))


def _ends(listed: Column, t: Column, gone: Column, live: Column) -> Column:
    """Pieces of every listed source before slot ``t``: exact targets, rounded by prefix sums."""
    zero = F.lit(0).cast("long")

    def target(s: Column) -> Column:
        share = _wide(s["w"]) * _wide(t - gone)
        whole = _exact_div(share, _wide(live))
        rest = (share - _wide(whole) * _wide(live)).cast("long")
        return F.when(s["d"] <= t, F.struct(s["b"].alias("whole"), zero.alias("rest"))).otherwise(
            F.struct(whole.alias("whole"), rest.alias("rest")))

    def step(state: Column, x: Column) -> Column:
        rest = state["rest"] + x["rest"]
        up = _half_up(rest, live) - _half_up(state["rest"], live)
        return F.struct(rest.alias("rest"), F.concat(state["ends"], F.array(x["whole"] + up)).alias("ends"))

    start = F.struct(zero.alias("rest"), F.array().cast("array<bigint>").alias("ends"))
    return F.aggregate(F.transform(listed, target), start, step)["ends"]


def _half_up(rest: Column, live: Column) -> Column:
    return _exact_div(_wide(rest * 2 + live), _wide(live * 2))


def _planned_slots(sources: DataFrame, parts: int) -> tuple[DataFrame, bool]:
    """((_key, _block, _slot) of every piece of the listed sources and the pool; whether there is a pool).

    Cycles are dealt to the tasks and need no shuffle: each computes the ends of its own quotas from the one row.
    """
    spark = sources.sparkSession
    plan = materialise(_plan(sources))
    total, pooled = plan.select(
        F.aggregate("listed", F.lit(0).cast("long"), lambda a, s: a + s["b"]), F.exists("listed", lambda s: s["key"] == POOL)).first()
    cycles = -(-total // parts)
    tasks = max(1, min(cycles, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    one = spark.range(0, cycles, 1, tasks).crossJoin(F.broadcast(plan))
    cuts = {"from": F.col("id") * parts, "until": F.least((F.col("id") + 1) * parts, F.lit(total).cast("long"))}
    one = one.select("id", "listed", *(t.alias(c) for c, t in cuts.items()))
    one = one.select("*", *(x.alias(f"{c}_{n}") for c in cuts for x, n in zip(_totals(F.col("listed"), F.col(c)), ("gone", "live"))))
    one = one.select("id", "listed", *(
        _ends(F.col("listed"), F.col(c), F.col(f"{c}_gone"), F.col(f"{c}_live")).alias(n) for c, n in (("from", "a"), ("until", "z"))))
    turns = F.filter(F.transform("listed", lambda s, i: F.struct(
        s["key"].alias("key"), F.col("a")[i].alias("first"), (F.col("z")[i] - F.col("a")[i]).alias("q"))), lambda x: x["q"] > 0)
    one = one.select("id", turns.alias("turns"))
    dealt = one.select("id", "turns", F.posexplode(schedule(F.transform("turns", lambda x: x["q"]))).alias("at", "got"))
    own = F.col("turns")[F.col("got.number")]
    return dealt.select(own["key"].alias("_key"), (own["first"] + F.col("got.turn")).alias("_block"), (F.col("id") * parts + F.col("at")).alias("_slot")), pooled


def _pool_order(pieces: DataFrame) -> DataFrame:
    """(_key, _block, _turn) of the pool's pieces, numbered by virtual time; ``pieces``: _key, _block, _w."""
    order = ["_time", "_key", "_block"]
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = pieces.select(((F.col("_block") * 2 + 1) / F.col("_w")).alias("_time"), "_key", "_block").repartitionByRange(n, *order)
    numbered = materialise(sorted_.sortWithinPartitions(*order).select("_key", "_block", F.monotonically_increasing_id().alias("_id")))
    numbered = numbered.select("_key", "_block", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = numbered.groupBy("_part").agg(F.count("*").alias("_many")).select(
        "_part", F.coalesce(F.sum("_many").over(before), F.lit(0)).cast("long").alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").select("_key", "_block", (F.col("_start") + F.col("_at")).alias("_turn"))


def _slots(offsets: DataFrame, counts: DataFrame, weights: dict | None, parts: int, piece: int) -> DataFrame:
    """(_key, _block, _slot) of every piece. ``offsets``: _key, _n rows and _first rank of every range."""
    rated = counts.select("_key", _floor_div(F.col("_n") + piece - 1, F.lit(piece)).alias("_b"), _weight(weights, parts).alias("_w"))
    total = rated.agg(F.sum("_w").alias("_total"))
    sources = materialise(rated.crossJoin(F.broadcast(total)).select(
        "_key", "_b", "_w", (F.col("_w") * parts < F.col("_total")).alias("_small")))
    slots, pooled = _planned_slots(sources, parts)
    if not pooled:
        return slots
    low, high = _floor_div(F.col("_first") + piece - 1, F.lit(piece)), _floor_div(F.col("_first") + F.col("_n") - 1, F.lit(piece))
    small = sources.filter("_small").select("_key", "_w")
    pieces = offsets.join(small, "_key").filter(low <= high).select("_key", "_w", F.explode(F.sequence(low, high)).alias("_block"))
    mine = slots.filter(F.col("_key") == POOL).select(F.col("_block").alias("_turn"), "_slot")
    return slots.filter(F.col("_key") != POOL).unionByName(_pool_order(pieces).join(mine, "_turn").drop("_turn"))


def mix_sources(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, parts: int = PARTS) -> DataFrame:
    """``docs`` (doc_id, source, any others) with slot, block and place in the mix."""
    piece = (block_docs + 1) // 2
    columns = [c for c in docs.columns if c.lower() not in ("slot", "block", "place")]
    key, hashed, ranged, rank, first, block, slot = (
        unused(docs, c) for c in ("_key", "_hash", "_range", "_rank", "_first", "_block", "_slot"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(*columns, _source_key("source").alias(key), F.md5(id_text.cast("binary")).alias(hashed)).withColumn(
        ranged, F.substring(hashed, 1, RANGES))
    ranges = materialise(rows.groupBy(F.col(key).alias("_key"), F.col(ranged).alias("_range")).agg(F.count("*").alias("_n")))
    below = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # 16 ** RANGES rows at most
    offsets = ranges.select("_key", "_range", "_n", F.coalesce(F.sum("_n").over(below), F.lit(0)).cast("long").alias("_first"))
    kinds = dict(docs.dtypes)
    ties = [F.col(c) for c in columns if c not in ("doc_id", "source") and "map<" not in kinds[c] and "variant" not in kinds[c]]
    inside = W.partitionBy(key, ranged).orderBy(hashed, F.col("doc_id").asc_nulls_first(), *ties)
    starts = offsets.select(F.col("_key").alias(key), F.col("_range").alias(ranged), F.col("_first").alias(first))
    ranked = rows.withColumn(rank, F.row_number().over(inside) - 1).join(starts, [key, ranged]).withColumn(rank, F.col(rank) + F.col(first))
    slots = _slots(offsets, ranges.groupBy("_key").agg(F.sum("_n").alias("_n")), weights, parts, piece)
    pieces = F.sequence(_floor_div(F.col("_first"), F.lit(piece)), _floor_div(F.col("_first") + F.col("_n") - 1, F.lit(piece)))
    held = offsets.select("_key", "_range", F.explode(pieces).alias("_block")).join(slots, ["_key", "_block"]).select(
        F.col("_key").alias(key), F.col("_range").alias(ranged), F.col("_block").alias(block), F.col("_slot").alias(slot))
    docs.sparkSession.conf.set(CO_PARTITION_SETTING, "false")  # the rows stay where their range was ranked
    return ranked.withColumn(block, _floor_div(F.col(rank), F.lit(piece))).join(held.hint("shuffle_hash"), [key, ranged, block]).select(
        *columns, F.col(slot).alias("slot"), F.col(block).alias("block"), (F.col(rank) - F.col(block) * piece).cast("long").alias("place"))
