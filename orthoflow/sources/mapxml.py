"""Map graphics from XML: boxes and polylines that carry KO ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.functions.staging import computed
from orthoflow.operators.spread import PART, copied, sets_of

# Element attributes, largest coordinate.
ENTRY_SCHEMA = (
    "_id string, _name string, graphics array<struct<_type:string,_x:string,_y:string,_width:string,_height:string,_coords:string>>"
)
BOX_TYPES = ("rectangle", "roundrectangle")
MAX_COORDINATE = 1_000_000
COORDINATE = r"^[0-9]{1,300}$"


def read_map_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entry elements of map files through the XML reader, with the file they come from."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1).alias("pathway_id"), "*")


def parse_entry_texts(texts: DataFrame) -> DataFrame:
    """Entry elements held as text (``pathway_id, entry_xml``)."""
    return texts.select("pathway_id", F.from_xml("entry_xml", ENTRY_SCHEMA).alias("e")).select("pathway_id", "e.*")


def _number(col: Column, largest: int | None) -> Column:
    value = F.when(col.rlike(COORDINATE), col.cast("double"))
    return value if largest is None else F.when(value <= largest, value)


def graphics(entries: DataFrame, largest: int | None = MAX_COORDINATE) -> DataFrame:
    """One row per usable shape of a KO entry; ``fault`` marks malformed ones.

    A coordinate is at most ``largest`` (None: any whole number).
    """
    tokens = F.filter(F.split("_name", r"\s+"), lambda t: t.rlike(r"^ko:K[0-9]{5}$"))
    ko_ids = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.substring(t, 4, 6))))
    with_kos = computed(entries, ko_ids=ko_ids).filter("size(ko_ids) > 0").select(
        "pathway_id", F.col("_id").try_cast("int").alias("entry_id"), "ko_ids", F.explode("graphics").alias("g"))
    shapes = with_kos.filter(F.col("g._type").isin("line", *BOX_TYPES)).withColumn(
        "kind", F.when(F.col("g._type") == "line", F.lit("polyline")).otherwise(F.lit("box")))
    values = F.transform(F.split(F.coalesce("g._coords", F.lit("")), ","), lambda c: _number(c, largest))
    points = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("values") / 2) - 1, F.lit(0)).cast("int")),
                         lambda i: F.struct(F.get("values", i * 2).alias("x"), F.get("values", i * 2 + 1).alias("y")))
    listed = computed(computed(shapes, values=values), points=points)
    steps = F.transform(F.slice("points", F.lit(2), F.size("points")), lambda p, i: F.hypot(
        p["x"] - F.get("points", i)["x"], p["y"] - F.get("points", i)["y"]))
    length = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + F.coalesce(s, F.lit(0.0)))
    line = F.col("kind") == "polyline"
    x, y, width, height = (_number(F.col(f"g._{name}"), largest) for name in ("x", "y", "width", "height"))
    staged = computed(listed, x=F.when(~line, x), y=F.when(~line, y), width=F.when(~line, width), height=F.when(~line, height),
                      length=F.when(line, length))
    fault = (
        F.when(F.col("entry_id").isNull() | (F.col("entry_id") < 0), F.lit("invalid_entry_id"))
        .when(line & ((F.size("values") < 4) | (F.size("values") % 2 == 1)), F.lit("uneven_coordinates"))
        .when(line & F.exists("values", lambda v: v.isNull()), F.lit("invalid_coordinate"))
        .when(line & (F.col("length") <= 0), F.lit("degenerate_line"))
        .when(~line & (F.col("x").isNull() | F.col("y").isNull()), F.lit("invalid_coordinate"))
        .when(~line & ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), F.lit("invalid_size")))
    return staged.select("pathway_id", "entry_id", "kind", "ko_ids", "x", "y", "width", "height",
                         F.when(line, F.col("points")).alias("points"), fault.alias("fault"))


def overlay(shapes: DataFrame, accepted: DataFrame, key: str = "sample_id", requests: DataFrame | None = None) -> DataFrame:
    """Shapes that carry at least one accepted KO, per set and pathway with their accepted KOs.

    With ``requests`` (key, pathway_id) only the requested pairs are formed.
    """
    kos = shapes.filter("fault is null").select("pathway_id", "entry_id", "kind", F.explode("ko_ids").alias("ko_id")).distinct()
    if requests is None:
        pairs = kos.join(accepted, "ko_id")
    else:
        pairs = requests.select(key, "pathway_id").distinct().join(kos, "pathway_id").join(accepted, [key, "ko_id"])
    return pairs.groupBy(key, "pathway_id", "entry_id", "kind").agg(
        F.array_sort(F.collect_set("ko_id")).alias("accepted_kos"))


def overlay_counts(shapes: DataFrame, accepted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Shapes of each set, pathway and kind that carry an accepted KO, and their accepted KOs in all (``shapes, ko_links``).

    The counts of :func:`overlay` over every shape, map and set, without its rows: shapes with the same KOs are counted first,
    a set finds how many KOs of each such group it has accepted, and the groups' counts are added up, all in the task that
    holds the set. ``accepted`` may hold repeated rows.
    """
    groups = shapes.filter("fault is null").select("pathway_id", "entry_id", "kind", F.explode("ko_ids").alias("ko_id")).groupBy(
        "pathway_id", "entry_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("ko_id")), ";").alias("kos"))
    counted = groups.groupBy("kos", "pathway_id", "kind").agg(F.count("*").cast("int").alias("n")).groupBy("kos").agg(
        F.collect_list(F.struct("pathway_id", "kind", "n")).alias("places"))
    listed = counted.select("kos", *[F.col(f"places.{name}").alias(f"{name}s") for name in ("pathway_id", "kind", "n")])  # half the bytes of structs
    members = groups.select("kos").distinct().select(F.explode(F.split("kos", ";")).alias("ko_id"), "kos").groupBy("ko_id").agg(
        F.collect_list("kos").alias("groups"))
    mine = sets_of(accepted, key, "ko_id").select(PART, key, F.explode("members").alias("ko_id"))
    hits = mine.join(copied(members), [PART, "ko_id"]).select(PART, key, F.explode("groups").alias("kos")).groupBy(PART, key, "kos").agg(F.count("*").alias("k"))
    placed = hits.join(copied(listed), [PART, "kos"]).select(PART, key, "k", F.inline(F.arrays_zip("pathway_ids", "kinds", "ns"))).toDF(
        PART, key, "k", "pathway_id", "kind", "n")
    return placed.groupBy(PART, key, "pathway_id", "kind").agg(F.sum("n").alias("shapes"), F.sum(F.col("n") * F.col("k")).alias("ko_links")).drop(PART)


def out_of_bounds(shapes: DataFrame, images: DataFrame) -> DataFrame:
    """Shapes that leave their image rectangle (``pathway_id, image_width, image_height``)."""
    box = ((F.col("x") - F.col("width") / 2 < 0) | (F.col("y") - F.col("height") / 2 < 0)
           | (F.col("x") + F.col("width") / 2 > F.col("image_width")) | (F.col("y") + F.col("height") / 2 > F.col("image_height")))
    line = F.exists("points", lambda p: (p["x"] > F.col("image_width")) | (p["y"] > F.col("image_height")))
    return shapes.filter("fault is null").join(images, "pathway_id").filter(F.when(F.col("kind") == "box", box).otherwise(line))
