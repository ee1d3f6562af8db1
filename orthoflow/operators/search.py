"""Candidate search over a local reference table (database, identifier, text, formula, mass).

Tables that are searched often can be written in a layout of their own: postings of letter triples for keywords,
and entries sorted by mass. Both are range-clustered, so file statistics let a search skip what it does not need;
results are those of the plain search.
"""

from __future__ import annotations

from decimal import Decimal
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Formula and mass query syntax, databases with chemical search.
FORMULA_QUERY = r"(?:[A-Z][a-z]?(?:[1-9][0-9]*)?)+"
MASS_VALUE = r"(?:0|[1-9][0-9]{0,19})(?:\.[0-9]{1,12})?"
CHEMICAL_DATABASES = ("compound", "drug")
SEARCH_DATABASES = ("ko", "pathway", "module", "reaction", "enzyme", "compound", "glycan", "drug", "rclass", "genome", "organism")


def search_keyword(entries: DataFrame, database: str, keyword: str) -> DataFrame:
    """Entries whose text contains every word of the keyword; no score and no best match."""
    if database not in SEARCH_DATABASES or not keyword.strip():
        raise ValueError("unknown database or blank keyword")
    hits = entries.filter(F.col("database") == ("genome" if database == "organism" else database))
    for word in keyword.split():
        hits = hits.filter(F.contains(F.lower("text"), F.lit(word.lower())))
    return hits


GRAM = 3


def grams_of(text: Column) -> Column:
    """Distinct runs of three characters."""
    n = F.length(text) - (GRAM - 1)
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(GRAM))))


def write_postings(entries: DataFrame, path: str) -> None:
    """(database, gram, identifier) in the order of grams, and how many entries of a database have each gram.

    A frequent gram spreads over several files, as identifiers are part of the order.
    """
    rows = entries.select("database", F.explode(grams_of(F.lower("text"))).alias("gram"), "identifier").distinct()
    order = ["gram", "database", "identifier"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    written = entries.sparkSession.read.parquet(f"{path}/postings")  # distinct rows in the order of grams: not formed again
    counts = written.groupBy("database", "gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def posting_rows(spark: SparkSession, path: str, database: str, keyword: str) -> DataFrame | None:
    """Postings of the rarest gram of each word; None where no word has three characters.

    Counts are looked up for the keyword's own grams only. A gram that no entry has leaves no rows.
    """
    name = "genome" if database == "organism" else database
    words = [w.lower() for w in keyword.split() if len(w.lower()) >= GRAM]
    if not words:
        return None
    own = {w: sorted({w[i:i + GRAM] for i in range(len(w) - GRAM + 1)}) for w in words}
    counts = spark.read.parquet(f"{path}/grams").filter((F.col("database") == name) & F.col("gram").isin(sorted({g for gs in own.values() for g in gs})))
    known = {r["gram"]: r["n"] for r in counts.collect()}  # one row per gram of the keyword
    rarest = sorted({min(gs, key=lambda g: (known.get(g, 0), g)) for gs in own.values()})
    return spark.read.parquet(f"{path}/postings").filter((F.col("database") == name) & F.col("gram").isin(rarest)).withColumn("wanted", F.lit(len(rarest)))


def search_postings(entries: DataFrame, path: str, database: str, keyword: str) -> DataFrame:
    """As ``search_keyword``, over the entries that the postings of ``path`` leave."""
    found = posting_rows(entries.sparkSession, path, database, keyword)
    if found is None:
        return search_keyword(entries, database, keyword)
    holders = found.groupBy("database", "identifier", "wanted").agg(F.count("*").alias("n")).filter("n = wanted").select("database", "identifier")
    return search_keyword(entries.join(holders, ["database", "identifier"], "left_semi"), database, keyword)


def search_formula(entries: DataFrame, database: str, formula: str) -> DataFrame:
    _require_chemical(database)
    if re.fullmatch(FORMULA_QUERY, formula) is None:
        raise ValueError("not a molecular formula")
    return entries.filter((F.col("database") == database) & F.col("formula").contains(formula))


MASS_TYPE = "decimal(33,12)"
MASS_PLACES = 12


def write_by_mass(entries: DataFrame, path: str, column: str = "exact_mass") -> None:
    """Entries sorted by database and mass, so a range reads the files and row groups that overlap it. Null masses come first."""
    order = ["database", column]
    entries.withColumn(column, F.col(column).cast(MASS_TYPE)).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def search_mass(entries: DataFrame, database: str, query: str, column: str = "exact_mass") -> DataFrame:
    """One positive decimal or an ordered ``low-high`` range, compared as DECIMAL(33,12).

    A single value matches masses that round to it at its own number of decimals: those from half a unit of the last
    one below it up to half a unit above. Both forms are ranges, which reach the scan of a table that holds masses in
    that type (``write_by_mass``).
    """
    _require_chemical(database)
    match = re.fullmatch(f"({MASS_VALUE})(?:-({MASS_VALUE}))?", query)
    if match is None:
        raise ValueError("not a mass or mass range")
    low, high = match.group(1), match.group(2)
    stored = entries.schema[column].dataType.simpleString() == MASS_TYPE
    mass = F.col(column) if stored else F.col(column).cast(MASS_TYPE)
    bound = lambda value: F.lit(Decimal(value)).cast(MASS_TYPE)
    hits = entries.filter(F.col("database") == database)
    if high is None:
        if Decimal(low) <= 0:
            raise ValueError("mass must be positive")
        places = len(low.partition(".")[2])
        if places >= MASS_PLACES:
            return hits.filter(mass == bound(low))
        half = Decimal(5).scaleb(-places - 1)
        return hits.filter((mass >= bound(Decimal(low) - half)) & (mass < bound(Decimal(low) + half)))
    if Decimal(low) <= 0 or Decimal(high) < Decimal(low):
        raise ValueError("mass range must be positive and ordered")
    return hits.filter((mass >= bound(low)) & (mass <= bound(high)))


def _require_chemical(database: str) -> None:
    if database not in CHEMICAL_DATABASES:
        raise ValueError("chemical search is for compound or drug")


def candidate_limit(candidates: DataFrame, limit: int, order: str, *by: str) -> DataFrame:
    """First ``limit`` candidates of each query in source order, with the observed count.

    Spark keeps at most ``limit`` rows per group before the shuffle, and the total is a separate
    partial aggregate, so a query that matches most of the table stays cheap.
    """
    ranked = candidates.withColumn("candidate_no", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(
        F.col("candidate_no") <= limit)
    totals = candidates.groupBy(*by).agg(F.count("*").alias("observed"))
    return ranked.join(totals, list(by)).withColumn("truncated", F.col("observed") > limit)
