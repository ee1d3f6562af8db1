"""Parts of flat-file entries as Column expressions.

An entry is one row with ``fields``: an ordered array of struct<name, indent, lines>. Entries are
single reference records of bounded size, so arrays inside one row are the natural shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow.functions.staging import bound
from orthoflow.functions.text import strip, unique_items

# Patterns inside entry text, fields each kind reads.
EC_NUMBER = r"^[0-9]+(?:\.(?:[0-9]+|-)){3}$"
EC_BLOCK = r"\[EC:([^\]]+)\]"
PMID = r"\bPMID:\s*([0-9]+)\b"
REACTION_ID = r"\bR[0-9]{5}\b"
COMPOUND_ID = r"\bC[0-9]{5}\b"
GLYCAN_ID = r"\bG[0-9]{5}\b"
PATHWAY_REFERENCE = r"^[a-z][a-z0-9]{1,7}[0-9]{5}$"
TAXONOMY_ID = r"^(?:TAX:|taxid:)?([0-9]+)$"
KINDS = ("ko", "module", "pathway", "reaction", "enzyme", "compound", "glycan", "gene", "genome")
COMMON_FIELDS = ("ENTRY", "NAME", "DEFINITION", "CLASS", "DBLINKS", "REFERENCE", "AUTHORS", "TITLE", "JOURNAL")
KIND_FIELDS = {
    "ko": ("MODULE", "PATHWAY", "ENZYME"),
    "module": ("DESCRIPTION", "DEFINITION", "ORTHOLOGY", "CLASS", "PATHWAY", "REACTION", "COMPOUND"),
    "pathway": ("MODULE", "ORTHOLOGY", "REACTION", "COMPOUND", "GLYCAN"),
    "reaction": ("EQUATION", "ENZYME", "ORTHOLOGY", "RCLASS", "COMMENT"),
    "enzyme": ("SYSNAME", "REACTION", "ALL_REAC", "SUBSTRATE", "PRODUCT", "ORTHOLOGY", "COMMENT"),
    "compound": ("FORMULA", "EXACT_MASS", "MOL_WEIGHT", "REACTION", "PATHWAY", "ENZYME"),
    "glycan": ("COMPOSITION", "MASS", "REACTION", "PATHWAY", "ENZYME"),
    "gene": ("SYMBOL", "ORTHOLOGY", "ORGANISM", "POSITION", "MOTIF", "PATHWAY", "MODULE", "NETWORK", "STRUCTURE"),
    "genome": ("ORG_CODE", "CATEGORY", "ANNOTATION", "TAXONOMY", "LINEAGE", "DATA_SOURCE", "ORIGINAL_DB", "STATISTICS"),
}

FIELDS = "fields"


def field_lines(name: str, fields: Column | None = None) -> Column:
    """Trimmed non-blank lines of a top-level field, over all its occurrences."""
    fields = F.col(FIELDS) if fields is None else fields
    top = F.filter(fields, lambda f: (f["indent"] == 0) & (f["name"] == name))
    return F.filter(F.transform(F.flatten(F.transform(top, lambda f: f["lines"])), strip), lambda line: line != "")


def joined_field(name: str) -> Column:
    """Lines of a field joined by one space; NULL when there are none."""
    return bound(F.array_join(field_lines(name), " "), lambda text: F.nullif(text, F.lit("")))


def names() -> Column:
    parts = F.flatten(F.transform(field_lines("NAME"), lambda line: F.split(line, ";")))
    return unique_items(parts)


def all_matches(texts: Column, pattern: str, group: int = 0) -> Column:
    """All matches in an array of texts, first seen first, without repeats."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group)))))


def references(name: str, pattern: str) -> Column:
    """Leading ids of each line up to the first token that is no id, as struct<identifier, label>.

    A label is kept only for a line with exactly one id; the first occurrence of an id wins.
    """
    def of_line(line: Column, tokens: Column) -> Column:
        def upto(first_bad: Column) -> Column:
            return F.when(first_bad == 0, tokens).otherwise(F.slice(tokens, 1, F.greatest(first_bad - 1, F.lit(0)).cast("int")))

        def labelled(ids: Column) -> Column:
            label = F.when(F.size(ids) == 1, bound(strip(F.substr(line, F.length(ids[0]) + 1)), lambda t: F.nullif(t, F.lit(""))))
            return F.transform(ids, lambda i: F.struct(i.alias("identifier"), label.alias("label")))

        return bound(bound(F.array_position(F.transform(tokens, lambda t: ~t.rlike(pattern)), True), upto), labelled)

    def first_seen(found: Column) -> Column:
        return bound(identifiers(found), lambda ids: F.filter(found, lambda r, i: F.array_position(ids, r["identifier"]) == i + 1))

    cut = F.transform(field_lines(name), lambda line: F.struct(
        line.alias("line"), F.filter(F.split(line, r"[\s,;+]+"), lambda t: t != "").alias("tokens")))
    return bound(F.flatten(F.transform(cut, lambda c: of_line(c["line"], c["tokens"]))), first_seen)


def identifiers(refs: Column) -> Column:
    return F.transform(refs, lambda r: r["identifier"])


def cross_references() -> Column:
    """DBLINKS as distinct struct<database, identifier> in first-seen order."""
    def of_line(line: Column) -> Column:
        database = strip(F.substring_index(line, ":", 1))
        rest = F.regexp_replace(line, r"^[^:]*:", "")
        ids = F.filter(F.transform(F.split(strip(rest), r"\s+"), lambda t: F.regexp_replace(t, r"[,;]+$", "")), lambda t: t != "")
        return F.transform(ids, lambda i: F.struct(database.alias("database"), i.alias("identifier")))

    usable = F.filter(field_lines("DBLINKS"), lambda line: line.rlike(r"^\s*[^:\s][^:]*:"))
    return F.array_distinct(F.flatten(F.transform(usable, of_line)))


def pubmed_ids() -> Column:
    lines = F.flatten(F.transform(F.filter(F.col(FIELDS), lambda f: f["name"] == "REFERENCE"), lambda f: f["lines"]))
    return all_matches(lines, PMID, 1)


def ec_numbers(texts: Column) -> Column:
    """EC numbers of ``[EC:...]`` blocks and of plain tokens, unique in first-seen order."""
    def of_text(text: Column) -> Column:
        blocks = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(EC_BLOCK), F.lit(1)), lambda b: F.split(strip(b), r"\s+")))
        plain = F.split(strip(F.translate(text, ";", " ")), r"\s+")
        return F.concat(blocks, plain)

    tokens = F.transform(F.flatten(F.transform(texts, of_text)), lambda t: F.btrim(t, F.lit("[],;")))
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike(EC_NUMBER)))


def ids_in_text(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def organism_code_from_text(text: Column) -> Column:
    """First token of a match text when it is an organism code, else NULL."""
    from orthoflow.functions.identifiers import is_organism_code

    token = F.regexp_replace(F.regexp_extract(text, r"^\s*(\S+)", 1), r"[;,|]+$", "")
    return F.when(is_organism_code(token), token)
