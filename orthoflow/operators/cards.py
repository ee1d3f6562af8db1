"""Typed entry cards, their relationships, previews and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.functions import entries as E
from orthoflow.functions.staging import computed
from orthoflow.functions.text import strip, unique_items

KO, MODULE, REACTION = r"^K[0-9]{5}$", r"^M[0-9]{5}$", r"^R[0-9]{5}$"
COMPOUND, GLYCAN, RCLASS = r"^C[0-9]{5}$", r"^G[0-9]{5}$", r"^RC[0-9]{5}$"
# List fields of each kind in reporting order, with the relationship and target they state.
LIST_FIELDS = {
    "ko": (("ec_numbers", "ec_number", "enzyme"), ("modules", "module", "module"), ("pathways", "pathway", "pathway")),
    "module": (("pathways", "pathway", "pathway"), ("reactions", "reaction", "reaction"),
               ("referenced_modules", "referenced_module", "module"), ("ko_components", "ko_component", "ko")),
    "pathway": (("ko_identifiers", "ko", "ko"), ("modules", "module", "module"), ("reactions", "reaction", "reaction"),
                ("compounds", "compound", "compound"), ("glycans", "glycan", "glycan")),
    "reaction": (("enzyme_ids", "enzyme", "enzyme"), ("ko_identifiers", "ko", "ko"), ("rclass_ids", "rclass", "rclass"),
                 ("compound_ids", "compound", "compound"), ("glycan_ids", "glycan", "glycan")),
    "enzyme": (("reaction_ids", "reaction", "reaction"), ("ko_identifiers", "ko", "ko")),
    "compound": (("reactions", "reaction", "reaction"), ("pathways", "pathway", "pathway")),
    "glycan": (("reactions", "reaction", "reaction"), ("pathways", "pathway", "pathway")),
    "gene": (("orthology", "orthology", "ko"), ("pathways", "pathway", "pathway")),
    "genome": (("lineage", None, None),),
}
TEXT_FIELDS = {
    "reaction": {"equation": "EQUATION"},
    "compound": {"formula": "FORMULA", "exact_mass": "EXACT_MASS", "molecular_weight": "MOL_WEIGHT"},
    "glycan": {"composition": "COMPOSITION", "mass": "MASS"},
    "gene": {"position": "POSITION"},
}


def _plain(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("identifier"), F.lit(None).cast("string").alias("label")))


def _list_columns(kind: str) -> dict[str, Column]:
    """Each list field of a kind as array<struct<identifier, label>>."""
    pathways = lambda: E.references("PATHWAY", E.PATHWAY_REFERENCE)
    reactions = lambda: E.references("REACTION", REACTION)
    bare = lambda refs: _plain(E.identifiers(refs))
    orthology = lambda: E.references("ORTHOLOGY", KO)
    if kind == "ko":
        texts = F.concat(F.array_compact(F.array(E.joined_field("DEFINITION"))), E.field_lines("ENZYME"))
        return {"ec_numbers": _plain(E.ec_numbers(texts)), "modules": E.references("MODULE", MODULE), "pathways": pathways()}
    if kind == "module":
        return {"pathways": pathways(), "reactions": reactions(), **definition_members(E.joined_field("DEFINITION"))}
    if kind == "pathway":
        return {"ko_identifiers": bare(orthology()), "modules": E.references("MODULE", MODULE), "reactions": reactions(),
                "compounds": E.references("COMPOUND", COMPOUND), "glycans": E.references("GLYCAN", GLYCAN)}
    if kind == "reaction":
        equation = E.joined_field("EQUATION")
        return {"enzyme_ids": _plain(E.ec_numbers(E.field_lines("ENZYME"))), "ko_identifiers": bare(orthology()),
                "rclass_ids": bare(E.references("RCLASS", RCLASS)), "compound_ids": _plain(E.ids_in_text(equation, E.COMPOUND_ID)),
                "glycan_ids": _plain(E.ids_in_text(equation, E.GLYCAN_ID))}
    if kind == "enzyme":
        lines = F.concat(E.field_lines("REACTION"), E.field_lines("ALL_REAC"))
        return {"reaction_ids": _plain(E.all_matches(lines, E.REACTION_ID)), "ko_identifiers": bare(orthology())}
    if kind in ("compound", "glycan"):
        return {"reactions": reactions(), "pathways": pathways()}
    if kind == "gene":
        return {"orthology": orthology(), "pathways": pathways()}
    return {"lineage": _plain(unique_items(F.split(F.coalesce(E.joined_field("LINEAGE"), F.lit("")), ";")))}


def definition_members(definition: Column) -> dict[str, Column]:
    """Referenced modules and member KOs named by whole tokens of a definition text."""
    tokens = F.split(F.coalesce(definition, F.lit("")), r"[\s,+()-]+")
    return {"referenced_modules": _plain(F.array_distinct(F.filter(tokens, lambda t: t.rlike(MODULE)))),
            "ko_components": _plain(F.array_distinct(F.filter(tokens, lambda t: t.rlike(KO))))}


def build_cards(entries: DataFrame, kind: str, *keys: str) -> DataFrame:
    """Cards of one kind: common columns, ``lists`` by field name and ``texts`` by field name.

    ``entries`` holds parsed entries of this kind (``fields``, ``identifier``).
    """
    known = F.array(*[F.lit(name) for name in (*E.COMMON_FIELDS, *E.KIND_FIELDS[kind])])
    return _cards(entries, F.lit(kind), _lists(kind), _texts(kind), known, *keys)


def _lists(kind: str) -> Column:
    return F.create_map(*[item for name, column in _list_columns(kind).items() for item in (F.lit(name), column)])


def _texts(kind: str) -> Column:
    texts = {name: E.joined_field(source) for name, source in TEXT_FIELDS.get(kind, {}).items()}
    if kind == "gene":
        organism = E.joined_field("ORGANISM")
        texts["organism_code"] = F.substring_index(organism, " ", 1)
        texts["organism_name"] = F.nullif(strip(F.regexp_replace(organism, r"^\S+", "")), F.lit(""))
    if kind == "genome":
        number = F.regexp_extract(E.joined_field("TAXONOMY"), E.TAXONOMY_ID, 1)
        texts["organism_code"] = F.nullif(F.regexp_extract(E.joined_field("ORG_CODE"), r"^(\S+)", 1), F.lit(""))
        texts["taxonomy_id"] = F.when(number != "", F.concat(F.lit("taxid:"), number))
    text_pairs = [item for name, column in texts.items() for item in (F.lit(name), column)]
    return F.create_map(*text_pairs) if text_pairs else F.create_map().cast("map<string,string>")


def _cards(entries: DataFrame, kind: Column, lists: Column, texts: Column, known: Column, *keys: str) -> DataFrame:
    field_names = F.array_distinct(F.transform(F.col("fields"), lambda f: f["name"]))
    base = entries.select(*keys, kind.alias("kind"), "identifier", "fields")
    return computed(
        base, names=E.names(), definition=E.joined_field("DEFINITION"), classes=E.field_lines("CLASS"),
        dblinks=E.cross_references(), pubmed_ids=E.pubmed_ids(),
        unparsed_fields=F.array_except(field_names, known), lists=lists, texts=texts,
    ).drop("fields")


def all_cards(entries: DataFrame, *keys: str) -> DataFrame:
    """Cards of all nine kinds from entries that carry a ``kind`` column, in one pass over the entries."""
    def by_kind(pick) -> Column:
        first, *others = E.KINDS
        return reduce(lambda acc, kind: acc.when(F.col("kind") == kind, pick(kind)), others, F.when(F.col("kind") == first, pick(first)))

    known = by_kind(lambda kind: F.array(*[F.lit(name) for name in (*E.COMMON_FIELDS, *E.KIND_FIELDS[kind])]))
    usable = entries.filter(F.col("kind").isin(*E.KINDS))
    return _cards(usable, F.col("kind"), by_kind(_lists), by_kind(_texts), known, *keys)


def card_field_counts(cards: DataFrame) -> DataFrame:
    return cards.select("kind", "identifier", F.explode("lists").alias("field", "items")).select(
        "kind", "identifier", "field", F.size("items").cast("bigint").alias("n"))


def card_relationships(cards: DataFrame) -> DataFrame:
    """Edge rows of every card, first-seen unique per card, relationship, database and id."""
    known = [(kind, field, relationship, target) for kind, parts in LIST_FIELDS.items() for field, relationship, target in parts if relationship]
    legend = F.create_map(*[part for kind, field, relationship, target in known for part in (
        F.lit(f"{kind}.{field}"), F.struct(F.lit(relationship).alias("relationship"), F.lit(target).alias("target")))])

    def edges(kind_field: Column, items: Column) -> Column:
        meaning = legend[kind_field]
        return F.transform(items, lambda r: F.struct(
            meaning["relationship"].alias("relationship"), meaning["target"].alias("target_database"),
            r["identifier"].alias("target_identifier"), r["label"].alias("target_label")))

    null = F.lit(None).cast("string")
    pubmed = F.transform("pubmed_ids", lambda v: F.struct(
        F.lit("pubmed").alias("relationship"), F.lit("pubmed").alias("target_database"), v.alias("target_identifier"), null.alias("target_label")))
    dblink = F.transform("dblinks", lambda d: F.struct(
        F.lit("dblink").alias("relationship"), d["database"].alias("target_database"), d["identifier"].alias("target_identifier"), null.alias("target_label")))
    lists = F.flatten(F.transform(F.map_entries("lists"), lambda e: edges(F.concat_ws(".", F.col("kind"), e["key"]), e["value"])))
    taxonomy = F.filter(F.array(F.struct(
        F.lit("taxonomy").alias("relationship"), F.lit("taxonomy").alias("target_database"),
        F.col("texts")["taxonomy_id"].alias("target_identifier"), null.alias("target_label"))), lambda r: r["target_identifier"].isNotNull())
    rows = cards.select("kind", "identifier", F.inline(F.concat(pubmed, dblink, lists, taxonomy))).filter("relationship is not null")
    return rows.select(F.col("kind").alias("source_database"), F.col("identifier").alias("source_identifier"), "relationship",
                       "target_database", "target_identifier", "target_label")


def literature_summary(cards: DataFrame) -> DataFrame:
    """Entries, entries with literature and distinct literature ids, in one pass over the cards.

    A card is one row without an id and one row per id; the counts come from the group without an id.
    """
    none = F.array(F.lit(None).cast("string"))
    marked = F.concat(none, F.array_compact(F.coalesce("pubmed_ids", F.array().cast("array<string>"))))
    rows = cards.select(F.explode(marked).alias("id"), (F.size("pubmed_ids") > 0).alias("has"))
    ids = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if("has").alias("referenced"))
    of_cards = lambda name: F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col(name))), F.lit(0))
    return ids.agg(of_cards("n").alias("entries"), of_cards("referenced").alias("referenced_entries"), F.count("id").alias("pubmed_ids"))


def entry_previews(entries: DataFrame, limit: int, *keys: str) -> DataFrame:
    """``NAME: text`` lines of all fields, cut to ``limit`` characters, with a truncation flag."""
    lines = F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), F.array_join(f["lines"], " ")))
    text = F.array_join(lines, "\n")
    return entries.select(*keys, "identifier", text.alias("text")).select(
        *keys, "identifier", F.substring("text", 1, limit).alias("text_preview"), (F.length("text") > limit).alias("truncated"))


def genome_records(entries: DataFrame, *keys: str) -> DataFrame:
    """T-number, organism code, name and lineage labels of genome entries."""
    lineage = unique_items(F.split(F.coalesce(E.joined_field("LINEAGE"), F.lit("")), ";"))
    return entries.select(
        *keys, F.col("identifier").alias("t_number"),
        F.nullif(F.regexp_extract(E.joined_field("ORG_CODE"), r"^(\S+)", 1), F.lit("")).alias("organism_code"),
        E.joined_field("NAME").alias("name"), lineage.alias("lineage"))


def get_entries(requests: DataFrame, entries: DataFrame, *on: str) -> DataFrame:
    """Requested entries that exist."""
    return entries.join(requests.select(*on).distinct(), list(on), "left_semi")


def missing_entries(requests: DataFrame, entries: DataFrame, *on: str) -> DataFrame:
    """Requested ids that were not returned, with their request position."""
    return requests.join(entries.select(*on).distinct(), list(on), "left_anti")
