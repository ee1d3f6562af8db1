"""Flat-file entries, typed cards, relationships and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import entries as E
from orthoflow.functions.identifiers import RESERVED_ORGANISM_PREFIXES
from orthoflow.operators import cards as C
from orthoflow.sources import flatfile as S
from orthoflow.workload.registry import query
from orthoflow.workload.views import Inputs, digits, ko, letters

P, NEXT = digits("p_partkey"), digits("p_partkey + 1")
SIZE = digits("p_size")
S_TEXT, P_TEXT = "CAST(p_size AS VARCHAR)", "CAST(p_partkey AS VARCHAR)"
PM1, PM2 = "CAST(p_partkey % 700 + 1 AS VARCHAR)", S_TEXT
ALL_FIELDS = ("ENTRY", "NAME", "DEFINITION", "CLASS", "PATHWAY", "MODULE", "REACTION", "ORTHOLOGY", "ENZYME", "EQUATION", "RCLASS", "COMPOUND",
              "GLYCAN", "FORMULA", "EXACT_MASS", "ORGANISM", "ORG_CODE", "TAXONOMY", "LINEAGE", "DBLINKS", "REFERENCE", "AUTHORS", "ODD_FIELD")


def sorted_join(column):
    return F.array_join(F.array_sort(column), "|")


def sql_join(items: str) -> str:
    return f"array_to_string(list_sort(list_distinct({items})), '|')"


def entries_of(data: Inputs):
    return S.parse_entries(data.view("v_flat_text").select("position", "kind", "text"))


NAMES = sql_join(f"[p_name, p_type, 'alias ' || {P_TEXT}]")
DEFINITION = f"{ko('p_partkey')} || ' ' || {ko('p_partkey + 1')} || '-' || {ko('p_partkey + 2')} || ' [EC:1.' || {S_TEXT} || '.1.1 2.1.1.-]'"
DBLINKS = sql_join(f"['ChEBI:' || CAST(p_partkey + 1 AS VARCHAR), 'ChEBI:' || CAST(p_partkey + 2 AS VARCHAR), 'PubChem:' || CAST(p_partkey + 3 AS VARCHAR)]")
EC_ENZYME = f"['1.1.1.' || {S_TEXT}, '2.' || {S_TEXT} || '.-.-']"
EC_ALL = f"list_concat(['1.' || {S_TEXT} || '.1.1', '2.1.1.-'], {EC_ENZYME})"
EQ_COMPOUNDS = f"['C' || {P}, 'C00002']"
KOS = f"[{ko('p_partkey')}, {ko('p_partkey + 1')}, {ko('p_partkey + 2')}]"
# kind -> field -> (ids list SQL, label SQL list or None)
LISTS = {
    "ko": {"ec_numbers": EC_ALL, "modules": f"['M' || {SIZE}]", "pathways": f"['map' || {SIZE}, 'ko' || {digits('p_size + 1')}]"},
    "module": {"pathways": f"['map' || {SIZE}, 'ko' || {digits('p_size + 1')}]", "reactions": f"['R' || {P}, 'R' || {NEXT}]", "referenced_modules": "[]::VARCHAR[]", "ko_components": KOS},
    "pathway": {"ko_identifiers": f"[{ko('p_partkey')}]", "modules": f"['M' || {SIZE}]", "reactions": f"['R' || {P}, 'R' || {NEXT}]", "compounds": f"['C' || {P}]", "glycans": f"['G' || {SIZE}]"},
    "reaction": {"enzyme_ids": EC_ENZYME, "ko_identifiers": f"[{ko('p_partkey')}]", "rclass_ids": f"['RC' || {SIZE}]", "compound_ids": EQ_COMPOUNDS, "glycan_ids": f"['G' || {SIZE}]"},
    "enzyme": {"reaction_ids": f"['R' || {P}, 'R' || {NEXT}]", "ko_identifiers": f"[{ko('p_partkey')}]"},
    "compound": {"reactions": f"['R' || {P}, 'R' || {NEXT}]", "pathways": f"['map' || {SIZE}, 'ko' || {digits('p_size + 1')}]"},
    "glycan": {"reactions": f"['R' || {P}, 'R' || {NEXT}]", "pathways": f"['map' || {SIZE}, 'ko' || {digits('p_size + 1')}]"},
    "gene": {"orthology": f"[{ko('p_partkey')}]", "pathways": f"['map' || {SIZE}, 'ko' || {digits('p_size + 1')}]"},
    "genome": {"lineage": "['Cellular', p_brand, p_type]"},
}
LABELS = {"modules": "'Module name'", "compounds": "'name'", "glycans": "'name'", "orthology": "'first [EC:1.1.1.1]'",
          "pathways": f"CASE WHEN id LIKE 'map%' THEN 'Pathway ' || {S_TEXT} ELSE 'Next' END"}
UNPARSED = "CASE kind " + " ".join(
    f"WHEN '{kind}' THEN '" + "|".join(sorted(set(ALL_FIELDS) - set(E.COMMON_FIELDS) - set(E.KIND_FIELDS[kind]))) + "'" for kind in E.KINDS) + " END"
LONG = " UNION ALL ".join(
    f"SELECT kind, identifier, '{field}' AS field, list_distinct({items}) AS ids, p_size FROM v_flat_text WHERE kind = '{kind}'"
    for kind, parts in LISTS.items() for field, items in parts.items())
LOCAL = {"v_card_lists": LONG}


@query("scan_flat_file", """
SELECT identifier, position, CAST(25 AS BIGINT) AS fields, CAST(NULL AS VARCHAR) AS fault FROM v_flat_text""")
def scan_flat_file(spark, sf):
    return entries_of(Inputs(spark, sf)).select("identifier", "position", F.size("fields").cast("bigint").alias("fields"), "fault")


FIELD_ROWS = f"""
SELECT position, name, CAST(sum(n) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS occurrences FROM v_flat_text,
 LATERAL (VALUES {', '.join(f"('{name}', {2 if name in ('NAME', 'PATHWAY', 'ORTHOLOGY', 'DBLINKS') else 1})" for name in (*ALL_FIELDS, 'LINEAGE', 'REFERENCE'))}, ('AUTHORS', 0)) AS f(name, n)
WHERE NOT (name = 'AUTHORS' AND n = 0) GROUP BY 1, 2"""


@query("flat_file_fields", FIELD_ROWS)
def flat_file_fields(spark, sf):
    fields = S.entry_fields(entries_of(Inputs(spark, sf)), "position")
    return fields.groupBy("position", "name").agg(F.sum(F.size("lines")).alias("lines"), F.count("*").alias("occurrences"))


@query("split_names", f"SELECT position, {NAMES} AS names FROM v_flat_text")
def split_names(spark, sf):
    return entries_of(Inputs(spark, sf)).select("position", sorted_join(E.names()).alias("names"))


@query("field_text", f"SELECT position, {DEFINITION} AS definition, p_name || '; ' || p_type || '; ' || p_name || '; alias ' || {P_TEXT} AS name_text FROM v_flat_text")
def field_text(spark, sf):
    return entries_of(Inputs(spark, sf)).select("position", E.joined_field("DEFINITION").alias("definition"), E.joined_field("NAME").alias("name_text"))


@query("reference_list", f"""
SELECT position, 'PATHWAY' AS field, 'map' || {SIZE} AS identifier, 'Pathway ' || {S_TEXT} AS label FROM v_flat_text
UNION ALL SELECT position, 'PATHWAY', 'ko' || {digits('p_size + 1')}, 'Next' FROM v_flat_text
UNION ALL SELECT position, 'REACTION', 'R' || {P}, NULL FROM v_flat_text UNION ALL SELECT position, 'REACTION', 'R' || {NEXT}, NULL FROM v_flat_text
UNION ALL SELECT position, 'ORTHOLOGY', {ko('p_partkey')}, 'first [EC:1.1.1.1]' FROM v_flat_text""")
def reference_list(spark, sf):
    parts = [F.transform(E.references(name, pattern), lambda r: F.struct(F.lit(name).alias("field"), r["identifier"].alias("identifier"), r["label"].alias("label")))
             for name, pattern in (("PATHWAY", E.PATHWAY_REFERENCE), ("REACTION", C.REACTION), ("ORTHOLOGY", C.KO))]
    return entries_of(Inputs(spark, sf)).select("position", F.inline(F.concat(*parts)))


@query("cross_references", f"SELECT position, {DBLINKS} AS dblinks FROM v_flat_text")
def cross_references(spark, sf):
    pairs = F.transform(E.cross_references(), lambda d: F.concat_ws(":", d["database"], d["identifier"]))
    return entries_of(Inputs(spark, sf)).select("position", sorted_join(pairs).alias("dblinks"))


@query("pubmed_ids", f"SELECT position, CASE WHEN {PM1} = {PM2} THEN {PM1} ELSE {PM1} || '|' || {PM2} END AS pubmed_ids FROM v_flat_text")
def pubmed_ids(spark, sf):
    return entries_of(Inputs(spark, sf)).select("position", F.array_join(E.pubmed_ids(), "|").alias("pubmed_ids"))


@query("ec_numbers", f"SELECT position, {sql_join(EC_ALL)} AS ec_numbers FROM v_flat_text")
def ec_numbers(spark, sf):
    texts = F.concat(F.array(E.joined_field("DEFINITION")), E.field_lines("ENZYME"))
    return entries_of(Inputs(spark, sf)).select("position", sorted_join(E.ec_numbers(texts)).alias("ec_numbers"))


@query("ids_in_text", f"SELECT position, {sql_join(EQ_COMPOUNDS)} AS compound_ids, 'G' || {SIZE} AS glycan_ids FROM v_flat_text")
def ids_in_text(spark, sf):
    equation = E.joined_field("EQUATION")
    return entries_of(Inputs(spark, sf)).select("position", sorted_join(E.ids_in_text(equation, E.COMPOUND_ID)).alias("compound_ids"),
                                                 sorted_join(E.ids_in_text(equation, E.GLYCAN_ID)).alias("glycan_ids"))


def cards_of(data: Inputs):
    return C.all_cards(entries_of(data), "position")


@query("entry_cards", f"""
SELECT position, kind, identifier, {NAMES} AS names, {DEFINITION} AS definition, 'Class ' || p_brand AS classes, {DBLINKS} AS dblinks,
  CASE WHEN {PM1} = {PM2} THEN 1 ELSE 2 END AS pubmed_count, {UNPARSED} AS unparsed,
  CASE kind WHEN 'reaction' THEN 'C' || {P} || ' + 2 C00002 <=> G' || {SIZE} || ' + C' || {P} WHEN 'compound' THEN 'C' || {S_TEXT} || 'H2O' WHEN 'gene' THEN 'hsa' WHEN 'genome' THEN 'taxid:' || CAST(p_partkey + 1 AS VARCHAR) END AS main_text
FROM v_flat_text""")
def entry_cards(spark, sf):
    main = F.coalesce(*[F.col("texts")[name] for name in ("equation", "formula")],
                      F.when(F.col("kind") == "gene", F.col("texts")["organism_code"]), F.col("texts")["taxonomy_id"])
    pairs = F.transform("dblinks", lambda d: F.concat_ws(":", d["database"], d["identifier"]))
    return cards_of(Inputs(spark, sf)).select(
        "position", "kind", "identifier", sorted_join(F.col("names")).alias("names"), "definition", sorted_join(F.col("classes")).alias("classes"),
        sorted_join(pairs).alias("dblinks"), F.size("pubmed_ids").alias("pubmed_count"), sorted_join(F.col("unparsed_fields")).alias("unparsed"), main.alias("main_text"))


@query("card_field_counts", "SELECT kind, field, CAST(sum(len(ids)) AS BIGINT) AS items, count(*) AS cards FROM v_card_lists GROUP BY 1, 2", LOCAL)
def card_field_counts(spark, sf):
    return C.card_field_counts(cards_of(Inputs(spark, sf))).groupBy("kind", "field").agg(F.sum("n").alias("items"), F.count("*").alias("cards"))


MEANING = {(kind, field): (relationship, target) for kind, parts in C.LIST_FIELDS.items() for field, relationship, target in parts if relationship}
RELATIONSHIP_CASE = "CASE kind || '.' || field " + " ".join(f"WHEN '{k}.{f}' THEN '{r}'" for (k, f), (r, _) in MEANING.items()) + " END"
TARGET_CASE = "CASE kind || '.' || field " + " ".join(f"WHEN '{k}.{f}' THEN '{t}'" for (k, f), (_, t) in MEANING.items()) + " END"
LABEL_CASE = "CASE field " + " ".join(f"WHEN '{f}' THEN {label}" for f, label in LABELS.items()) + " END"
EDGES = f"""
SELECT kind AS source_database, identifier AS source_identifier, {RELATIONSHIP_CASE} AS relationship, {TARGET_CASE} AS target_database, id AS target_identifier, {LABEL_CASE} AS target_label
FROM (SELECT *, unnest(ids) AS id FROM v_card_lists WHERE field <> 'lineage') AS l
UNION ALL SELECT kind, identifier, 'pubmed', 'pubmed', unnest(list_distinct([{PM1}, {PM2}])), NULL FROM v_flat_text
UNION ALL SELECT kind, identifier, 'dblink', split_part(d, ':', 1), split_part(d, ':', 2), NULL FROM (SELECT kind, identifier, unnest(string_split({DBLINKS}, '|')) AS d FROM v_flat_text) AS x
UNION ALL SELECT kind, identifier, 'taxonomy', 'taxonomy', 'taxid:' || CAST(p_partkey + 1 AS VARCHAR), NULL FROM v_flat_text WHERE kind = 'genome'"""
LOCAL_EDGES = {**LOCAL, "v_card_edges": EDGES}


@query("card_relationships", EDGES, LOCAL)
def card_relationships(spark, sf):
    return C.card_relationships(cards_of(Inputs(spark, sf)))


@query("write_card_relationships", """
SELECT source_database, source_identifier, relationship, target_database, target_identifier, coalesce(target_label, '') AS target_label FROM v_card_edges""", LOCAL_EDGES)
def write_card_relationships(spark, sf):
    from orthoflow.sinks.tables import card_relationship_table

    return card_relationship_table(C.card_relationships(cards_of(Inputs(spark, sf))))


@query("literature_summary", f"""
SELECT count(*) AS entries, count(*) AS referenced_entries, (SELECT count(DISTINCT id) FROM (SELECT {PM1} AS id FROM v_flat_text UNION ALL SELECT {PM2} FROM v_flat_text) AS t) AS pubmed_ids FROM v_flat_text""")
def literature_summary(spark, sf):
    return C.literature_summary(cards_of(Inputs(spark, sf)))


@query("genome_record", f"""
SELECT identifier AS t_number, {letters('p_partkey')} AS organism_code, 'Cellular|' || p_brand || '|' || p_type AS lineage,
  p_name || '; ' || p_type || '; ' || p_name || '; alias ' || {P_TEXT} AS name FROM v_flat_text WHERE kind = 'genome'""")
def genome_record(spark, sf):
    entries = entries_of(Inputs(spark, sf)).filter("kind = 'genome'")
    return C.genome_records(entries).withColumn("lineage", F.array_join("lineage", "|"))


@query("entry_preview", f"""
SELECT position, substr(t, 1, 40) AS text_preview, length(t) > 40 AS truncated FROM (
 SELECT position, 'ENTRY: ' || CASE kind WHEN 'enzyme' THEN 'EC ' ELSE '' END || identifier || '   ' || p_type || chr(10) || 'NAME: ' || p_name || '; ' || p_type || '; ' || p_name || '; alias' AS t FROM v_flat_text) AS u""")
def entry_preview(spark, sf):
    return C.entry_previews(entries_of(Inputs(spark, sf)), 40, "position").drop("identifier")


#: Prefixes that are no organism codes.
_RESERVED = ", ".join(f"'{prefix}'" for prefix in RESERVED_ORGANISM_PREFIXES)


@query("organism_code_from_text", f"""
SELECT c_custkey, CASE WHEN {letters('c_custkey')} NOT IN ({_RESERVED}) THEN {letters('c_custkey')} END AS code FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_mktsegment = 'BUILDING'""")
def organism_code_from_text(spark, sf):
    text = Inputs(spark, sf).table("customer").selectExpr(
        "c_custkey", f"case when c_mktsegment = 'BUILDING' then c_name || ' text' else '  ' || {letters('c_custkey')} || '; ' || c_name end as matched")
    return text.select("c_custkey", E.organism_code_from_text(F.col("matched")).alias("code"))


@query("get_entries", f"""
SELECT identifier, kind, {NAMES} AS names FROM v_flat_text WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def get_entries(spark, sf):
    data = Inputs(spark, sf)
    requests = data.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("position"))
    found = C.get_entries(requests, data.view("v_flat_text").select("position", "kind", "text"), "position")
    return S.parse_entries(found).select("identifier", "kind", sorted_join(E.names()).alias("names"))


@query("missing_entries", """
SELECT o_orderkey, o_custkey * 2 AS requested FROM orders WHERE o_custkey * 2 NOT IN (SELECT p_partkey FROM part)""")
def missing_entries(spark, sf):
    data = Inputs(spark, sf)
    requests = data.table("orders").selectExpr("o_orderkey", "o_custkey * 2 as requested")
    return C.missing_entries(requests, data.table("part").select(F.col("p_partkey").alias("requested")), "requested").select("o_orderkey", "requested")


@query("extract_module_definitions", f"""
SELECT identifier AS module_id, p_name || '; ' || p_type || '; ' || p_name || '; alias ' || {P_TEXT} AS module_name, {DEFINITION} AS definition, CAST(NULL AS VARCHAR) AS fault
FROM v_flat_text WHERE kind = 'module'""")
def extract_module_definitions(spark, sf):
    entries = entries_of(Inputs(spark, sf)).filter("kind = 'module'")
    return S.module_definitions(entries)
