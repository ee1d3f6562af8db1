"""Identifier syntax, normalization and relation directions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.functions.text import strip

# ---------------------------------------------------------------------------
# Identifier syntax.
KO_PATTERN = r"^K[0-9]{5}$"
NUMBERED_PATTERNS = {
    "ko": r"^K[0-9]{5}$",
    "module": r"^M[0-9]{5}$",
    "reaction": r"^R[0-9]{5}$",
    "compound": r"^C[0-9]{5}$",
    "glycan": r"^G[0-9]{5}$",
    "drug": r"^D[0-9]{5}$",
    "rclass": r"^RC[0-9]{5}$",
    "genome": r"^T[0-9]{5}$",
    "taxonomy": r"^taxid:[1-9][0-9]*$",
}
ORGANISM_CODE_PATTERN = r"^[a-z]{3,4}$"
RESERVED_ORGANISM_PREFIXES = ("atc", "cpd", "drug", "jtc", "map", "ndc", "path", "pmid", "vtax")
PATHWAY_PREFIXES = ("map", "ko", "ec", "rn", "vg", "vx")
HIERARCHY_PREFIXES = ("br", "jp", "ko")
GENE_COLLECTION_PREFIXES = ("ag", "vg", "vp")
EC_PATTERN = r"^[1-7](?:\.[0-9]+){3}$|^[1-7](?:\.[0-9]+){2}\.-$|^[1-7]\.[0-9]+\.-\.-$|^[1-7]\.-\.-\.-$"
ENTITY_PREFIXES = {
    "gene": (),
    "ko": ("ko:",),
    "pathway": ("path:", "pathway:"),
    "module": ("md:", "module:"),
    "reaction": ("rn:", "reaction:"),
    "enzyme": ("ec:", "enzyme:"),
    "compound": ("cpd:", "compound:"),
    "glycan": ("gl:", "glycan:"),
    "drug": ("dr:", "drug:"),
    "rclass": ("rc:", "rclass:"),
    "hierarchy": ("br:", "hierarchy:"),
    "genome": ("gn:", "genome:"),
    "taxonomy": ("taxid:", "taxonomy:", "tax:"),
    "organism": ("organism:", "gn:", "genome:"),
}
PAIR_TARGET_PATTERNS = {
    "module": r"^(?:md|module):M[0-9]{5}$",
    "reaction": r"^(?:rn|reaction):R[0-9]{5}$",
    "ko": r"^ko:K[0-9]{5}$",
    "ncbi-geneid": r"^ncbi-geneid:[1-9][0-9]*$",
    "ncbi-proteinid": r"^ncbi-proteinid:[A-Za-z0-9._-]+$",
    "uniprot": r"^(?:uniprot|up):[A-Za-z0-9._-]+$",
    "compound": r"^(?:cpd|compound):C[0-9]{5}$",
    "glycan": r"^(?:gl|glycan):G[0-9]{5}$",
    "drug": r"^(?:dr|drug):D[0-9]{5}$",
    "chebi": r"^chebi:[1-9][0-9]*$",
    "pubchem": r"^pubchem:[1-9][0-9]*$",
    "taxonomy": r"^(?:taxid|taxonomy):[1-9][0-9]*$",
}
# relationship -> (source kind, target kind, prefix of the source id in a relation row)
RELATION_TYPES = {
    "ko_to_pathway": ("ko", "pathway", "ko:"),
    "ko_to_module": ("ko", "module", "ko:"),
    "ko_to_reaction": ("ko", "reaction", "ko:"),
    "ko_to_enzyme": ("ko", "enzyme", "ko:"),
    "ko_to_hierarchy": ("ko", "hierarchy", "ko:"),
    "ko_to_gene": ("ko", "gene", "ko:"),
    "pathway_to_ko": ("pathway", "ko", "path:"),
    "pathway_to_gene": ("pathway", "gene", "path:"),
    "pathway_to_module": ("pathway", "module", "path:"),
    "pathway_to_reaction": ("pathway", "reaction", "path:"),
    "pathway_to_compound": ("pathway", "compound", "path:"),
    "pathway_to_glycan": ("pathway", "glycan", "path:"),
    "gene_to_ko": ("gene", "ko", ""),
    "gene_to_pathway": ("gene", "pathway", ""),
    "enzyme_to_reaction": ("enzyme", "reaction", "ec:"),
    "reaction_to_enzyme": ("reaction", "enzyme", "rn:"),
    "reaction_to_ko": ("reaction", "ko", "rn:"),
    "reaction_to_compound": ("reaction", "compound", "rn:"),
    "reaction_to_glycan": ("reaction", "glycan", "rn:"),
    "reaction_to_pathway": ("reaction", "pathway", "rn:"),
    "compound_to_reaction": ("compound", "reaction", "cpd:"),
    "compound_to_pathway": ("compound", "pathway", "cpd:"),
    "glycan_to_reaction": ("glycan", "reaction", "gl:"),
    "glycan_to_pathway": ("glycan", "pathway", "gl:"),
    "drug_to_pathway": ("drug", "pathway", "dr:"),
    "module_to_ko": ("module", "ko", "md:"),
    "module_to_pathway": ("module", "pathway", "md:"),
    "module_to_reaction": ("module", "reaction", "md:"),
    "genome_to_taxonomy": ("genome", "taxonomy", "gn:"),
    "taxonomy_to_genome": ("taxonomy", "genome", ""),
}
GENE_NAMESPACES = ("ncbi-geneid", "ncbi-proteinid", "uniprot")
SUBSTANCE_KINDS = ("compound", "glycan", "drug")
SUBSTANCE_NAMESPACES = ("chebi", "pubchem")
TAXONOMY_RANKS = ("exact", "species", "genus", "family", "order", "class", "phylum")
# ---------------------------------------------------------------------------


def relation_types(spark: SparkSession) -> DataFrame:
    rows = [(name, *parts) for name, parts in RELATION_TYPES.items()]
    return spark.createDataFrame(rows, "relationship string, source_kind string, target_kind string, source_prefix string")


def normalize_ko(col: Column) -> Column:
    """``K`` and five digits after trimming and an optional case-insensitive ``ko:``; else NULL."""
    return F.get(F.regexp_extract_all(strip(col), F.lit(r"^(?:[kK][oO]:)?(K[0-9]{5})$"), F.lit(1)), F.lit(0))


def is_organism_code(col: Column, reserved: tuple[str, ...] = RESERVED_ORGANISM_PREFIXES) -> Column:
    return col.rlike(ORGANISM_CODE_PATTERN) & ~col.isin(*reserved)


def _numbered(col: Column, prefixes: tuple[str, ...]) -> Column:
    prefix = F.regexp_extract(col, r"^(.+)[0-9]{5}$", 1)
    return (prefix != "") & (prefix.isin(*prefixes) | is_organism_code(prefix))


def is_pathway(col: Column) -> Column:
    return _numbered(col, PATHWAY_PREFIXES)


def is_hierarchy(col: Column) -> Column:
    return _numbered(col, HIERARCHY_PREFIXES)


def is_gene(col: Column) -> Column:
    prefix = F.substring_index(col, ":", 1)
    return col.rlike(r"^[^:]+:[A-Za-z0-9._-]+$") & (
        prefix.isin(*GENE_COLLECTION_PREFIXES) | prefix.rlike(r"^T[0-9]{5}$") | is_organism_code(prefix)
    )


def is_ec_number(col: Column) -> Column:
    return col.rlike(EC_PATTERN)


def is_genome(col: Column) -> Column:
    return col.rlike(r"^T[0-9]{5}$") | is_organism_code(col)


def is_organism_module(col: Column) -> Column:
    prefix = F.regexp_extract(col, r"^(.+)_M[0-9]{5}$", 1)
    return prefix.rlike(r"^T[0-9]{5}$") | is_organism_code(prefix)


def _checks(col: Column) -> dict[str, Column]:
    checks = {kind: col.rlike(pattern) for kind, pattern in NUMBERED_PATTERNS.items()}
    checks["module"] = checks["module"] | is_organism_module(col)
    checks["gene"] = is_gene(col)
    checks["pathway"] = is_pathway(col)
    checks["hierarchy"] = is_hierarchy(col)
    checks["enzyme"] = is_ec_number(col)
    checks["organism"] = is_organism_code(col)
    return checks


def valid_identifier(kind: Column | str, col: Column) -> Column:
    """Syntax check for an entity kind given as a name or as a column of names."""
    checks = _checks(col)
    if isinstance(kind, str):
        return F.coalesce(checks[kind], F.lit(False))
    chosen = reduce(lambda acc, item: acc.when(kind == item[0], item[1]), list(checks.items())[1:],
                    F.when(kind == "ko", checks["ko"]))
    return F.coalesce(chosen, F.lit(False))


def normalize_pair_entity(kind: Column | str, col: Column) -> Column:
    """Strip the kind's namespace prefix; taxonomy is always written ``taxid:n``; invalid is NULL."""

    def stripped(name: str) -> Column:
        prefixes = ENTITY_PREFIXES[name]
        if not prefixes:
            return col
        pattern = "^(?:" + "|".join(prefixes) + ")"
        return F.regexp_replace(col, pattern, "taxid:" if name == "taxonomy" else "")

    if isinstance(kind, str):
        value = stripped(kind)
    else:
        names = list(ENTITY_PREFIXES)
        value = reduce(lambda acc, name: acc.when(kind == name, stripped(name)), names[1:],
                       F.when(kind == names[0], stripped(names[0])))
    return F.when(valid_identifier(kind, value), value)


def normalize_external_id(namespace: Column, col: Column) -> Column:
    """External substance and gene ids in the form used by a crosswalk; invalid is NULL."""
    chebi = F.regexp_extract(col, r"^(?:(?i:chebi):)?([1-9][0-9]*)$", 1)
    pubchem = F.regexp_extract(col, r"^(?:(?i:pubchem|sid):)?([1-9][0-9]*)$", 1)
    bare = F.regexp_extract(col, r"^([A-Za-z0-9][A-Za-z0-9._-]*)$", 1)
    number = F.regexp_extract(col, r"^([1-9][0-9]*)$", 1)

    def prefixed(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(name + ":"), value))

    return (
        F.when(namespace == "chebi", prefixed("chebi", chebi))
        .when(namespace == "pubchem", prefixed("pubchem", pubchem))
        .when(namespace == "ncbi-geneid", prefixed("ncbi-geneid", number))
        .when(namespace == "ncbi-proteinid", prefixed("ncbi-proteinid", bare))
        .when(namespace == "uniprot", prefixed("uniprot", bare))
    )


def pair_target_matches(target_kind: Column, col: Column, organism: Column | None = None) -> Column:
    """Whether a relation target belongs to the target namespace (and organism, for genes)."""
    head, tail = F.substring_index(col, ":", 1), F.regexp_extract(col, r"^[^:]*:(.*)$", 1)
    gene = is_gene(col)
    if organism is not None:
        gene = gene & (organism.isNull() | (head == organism))
    checks = {kind: col.rlike(pattern) for kind, pattern in PAIR_TARGET_PATTERNS.items()}
    checks["pathway"] = head.isin("path", "pathway") & is_pathway(tail)
    checks["hierarchy"] = head.isin("br", "hierarchy") & is_hierarchy(tail)
    checks["gene"] = gene
    checks["genome"] = head.isin("gn", "genome") & is_genome(tail)
    checks["enzyme"] = head.isin("ec", "enzyme") & is_ec_number(tail)
    items = list(checks.items())
    chosen = reduce(lambda acc, item: acc.when(target_kind == item[0], item[1]), items[1:],
                    F.when(target_kind == items[0][0], items[0][1]))
    return F.coalesce(chosen, F.lit(False))


def conversion_allowed(source_db: Column, target_db: Column) -> Column:
    """Genes to or from an external gene namespace; a substance to or from an external one."""
    return (
        ((target_db == "genes") & source_db.isin(*GENE_NAMESPACES))
        | ((source_db == "genes") & target_db.isin(*GENE_NAMESPACES))
        | (target_db.isin(*SUBSTANCE_KINDS) & source_db.isin(*SUBSTANCE_NAMESPACES))
        | (source_db.isin(*SUBSTANCE_KINDS) & target_db.isin(*SUBSTANCE_NAMESPACES))
    )


def pathway_namespace(col: Column) -> Column:
    """``ko``, ``map`` or ``organism``; NULL outside the supported namespaces."""
    prefix = F.regexp_extract(col, r"^(.+)[0-9]{5}$", 1)
    return F.when(prefix.isin("ko", "map"), prefix).when(is_organism_code(prefix), F.lit("organism"))


def canonical_pathway_id(col: Column) -> Column:
    """``ko`` and ``map`` views share one ``ko`` id; organism ids stay; others are NULL."""
    namespace = pathway_namespace(col)
    return F.when(namespace.isin("ko", "map"), F.concat(F.lit("ko"), F.right(col, F.lit(5)))).when(
        namespace == "organism", col
    )


def last_part(col: Column) -> Column:
    """Text after the last colon of a namespaced id."""
    return F.substring_index(col, ":", -1)
