"""Scalars, policies, intake, duplicates, conflicts and evidence views."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.functions import numbers as N
from orthoflow.functions import policies as P
from orthoflow.functions import provenance as V
from orthoflow.functions import text as T
from orthoflow.operators import evidence as E
from orthoflow.operators import intake as K
from orthoflow.session import written
from orthoflow.workload.registry import query
from orthoflow.workload.views import Inputs, sql_ko, sql_number, sql_positive, sql_strip


@query("normalize_ko", f"SELECT label, {sql_ko('label')} AS ko_id, count(*) AS n FROM v_rows GROUP BY 1, 2")
def normalize_ko(spark, sf):
    rows = Inputs(spark, sf).rows()
    return rows.groupBy(F.col("predict_label").alias("label"), I.normalize_ko(F.col("predict_label")).alias("ko_id")).agg(
        F.count("*").alias("n"))


@query("parse_finite_double", f"""
SELECT score_text, {sql_number('score_text')} AS value, ({sql_strip('score_text')} <> '' AND {sql_number('score_text')} IS NULL) AS invalid, count(*) AS n
FROM v_rows GROUP BY 1, 2, 3""")
def parse_finite_double(spark, sf):
    c = F.col("probability")
    return Inputs(spark, sf).rows().groupBy(
        c.alias("score_text"), N.parse_finite_double(c).alias("value"), N.finite_double_invalid(c).alias("invalid")).agg(
        F.count("*").alias("n"))


@query("constrain_probability", f"""
SELECT score_text, CASE WHEN v BETWEEN 0 AND 1 THEN v END AS value, coalesce(v NOT BETWEEN 0 AND 1, false) AS invalid, count(*) AS n
FROM (SELECT score_text, {sql_number('score_text')} AS v FROM v_rows) AS t GROUP BY 1, 2, 3""")
def constrain_probability(spark, sf):
    value = N.parse_finite_double(F.col("probability"))
    return Inputs(spark, sf).rows().groupBy(
        F.col("probability").alias("score_text"), N.constrain_probability(value).alias("value"),
        N.probability_invalid(value).alias("invalid")).agg(F.count("*").alias("n"))


@query("parse_positive_int", f"""
SELECT end_text, {sql_positive('end_text')} AS value, ({sql_strip('end_text')} <> '' AND {sql_positive('end_text')} IS NULL) AS invalid, count(*) AS n
FROM v_rows GROUP BY 1, 2, 3""")
def parse_positive_int(spark, sf):
    c = F.col("end")
    return Inputs(spark, sf).rows().groupBy(
        c.alias("end_text"), N.parse_positive_int(c).alias("value"), N.positive_int_invalid(c).alias("invalid")).agg(
        F.count("*").alias("n"))


@query("parse_domain_interval", """
SELECT start_text, end_text, domain_start, domain_end, (start_n IS NULL) <> (end_n IS NULL) AS incomplete,
  coalesce(end_n < start_n, false) AS reversed, count(*) AS n FROM v_parsed GROUP BY ALL""")
def parse_domain_interval(spark, sf):
    s, e = F.col("start"), F.col("end")
    domain = N.domain_interval(s, e)
    return Inputs(spark, sf).rows().groupBy(
        s.alias("start_text"), e.alias("end_text"), domain["domain_start"].alias("domain_start"),
        domain["domain_end"].alias("domain_end"), N.domain_incomplete(s, e).alias("incomplete"),
        N.domain_reversed(s, e).alias("reversed")).agg(F.count("*").alias("n"))


@query("valid_label", "SELECT dataset_id, row_number, NOT skipped AS valid FROM v_parsed")
def valid_label(spark, sf):
    return Inputs(spark, sf).rows().select("dataset_id", "row_number", T.valid_label(F.col("name")).alias("valid"))


@query("split_composite", """
SELECT dataset_id, row_number, unnest(labels) AS raw_ko, generate_subscripts(labels, 1) - 1 AS pos FROM v_parsed""")
def split_composite(spark, sf):
    return Inputs(spark, sf).rows().select(
        "dataset_id", "row_number", F.posexplode(K.split_composite(F.col("predict_label"))).alias("pos", "raw_ko")).withColumn(
        "pos", F.col("pos").cast("bigint"))


@query("policy_user_supplied", f"""
SELECT sample_id, status, reason, count(*) AS n FROM (
  SELECT sample_id, CASE WHEN {sql_ko('label')} IS NULL THEN 'invalid' ELSE 'accepted' END AS status,
    CASE WHEN {sql_ko('label')} IS NULL THEN 'invalid_ko_identifier' ELSE 'user_supplied_annotation' END AS reason FROM v_rows) AS t
GROUP BY ALL""")
def policy_user_supplied(spark, sf):
    raw = F.col("predict_label")
    out = P.policy_for("user_supplied", "generic_csv").classify(P.no_evidence(raw, I.normalize_ko(raw)))
    return Inputs(spark, sf).rows().groupBy("sample_id", out["status"].alias("status"), out["reason"].alias("reason")).agg(
        F.count("*").alias("n"))


@query("policy_source_status", f"""
SELECT sample_id, status, reason, count(*) AS n FROM (
  SELECT sample_id, CASE WHEN k IS NULL AND b THEN 'unclassified' WHEN k IS NULL THEN 'invalid' WHEN d = 'accepted' THEN 'accepted' WHEN d = 'rejected' THEN 'rejected' ELSE 'unclassified' END AS status,
    CASE WHEN k IS NULL AND b THEN 'missing_ko_prediction' WHEN k IS NULL THEN 'invalid_ko_identifier' WHEN d = 'accepted' THEN 'source_accepted' WHEN d = 'rejected' THEN 'source_rejected' ELSE 'unrecognized_source_decision' END AS reason
  FROM (SELECT sample_id, {sql_ko('label')} AS k, {sql_strip('label')} = '' AS b, lower({sql_strip('decision')}) AS d FROM v_rows) AS u) AS t
GROUP BY ALL""")
def policy_source_status(spark, sf):
    rows = Inputs(spark, sf).view("v_rows")
    raw = F.col("label")
    base = P.no_evidence(raw, I.normalize_ko(raw))
    evidence = P.Evidence(base.raw_ko, base.ko_id, F.col("decision"), base.score, base.threshold, base.score_type, base.threshold_rule)
    out = P.policy_for("source_status", "generic_tsv").classify(evidence)
    return rows.groupBy("sample_id", out["status"].alias("status"), out["reason"].alias("reason")).agg(F.count("*").alias("n"))


@query("policy_marker_threshold", "SELECT sample_id, status, reason, count(*) AS n FROM v_assign GROUP BY ALL")
def policy_marker_threshold(spark, sf):
    return Inputs(spark, sf).records().groupBy("sample_id", "status", "reason").agg(F.count("*").alias("n"))


@query("marker_threshold_conflict", """
SELECT dataset_id, row_number FROM v_parsed WHERE NOT skipped AND mark = '*' AND score < threshold""")
def marker_threshold_conflict(spark, sf):
    return Inputs(spark, sf).parsed().filter(
        ~F.col("skipped") & P.marker_threshold_conflict(F.col("raw_decision"), F.col("score"), F.col("threshold"))).select(
        "dataset_id", "row_number")


_FIRST = sql_ko("labels[1]")


DIAGNOSTICS = f"""
  SELECT dataset_id, row_number, unnest([
    CASE WHEN skipped THEN 'ROW_SKIPPED|name' END,
    CASE WHEN NOT skipped AND trim(score_text) <> '' AND score_n IS NULL THEN 'INVALID_FIELD_VALUE|probability' END,
    CASE WHEN NOT skipped AND trim(threshold_text) <> '' AND threshold_n IS NULL THEN 'INVALID_FIELD_VALUE|threshold' END,
    CASE WHEN NOT skipped AND score_n NOT BETWEEN 0 AND 1 THEN 'INVALID_FIELD_VALUE|probability' END,
    CASE WHEN NOT skipped AND threshold_n NOT BETWEEN 0 AND 1 THEN 'INVALID_FIELD_VALUE|threshold' END,
    CASE WHEN NOT skipped AND trim(start_text) <> '' AND start_n IS NULL THEN 'INVALID_FIELD_VALUE|domain_start' END,
    CASE WHEN NOT skipped AND trim(end_text) <> '' AND end_n IS NULL THEN 'INVALID_FIELD_VALUE|domain_end' END,
    CASE WHEN NOT skipped AND (start_n IS NULL) <> (end_n IS NULL) THEN 'INVALID_FIELD_VALUE|domain_start,domain_end' END,
    CASE WHEN NOT skipped AND end_n < start_n THEN 'INVALID_FIELD_VALUE|domain_start,domain_end' END,
    CASE WHEN NOT skipped AND {_FIRST} IS NULL AND trim(label) <> '' THEN 'INVALID_KO_IDENTIFIER|predict_label' END,
    CASE WHEN NOT skipped AND {_FIRST} IS NOT NULL AND mark = 'x' THEN 'UNRECOGNIZED_SOURCE_DECISION|annotate' END,
    CASE WHEN NOT skipped AND mark = '*' AND score < threshold THEN 'SOURCE_DECISION_CONFLICT|annotate,probability,threshold' END]) AS d,
    split_part(d, '|', 1) AS code, split_part(d, '|', 2) AS field
  FROM v_parsed"""


@query("row_diagnostics", f"SELECT dataset_id, row_number, code, field, count(*) AS n FROM ({DIAGNOSTICS}) AS t WHERE d IS NOT NULL GROUP BY ALL")
def row_diagnostics(spark, sf):
    return K.row_diagnostics(Inputs(spark, sf).parsed(), K.detailed_legend()).groupBy("dataset_id", "row_number", "code", "field").agg(
        F.count("*").alias("n"))


@query("validate_logical_uri", """
SELECT doc_id, uri, CASE doc_id % 16 WHEN 0 THEN NULL WHEN 1 THEN 'absolute_path' WHEN 2 THEN NULL WHEN 3 THEN 'unsupported_scheme' WHEN 4 THEN NULL WHEN 5 THEN 'path_traversal'
  WHEN 6 THEN 'credentials' WHEN 7 THEN 'query_or_fragment' WHEN 8 THEN 'absolute_path' WHEN 9 THEN 'whitespace_or_control' WHEN 10 THEN 'percent_encoded' WHEN 11 THEN 'relative_path'
  WHEN 12 THEN 'outer_whitespace_or_empty' WHEN 13 THEN 'invalid_urn' WHEN 14 THEN 'missing_authority' ELSE 'absolute_path' END AS violation FROM v_uris""")
def validate_logical_uri(spark, sf):
    return Inputs(spark, sf).view("v_uris").select("doc_id", "uri", V.logical_uri_violation(F.col("uri")).alias("violation"))


@query("parse_annotation_date", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '2024-01-02 03:04:05' WHEN 1 THEN '2024-01-02 01:04:05' WHEN 5 THEN '2024-01-02 03:04:00' END AS annotation_date FROM v_uris""")
def parse_annotation_date(spark, sf):
    utc = F.to_utc_timestamp(V.parse_annotation_date(F.col("date_text")), F.current_timezone())
    return Inputs(spark, sf).view("v_uris").select("doc_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("annotation_date"))


@query("score_consistency", """
SELECT dataset_id, violation, count(*) AS n FROM (
  SELECT dataset_id, CASE WHEN s = 'accepted' AND ko_id IS NULL THEN 'status_requires_ko' WHEN s = 'invalid' AND ko_id IS NOT NULL THEN 'invalid_with_ko'
    WHEN score_n IS NOT NULL AND st IS NULL THEN 'score_without_type' WHEN (threshold_n IS NULL) <> (rule IS NULL) THEN 'threshold_without_rule'
    WHEN st = 'probability' AND score_n NOT BETWEEN 0 AND 1 THEN 'probability_score_out_of_range' END AS violation
  FROM (SELECT *, CASE WHEN decision = ' Accepted' THEN 'accepted' WHEN decision = 'rejected' AND mark = '' THEN 'invalid' ELSE 'unclassified' END AS s,
     CASE WHEN note = 'O' THEN 'probability' END AS st, CASE WHEN rank_text <> '3' THEN 'gte' END AS rule FROM v_assign) AS u) AS t
WHERE violation IS NOT NULL GROUP BY ALL""")
def score_consistency(spark, sf):
    """Unchecked source claims (status from the decision text, raw numbers) against the record rules."""
    rows = Inputs(spark, sf).view("v_rows").filter(T.valid_label(F.col("seq_name")))
    exploded = rows.select("*", F.explode(K.split_composite(F.col("label"))).alias("raw_ko"))
    status = F.expr("case when decision = ' Accepted' then 'accepted' when decision = 'rejected' and mark = '' then 'invalid' else 'unclassified' end")
    violation = V.score_violation(
        F.col("raw_ko"), I.normalize_ko(F.col("raw_ko")), status, N.parse_finite_double(F.col("score_text")),
        F.expr("case when note = 'O' then 'probability' end"), N.parse_finite_double(F.col("threshold_text")),
        F.expr("case when rank_text <> '3' then 'gte' end"))
    return exploded.withColumn("violation", violation).filter("violation is not null").groupBy("dataset_id", "violation").agg(
        F.count("*").alias("n"))


@query("freshness_state", """
SELECT batch_index, CASE WHEN TIMESTAMP '2024-01-15 00:00:00' < expires_at THEN 'fresh' ELSE 'stale' END AS state FROM v_batches""")
def freshness_state(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return Inputs(spark, sf).view("v_batches").select(
        "batch_index", V.freshness_state(F.col("expires_at").cast("timestamp_ntz"), now).alias("state"))


@query("escape_formula", """
SELECT p_partkey, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(10), chr(13), '''') THEN '''' || cell ELSE cell END AS cell
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN '''' WHEN 3 THEN chr(9) WHEN 4 THEN '' ELSE '-' END || CASE WHEN p_type = 'SMALL' THEN '' ELSE p_name END AS cell FROM part) AS t""")
def escape_formula(spark, sf):
    part = Inputs(spark, sf).table("part").selectExpr(
        "p_partkey", "case p_size % 6 when 0 then '=' when 1 then '@' when 2 then '\\'' when 3 then chr(9) when 4 then '' else '-' end"
        " || case when p_type = 'SMALL' then '' else p_name end as cell")
    return part.select("p_partkey", T.escape_formula(F.col("cell")).alias("cell"))


# --- record level ------------------------------------------------------------------------------

@query("record_numbering", """
SELECT dataset_id, row_number, pos, 'record-' || lpad(CAST(no AS VARCHAR), CAST(greatest(6, length(CAST(no AS VARCHAR))) AS INT), '0') AS record_id FROM (
  SELECT dataset_id, row_number, CAST(pos AS BIGINT) AS pos, row_number() OVER (PARTITION BY dataset_id ORDER BY row_number, pos) AS no FROM v_assign) AS t""")
def record_numbering(spark, sf):
    return K.number_records(Inputs(spark, sf).records(), keep=("row_number", "pos")).select(
        "dataset_id", "row_number", F.col("pos").cast("bigint").alias("pos"), K.record_id(F.col("record_no")).alias("record_id"))


_DUP_KEY = ("dataset_id, sample_id, sequence_id, ko_id, raw_ko, mark, status, score, threshold, domain_start, domain_end, "
            "seq_name, label, score_text, threshold_text, start_text, end_text, note")


@query("duplicate_records", f"""
SELECT dataset_id, row_number, CAST(pos AS BIGINT) AS pos, first_row_number FROM (
  SELECT *, row_number() OVER w AS rn, first_value(row_number) OVER w AS first_row_number
  FROM v_assign WINDOW w AS (PARTITION BY {_DUP_KEY} ORDER BY row_number, pos)) AS t WHERE rn > 1""")
def duplicate_records(spark, sf):
    return K.duplicate_records(Inputs(spark, sf).records()).select(
        "dataset_id", "row_number", F.col("pos").cast("bigint").alias("pos"), "first_row_number")


@query("duplicate_skipped_rows", """
SELECT dataset_id, row_number, first_row_number FROM (
  SELECT dataset_id, row_number, row_number() OVER w AS rn, first_value(row_number) OVER w AS first_row_number FROM v_parsed WHERE skipped
  WINDOW w AS (PARTITION BY dataset_id, seq_name, label, score_text, threshold_text, mark, start_text, end_text, note ORDER BY row_number)) AS t WHERE rn > 1""")
def duplicate_skipped_rows(spark, sf):
    skipped = Inputs(spark, sf).parsed().filter("skipped")
    return K.skipped_duplicates(skipped).select("dataset_id", "row_number", "first_row_number")


_SLOT = "CASE WHEN domain_start IS NOT NULL THEN 'domain:' || domain_start || ':' || domain_end ELSE 'sequence' END"


@query("conflict_slot", f"SELECT dataset_id, sample_id, sequence_id, {_SLOT} AS slot, count(*) AS n FROM v_assign GROUP BY ALL")
def conflict_slot(spark, sf):
    return Inputs(spark, sf).records().groupBy(
        "dataset_id", "sample_id", "sequence_id", K.sequence_or_domain_slot().alias("slot")).agg(F.count("*").alias("n"))


@query("conflicting_assignments", f"""
SELECT dataset_id, sample_id, sequence_id, slot, ko_id, status, row_number, CAST(pos AS BIGINT) AS pos FROM (
  SELECT *, min(row_number) OVER (PARTITION BY dataset_id, sample_id, sequence_id, slot) AS slot_first,
    min(row_number) OVER (PARTITION BY dataset_id, sample_id, sequence_id, slot, ko_id, status) AS own_first
  FROM (SELECT *, {_SLOT} AS slot FROM v_assign) AS u) AS t WHERE slot_first < row_number AND own_first = row_number""")
def conflicting_assignments(spark, sf):
    return K.conflicting_assignments(Inputs(spark, sf).records(), K.sequence_or_domain_slot()).select(
        "dataset_id", "sample_id", "sequence_id", "slot", "ko_id", "status", "row_number", F.col("pos").cast("bigint").alias("pos"))


@query("slot_and_key_plugin", """
SELECT dataset_id, conflicts, duplicates FROM (
  SELECT dataset_id, count(*) FILTER (WHERE slot_first < row_number AND own_first = row_number) AS conflicts,
    count(*) FILTER (WHERE key_rank > 1) AS duplicates FROM (
  SELECT *, min(row_number) OVER (PARTITION BY dataset_id, sample_id, sequence_id, domain_start, domain_end, rank_text) AS slot_first,
    min(row_number) OVER (PARTITION BY dataset_id, sample_id, sequence_id, domain_start, domain_end, rank_text, ko_id, status) AS own_first,
    row_number() OVER (PARTITION BY dataset_id, ko_id, CASE WHEN ko_id IS NULL THEN trim(raw_ko) END ORDER BY row_number, pos) AS key_rank
  FROM v_assign) AS t GROUP BY dataset_id) AS s""")
def slot_and_key_plugin(spark, sf):
    """A rank-or-domain slot and a KO-only duplicate key in place of the format's own rules."""
    data = Inputs(spark, sf)
    rows = data.view("v_rows").selectExpr(
        "dataset_id", "sample_id", "row_number", "seq_name as name", "label as predict_label", "score_text as probability",
        "threshold_text as threshold", "mark as annotate", "start_text as start", "end_text as end", "rank_text")
    records = K.detailed_records(K.parse_detailed(rows)).withColumn(
        "rank", F.filter("evidence", lambda cell: cell["name"] == "rank_text")[0]["value"].cast("bigint"))
    plain = records.withColumn("invalid_text", F.when(F.col("ko_id").isNull(), T.strip(F.col("raw_ko"))))
    conflicts = K.conflict_keys(records, K.SLOT_RULES["explicit"]()).groupBy("dataset_id").agg(F.sum("conflict_records").alias("conflicts"))
    duplicates = K.duplicate_groups(plain, ("dataset_id", "ko_id", "invalid_text")).groupBy("dataset_id").agg(
        F.sum(F.col("copies") - 1).alias("duplicates"))
    return conflicts.join(duplicates, "dataset_id", "full").na.fill(0)


@query("decision_policy_plugin", """
SELECT dataset_id, CASE WHEN ko_id IS NULL THEN 'invalid' WHEN score >= 0.5 THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n FROM v_assign GROUP BY ALL""")
def decision_policy_plugin(spark, sf):
    """A user policy: a fixed score cut, independent of the source threshold."""
    fixed_cut = P.Policy("fixed_cut", "1", ("detailed_csv",), lambda e: F.when(
        e.ko_id.isNull(), P.outcome("invalid", "invalid_ko_identifier")).when(
        e.score >= 0.5, P.outcome("accepted", "above_cut")).otherwise(P.outcome("rejected", "below_cut")))
    P.register_policy(fixed_cut)
    records = K.detailed_records(Inputs(spark, sf).parsed(), P.policy_for("fixed_cut", "detailed_csv"))
    return records.groupBy("dataset_id", "status").agg(F.count("*").alias("n"))


@query("status_counts", """
SELECT d.dataset_id, s.status, count(a.dataset_id) AS n FROM v_datasets d
JOIN (SELECT unnest(['accepted', 'rejected', 'unclassified', 'invalid']) AS status) s ON true
LEFT JOIN v_assign a ON a.dataset_id = d.dataset_id AND a.status = s.status GROUP BY ALL""")
def status_counts(spark, sf):
    data = Inputs(spark, sf)
    return K.status_counts(data.records(), data.view("v_datasets"))


@query("accepted_kos", "SELECT sample_id, ko_id FROM v_accepted")
def accepted_kos(spark, sf):
    return Inputs(spark, sf).accepted()


@query("rejected_kos", "SELECT DISTINCT sample_id, ko_id FROM v_assign WHERE status = 'rejected'")
def rejected_kos(spark, sf):
    return E.rejected_kos(Inputs(spark, sf).records(), "sample_id")


_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {', '.join(K.RECORD_ORDER)}) AS no FROM v_assign"


@query("records_by_ko", """
SELECT dataset_id, ko_id, CAST((no - 1) // 65536 AS BIGINT) AS list_no, string_agg(CAST(no AS VARCHAR), ';' ORDER BY no) AS record_nos, count(*) AS n
FROM v_numbered WHERE ko_id IS NOT NULL GROUP BY 1, 2, 3""", {"v_numbered": _NUMBERED})
def records_by_ko(spark, sf):
    return E.records_by_ko(K.number_records(Inputs(spark, sf).records(), K.RECORD_ORDER, keep=("ko_id",))).withColumn(
        "record_nos", F.array_join(F.col("record_nos").cast("array<string>"), ";"))


@query("records_by_sequence", """
SELECT dataset_id, sample_id, sequence_id, CAST((no - 1) // 65536 AS BIGINT) AS list_no, string_agg(CAST(no AS VARCHAR), ';' ORDER BY no) AS record_nos, count(*) AS n
FROM v_numbered GROUP BY 1, 2, 3, 4""", {"v_numbered": _NUMBERED})
def records_by_sequence(spark, sf):
    return E.records_by_sequence(K.number_records(Inputs(spark, sf).records(), K.RECORD_ORDER, keep=("sample_id", "sequence_id"))).withColumn(
        "record_nos", F.array_join(F.col("record_nos").cast("array<string>"), ";"))


_REPORT = f"""
SELECT d.dataset_id, input_rows, emitted_records, accepted_records, rejected_records, unclassified_records, invalid_records, skipped_rows,
  CAST(coalesce(dup, 0) + coalesce(sdup, 0) AS BIGINT) AS duplicate_count, CAST(coalesce(conflicts, 0) AS BIGINT) AS conflict_count
FROM (SELECT dataset_id, count(*) AS input_rows, count(*) FILTER (WHERE skipped) AS skipped_rows FROM v_parsed GROUP BY 1) d
JOIN (SELECT dataset_id, count(*) AS emitted_records, count(*) FILTER (WHERE status = 'accepted') AS accepted_records, count(*) FILTER (WHERE status = 'rejected') AS rejected_records,
   count(*) FILTER (WHERE status = 'unclassified') AS unclassified_records, count(*) FILTER (WHERE status = 'invalid') AS invalid_records FROM v_assign GROUP BY 1) r USING (dataset_id)
LEFT JOIN (SELECT dataset_id, sum(c - 1) AS dup FROM (SELECT {_DUP_KEY}, count(*) AS c FROM v_assign GROUP BY ALL) AS x GROUP BY 1) dd USING (dataset_id)
LEFT JOIN (SELECT dataset_id, sum(c - 1) AS sdup FROM (SELECT dataset_id, seq_name, label, score_text, threshold_text, mark, start_text, end_text, note, count(*) AS c
   FROM v_parsed WHERE skipped GROUP BY ALL) AS y GROUP BY 1) sd USING (dataset_id)
LEFT JOIN (SELECT dataset_id, count(*) AS conflicts FROM (
  SELECT *, min(row_number) OVER (PARTITION BY dataset_id, sample_id, sequence_id, slot) AS slot_first,
    min(row_number) OVER (PARTITION BY dataset_id, sample_id, sequence_id, slot, ko_id, status) AS own_first
  FROM (SELECT *, {_SLOT} AS slot FROM v_assign) AS u) AS t WHERE slot_first < row_number AND own_first = row_number GROUP BY 1) cc USING (dataset_id)"""


def report_of(parsed):
    return K.import_report(parsed, K.detailed_records(parsed), parsed.filter("skipped"), K.sequence_or_domain_slot())


@query("import_report", "SELECT * FROM v_report", {"v_report": _REPORT})
def import_report(spark, sf):
    return report_of(written(Inputs(spark, sf).parsed()))


@query("analysis_view_summary", f"""
SELECT dataset_id, input_rows, emitted_records AS assignment_count, accepted_records, skipped_rows,
  (SELECT count(DISTINCT ko_id) FROM v_assign a WHERE a.dataset_id = r.dataset_id AND status = 'accepted') AS accepted_unique_kos,
  (SELECT CAST(sum(n) AS BIGINT) FROM v_diag q WHERE q.dataset_id = r.dataset_id) AS diagnostic_count FROM v_report r""", {"v_report": _REPORT, "v_diag": f"""
SELECT dataset_id, CAST(skipped AS INT) + CASE WHEN skipped THEN 0 ELSE
  CAST(trim(score_text) <> '' AND score_n IS NULL AS INT) + CAST(trim(threshold_text) <> '' AND threshold_n IS NULL AS INT) + CAST(coalesce(score_n NOT BETWEEN 0 AND 1, false) AS INT)
  + CAST(coalesce(threshold_n NOT BETWEEN 0 AND 1, false) AS INT) + CAST(trim(start_text) <> '' AND start_n IS NULL AS INT) + CAST(trim(end_text) <> '' AND end_n IS NULL AS INT)
  + CAST((start_n IS NULL) <> (end_n IS NULL) AS INT) + CAST(coalesce(end_n < start_n, false) AS INT) + CAST({_FIRST} IS NULL AND trim(label) <> '' AS INT)
  + CAST({_FIRST} IS NOT NULL AND mark = 'x' AS INT) + CAST(mark = '*' AND coalesce(score < threshold, false) AS INT) END AS n FROM v_parsed"""})
def analysis_view_summary(spark, sf):
    data = Inputs(spark, sf)
    parsed = data.parsed()
    return E.analysis_view_summary(parsed, K.detailed_records(parsed))


@query("evidence_audit", """
SELECT r.*, records_with_valid_ko, unique_valid_kos, accepted_unique_kos, rejected_unique_kos, source_count FROM v_report r
JOIN (SELECT dataset_id, count(*) FILTER (WHERE ko_id IS NOT NULL) AS records_with_valid_ko, count(DISTINCT ko_id) AS unique_valid_kos,
  count(DISTINCT CASE WHEN status = 'accepted' THEN ko_id END) AS accepted_unique_kos, count(DISTINCT CASE WHEN status = 'rejected' THEN ko_id END) AS rejected_unique_kos
  FROM v_assign GROUP BY 1) u USING (dataset_id) JOIN (SELECT dataset_id, count(*) AS source_count FROM v_sources GROUP BY 1) s USING (dataset_id)""", {"v_report": _REPORT})
def evidence_audit(spark, sf):
    data = Inputs(spark, sf)
    parsed = written(data.parsed())
    return E.evidence_audit(K.detailed_records(parsed), data.view("v_sources"), report_of(parsed))
