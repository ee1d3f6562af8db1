"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.llm import (
    chat, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, recurrent_lm, secrets, token_alignment, token_counts, vector_codes, warc)
from orthoflow.llm.common import read_table, shared_folder
from orthoflow.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op3_exact_dedup", r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY norm)
""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, folder, "documents", "doc_id", "text"))


@query("op7_near_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
rows_of AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
firsts AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2),
node_rows AS (SELECT r.doc_id, r.n, hash(r.g) AS g FROM rows_of r JOIN firsts f USING (doc_id)),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM node_rows a JOIN node_rows b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM firsts UNION SELECT l.v, r.seen FROM reach r JOIN links l ON l.u = r.node WHERE r.seen < l.v),
labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY node),
named AS (SELECT s.doc_id, len(s.s) AS n, l.label FROM sets s LEFT JOIN firsts f ON f.s = list_sort(s.s) LEFT JOIN labels l ON l.node = f.doc_id)
SELECT doc_id, n AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept FROM named
""")
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_components(read_table(spark, folder, "documents", "doc_id", "text"), width=3, num=85, den=100)


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "labels"))


@query("op6_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM lines),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT e.*, coalesce(e.doc_id > s.first_doc, false) AS gone FROM keyed e LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    kept = line_dedup.dedup_lines(docs, line_dedup.insert(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_mix_sources", r"""
WITH RECURSIVE rated AS (
  SELECT source AS key, CAST(ceil(count(*) / 4) AS HUGEINT) AS b, CAST(floor(sqrt(count(*)) * 1048576 + 0.5) AS HUGEINT) AS w
  FROM documents GROUP BY source),
sized AS (SELECT *, w * 400 < sum(w) OVER () AS small FROM rated),
entries AS (
  SELECT 1 AS o, key, b, w FROM sized WHERE NOT small
  UNION ALL SELECT 0, '', sum(b), sum(w) FROM sized WHERE small HAVING count(*) > 0),
listed AS (
  SELECT *, sum(b) OVER u + ((sum(w) OVER () - sum(w) OVER u) * b + w - 1) // w AS d, row_number() OVER (ORDER BY o, key) - 1 AS s
  FROM entries WINDOW u AS (ORDER BY CAST(b AS DOUBLE) / CAST(w AS DOUBLE), o, key)),
cuts AS (
  SELECT unnest(range(CAST((total + 399) // 400 AS BIGINT) + 1)) AS c, total FROM (SELECT sum(b) AS total FROM listed)),
live AS (
  SELECT c, least(CAST(c AS HUGEINT) * 400, total) AS t, l.*,
         sum(CASE WHEN d <= least(CAST(c AS HUGEINT) * 400, total) THEN b ELSE 0 END) OVER (PARTITION BY c) AS gone,
         greatest(sum(CASE WHEN d <= least(CAST(c AS HUGEINT) * 400, total) THEN 0 ELSE w END) OVER (PARTITION BY c), 1) AS live
  FROM cuts, listed l),
targets AS (
  SELECT c, o, key, s, live, CASE WHEN d <= t THEN b ELSE w * (t - gone) // live END AS whole,
         CASE WHEN d <= t THEN 0 ELSE w * (t - gone) % live END AS rest FROM live),
ends AS (
  SELECT c, o, key, s, whole + (2 * sum(rest) OVER p + live) // (2 * live) - (2 * (sum(rest) OVER p - rest) + live) // (2 * live) AS n
  FROM targets WINDOW p AS (PARTITION BY c ORDER BY s)),
quotas AS (
  SELECT a.c, a.o, a.key, CAST(a.n AS BIGINT) AS first, CAST(z.n - a.n AS BIGINT) AS q,
         row_number() OVER (PARTITION BY a.c ORDER BY a.s) - 1 AS k
  FROM ends a JOIN ends z ON z.c = a.c + 1 AND z.s = a.s WHERE z.n > a.n),
cycles AS (SELECT c, list(q ORDER BY k) AS q, CAST(sum(q) AS BIGINT) AS size, count(*) AS n FROM quotas GROUP BY c),
edf(c, q, size, n, t, taken, k) AS (
  SELECT c, q, size, n, CAST(-1 AS BIGINT), list_transform(q, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM cycles
  UNION ALL
  SELECT c, q, size, n, t, list_transform(range(n), lambda j: taken[j + 1] + CASE WHEN j = k THEN 1 ELSE 0 END), k
  FROM (SELECT c, q, size, n, t + 1 AS t, taken, list_min(list_transform(range(n), lambda j:
          CASE WHEN taken[j + 1] < q[j + 1] AND taken[j + 1] * size // q[j + 1] <= t + 1
               THEN ((taken[j + 1] + 1) * size + q[j + 1] - 1) // q[j + 1] * n + j END)) % n AS k
        FROM edf WHERE t + 1 < size)),
turns AS (
  SELECT o, key, first + row_number() OVER (PARTITION BY e.c, e.k ORDER BY t) - 1 AS block, 400 * e.c + t AS slot
  FROM edf e JOIN quotas u ON u.c = e.c AND u.k = e.k),
pool AS (
  SELECT key, block, row_number() OVER (ORDER BY CAST(2 * block + 1 AS DOUBLE) / CAST(w AS DOUBLE), key, block) - 1 AS turn
  FROM (SELECT key, w, unnest(range(CAST(b AS BIGINT))) AS block FROM sized WHERE small)),
slots AS (
  SELECT key, block, slot FROM turns WHERE o = 1
  UNION ALL SELECT p.key, p.block, t.slot FROM pool p JOIN turns t ON t.o = 0 AND t.block = p.turn),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k FROM documents)
SELECT d.doc_id, d.source, CAST(s.slot AS BIGINT) AS slot, CAST(s.block AS BIGINT) AS block, d.k % 4 AS place
FROM ranked d JOIN slots s ON s.key = d.source AND s.block = d.k // 4
""")
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, folder, "documents", "doc_id", "source"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(
        read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "benchmark", "item_id", "text"))


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, folder, "documents", "doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op2_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
written AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<</?SYS>>|\[/?INST\]|</?s>|<<TURN |<</TURN>>'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 18 + length(role) + len(regexp_extract_all(role, '[\\>]')) END AS chars FROM turns),
checked AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN CASE coalesce(lag(role) OVER w, '') WHEN '' THEN row_number() OVER w = 1 AND role IN ('system', 'user')
      WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END ELSE false END AS valid
  FROM written WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
spoken AS (SELECT * FROM turns WHERE role = 'assistant'),
learned AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS t FROM spoken GROUP BY conv_id)
SELECT w.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(length(any_value(t)), 0) AS BIGINT) AS loss_chars, sha256(coalesce(any_value(t), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (NOT valid) AS n_invalid
FROM checked w LEFT JOIN learned l USING (conv_id) GROUP BY w.conv_id
""")
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(turns.unionByName(probe))
    return chat.read_back(segments).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_invalid")


def _edit_log(docs: DataFrame) -> DataFrame:
    """Three edits for every document, from hashes: a replacement, a removal and an insertion."""
    def at(seed):
        return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.length("text").cast("long") + 1)

    def edit(start, length, insert):
        return F.struct(start.alias("start"), (start + length).alias("stop"), insert.alias("insert"))

    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("edits", F.array(
        edit(at(1), F.lit(9).cast("long"), F.concat(F.lit(" edit "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        edit(at(2), F.lit(40).cast("long"), F.lit("")),
        edit(at(3), F.lit(0).cast("long"), F.lit("A new line.\n"))))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    trees = token_counts.build_trees(_edit_log(read_table(spark, folder, "documents", "doc_id", "text")))
    edited = token_counts.apply_edits(trees.withColumn("n_tokens_before", F.col("n_tokens")))
    return edited.select(
        "doc_id", "n_tokens_before", F.size("edits").cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"),
        F.length("text").cast("long").alias("n_chars_after"), "n_encoded", F.sha2("text", 256).alias("text_sha256"))


@query("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return recurrent_lm.lm_scores(read_table(spark, folder, "documents", "doc_id", "text"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment(read_table(spark, folder, "documents", "doc_id", "text"))


def _codes_sql() -> str:
    """Integer k-means per part, one pair of steps for each round."""
    steps = ["""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, range(8) t(p)),
books0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16)"""]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min(d * 16 + e) % 16 AS e, min(d) AS d
  FROM (SELECT r, p, e, x, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS d
        FROM parts JOIN books{k} USING (p)) GROUP BY r, p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
books{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM books{k} b LEFT JOIN (
    SELECT p, e, list(y ORDER BY i) AS y FROM (
      SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM near{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, e, i)
    GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH {",".join(steps)},
codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{vector_codes.ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM books{vector_codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


@query("op13_warc", r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keep FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN true END AS payload_matches
FROM k
""")
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{shared_folder(spark)}/archive"
    warc.write_archive(read_table(spark, folder, "pages", "page_id", "url", "html"), archive)
    return warc.archived_pages(spark, archive)
