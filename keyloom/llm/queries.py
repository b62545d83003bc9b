"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, html_main_text, lm_score, mixing, quality, simhash, suffix_dedup, tool_calls, warc_fixity, winnow
from keyloom.llm.common import table


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_main_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of all pages' records in which the digest of a page's id decides on planted damage.

    One record in 16 has a byte changed, one in 16 is lost; the audit must name exactly these.
    """
    pages = table(spark, sf_dir, "pages")
    fate = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 1)
    changed = F.when(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 1) == "0", F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit("~").cast("binary"), F.expr("substring(record, octet_length(record) - 3, 4)"))).otherwise(F.col("record"))
    replica = warc_fixity.records(pages, changed).where(fate != "1")
    return warc_fixity.audit(warc_fixity.records(pages), replica)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked(*tool_calls.turns(table(spark, sf_dir, "conversations")), further=True)


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pseudo_likelihood, op2_suffix_dedup, op3_benchmark_tiling, op4_simhash_pivots, op5_page_differencing, op6_quality_trees, op7_merkle_audit, op8_winnowing, op9_tool_calls, op10_pfair_mixing)}


#: Every string of 100 bytes (as hex) in the order of documents and starts; all but the first of equal ones are covered.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
p AS (SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS piece
      FROM spans s JOIN d USING (doc_id)),
x AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last, string_agg(piece, '' ORDER BY a) AS pieces FROM p GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(pieces || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

#: What the article element of these pages holds, block by block.
OP5_SQL = r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>') AS parts FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

OP7_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1024 AS file, substr(md5(CAST(page_id AS VARCHAR)), 1, 1) AS fate,
         strlen('WARC/1.1' || 'WARC-Type: resource' || 'WARC-Date: 1970-01-01T00:00:00Z' || 'WARC-Target-URI: ' || url || 'WARC-Record-ID: <urn:page:' || page_id || '>'
                || 'Content-Type: text/html' || 'Content-Length: ' || strlen(html) || html) + 8 * 2 + 4 AS length
  FROM pages)
SELECT * FROM (
  SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         length, CASE fate WHEN '0' THEN 'corrupt' WHEN '1' THEN 'missing' ELSE '' END AS kind FROM r)
WHERE kind <> ''
"""

OP9_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id FROM conversations),
calls AS (SELECT t.*, p.id AS known, CASE WHEN t.turn >= 2 THEN t.conv_id || ':' || (t.turn - 2) END AS after
          FROM t LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn = t.turn - 2 AND p.role IN ('user', 'system')
          WHERE t.role IN ('user', 'system')),
lv(conv_id, turn, level) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) FROM calls WHERE known IS NULL
  UNION ALL SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN calls c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2 AND c.known IS NOT NULL),
res AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS id FROM t WHERE role NOT IN ('user', 'system')),
m AS (
  SELECT c.conv_id, c.id AS call_id, c.turn AS place, lv.level, CASE WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
         length(c.text) > 0 AS valid, c.after, c.role, c.text, r.text AS content
  FROM calls c JOIN lv USING (conv_id, turn) LEFT JOIN res r ON r.id = c.id
  UNION ALL
  SELECT r.conv_id, r.id, r.turn, NULL, 'orphan', NULL, NULL, NULL, NULL, r.text FROM res r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.id = r.id))
SELECT conv_id, call_id, place, level, status, valid, CASE WHEN valid THEN '' WHEN valid IS NULL THEN '' ELSE '$.text: shorter than 1' END AS problems,
  '{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":'
  || CASE WHEN status = 'orphan' THEN 'null' ELSE '{"role":"' || role || '","text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || place || '}' END
  || ',"conversation":' || conv_id || ',"id":"' || call_id || '","level":' || coalesce(CAST(level AS VARCHAR), 'null')
  || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '","tool":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '"reply"' END || '}' AS json
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op5_page_differencing": OP5_SQL, "op7_merkle_audit": OP7_SQL, "op9_tool_calls": OP9_SQL}
