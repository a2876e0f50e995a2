"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from relgrove.llm import decontaminate, exact_dedup, extract, licenses, line_dedup, packing, quality, sharding, simhash, warc
from relgrove.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's words in tiles of five words or more."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    words = F.aggregate("tiles", F.lit(0), lambda n, t: n + t["words"])
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"), words.alias("words"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of licence sentences and rules in each document, in the order of its text; null and empty texts have none."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "license", "kind", F.concat_ws(" ", "sentences").alias("sentences"), F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; null and empty texts have fingerprint zero, which links like any other."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back; null html is an empty payload, of equal payloads the smallest page_id is the response."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page; null html and pages without any text give an empty one."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document by trees fitted on labels that are not held out; null and empty texts have a score, too."""
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for each; null counts as empty, all empty texts are equal, the largest id stays."""
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of 2048 tokens; null and empty texts are the end id alone."""
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without the chunks of lines that stand in an earlier one; null counts as an empty line."""
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of each document by its id; a null id is placed as the empty key."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontamination, op2_license_scan, op3_simhash, op4_warc, op5_html_extraction, op6_quality, op7_exact_dedup, op8_packing, op9_line_dedup, op10_sharding)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(hex, CAST(k * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS g FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g[CAST(k // 4 + 1 AS BIGINT)] // [32768, 1024, 32, 1][CAST(k % 4 + 1 AS BIGINT)]) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

_OP7 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_EVERY = line_dedup.every_chunking()

_OP9 = f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM a),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 14) AS BIGINT) AS h FROM l),
v AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h AS v FROM h),
b AS (SELECT *, CASE WHEN i = 1 THEN {_EVERY} ELSE (v | (v >> 1)) & {_EVERY} END AS b FROM v),
s AS (SELECT doc_id, i, list(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {line_dedup.MAX_LINES} FOLLOWING)
 || list_transform(range({line_dedup.MAX_LINES}), lambda x: {_EVERY}) AS bs FROM b),
n AS (SELECT doc_id, i, bs, unnest(range(2, {line_dedup.MAX_LINES} + 1)) AS n FROM s),
c AS (SELECT doc_id, i, n FROM n WHERE list_reduce(list_transform(bs[1:n], lambda x, k: CASE WHEN k = 1 THEN x ELSE {_EVERY} & ~x END), lambda x, y: x & y) & bs[n + 1] != 0
 UNION ALL SELECT doc_id, i, 1 FROM l WHERE length(line) - length(replace(line, ' ', '')) >= {line_dedup.LONG_LINE}),
k AS (SELECT c.doc_id, c.i, c.n, string_agg(l.line, chr(10) ORDER BY l.i) AS chunk FROM c JOIN l ON l.doc_id = c.doc_id AND l.i >= c.i AND l.i < c.i + c.n
 GROUP BY c.doc_id, c.i, c.n HAVING count(*) = c.n),
r AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, chunk ORDER BY doc_id, i) AS rn FROM k),
g AS (SELECT DISTINCT doc_id, i + unnest(range(n)) AS i FROM r WHERE rn > 1),
j AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS removed_lines,
 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM j GROUP BY doc_id
"""


def _op10() -> str:
    """The lookup table as a string of two hexadecimal digits for each slot; hashing and lookup are SQL."""
    owners = "".join(f"{s:02x}" for s in sharding.lookup_table(sharding.shard_names(sharding.SHARDS)))
    return f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST('0x' || substr('{owners}', slot * 2 + 1, 2) AS INTEGER) AS shard FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": _OP4, "op7_exact_dedup": _OP7, "op9_line_dedup": _OP9, "op10_sharding": _op10()}
