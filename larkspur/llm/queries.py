"""Queries of the training-data operators over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .decontam import UNSPACED
from .licenses import license_sql

BPE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_ids

    return language_ids(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
  )
),
repeated AS (SELECT key, max(doc_id) AS home FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE r.key IS NOT NULL AND r.home <> l.doc_id) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.key IS NULL OR r.home = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON l.key = r.key GROUP BY l.doc_id
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warczip import archived_pages

    return archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM q
"""


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2))),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY 1),
l AS (SELECT doc_id, host, line, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key,
  len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS words FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
lw AS (SELECT * FROM l WHERE words > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY 1),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY 1),
boiler AS (SELECT k.host, k.key FROM (SELECT host, key, count(DISTINCT doc_id) AS n FROM lw GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 10) k JOIN hosts ON hosts.host = k.host WHERE k.n > hosts.n * 0.01 OR k.n >= 1000),
lost AS (SELECT lw.doc_id, sum(words) AS n FROM lw JOIN boiler b ON b.host = lw.host AND b.key = lw.key GROUP BY 1),
q AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM d JOIN w ON w.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boilerplate_words >= 0.3 * n_words AND n_words - n_boilerplate_words >= 50) AS kept FROM q
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    packed = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Every alignment of every document and item is counted; no seed takes part. Characters of unspaced scripts are tokens.
OP10_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '(UNSPACED)', ' \\1 ', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '(UNSPACED)', ' \\1 ', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
bt AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS p, len(w) AS n FROM b),
hits AS (SELECT doc_id, item_id, dt.p - bt.p AS shift FROM dt JOIN bt ON dt.t = bt.t GROUP BY ALL HAVING count(*) * 100 >= 80 * least(any_value(n), 16)),
places AS (SELECT h.doc_id, h.item_id, h.shift, k, len(b.w) AS n, CASE WHEN k + shift >= 1 AND k + shift <= len(d.w) AND d.w[k + shift] = b.w[k] THEN 1 ELSE 0 END AS same
  FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id, unnest(generate_series(1, len(b.w))) AS u(k)),
runs AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS s FROM places),
best AS (SELECT doc_id, item_id, any_value(n) AS n, max(CAST(s AS DOUBLE) / least(n, 16)) AS overlap FROM runs WHERE k <= greatest(n - 15, 1) GROUP BY 1, 2),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(overlap) AS overlap FROM best WHERE overlap * 100 >= CASE WHEN n < 10 THEN 100 ELSE 80 END GROUP BY 1)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(overlap, 0.0) AS overlap FROM d LEFT JOIN found f ON f.doc_id = d.doc_id
""".replace("UNSPACED", UNSPACED)


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compaction import compaction_plan

    return compaction_plan(table(spark, sf_dir, "documents"))


# DuckDB has no crc32: it is folded bit by bit from the decimal id. The greedy chain is followed file by file.
OP11_SQL = """
WITH RECURSIVE c AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS h
  FROM documents WHERE doc_id IS NOT NULL
),
r AS (SELECT *, CAST(floor(doc_id / 2000) AS BIGINT) AS block, least(h % 8, (h // 8) % 8) AS slot FROM c),
m AS (SELECT *, (h // 64) % 100 < 9 * ((slot + block) % 8) AS deleted, octet_length(encode(text)) AS size FROM r),
files AS (SELECT source, block, slot, count(*) AS n, sum(size) AS bytes, count(*) FILTER (WHERE NOT deleted) AS live_rows, coalesce(sum(size) FILTER (WHERE NOT deleted), 0) AS live_bytes,
  100 * count(*) FILTER (WHERE deleted) >= 50 * count(*) AS dirty, 4 * sum(size) < 3 * 131072 AS small FROM m GROUP BY ALL),
packed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY block, slot) AS i FROM files WHERE dirty OR small),
chain AS (
  SELECT source, i, live_bytes AS held, 1 AS grp FROM packed WHERE i = 1
  UNION ALL
  SELECT p.source, p.i, CASE WHEN c.held + p.live_bytes > 131072 THEN p.live_bytes ELSE c.held + p.live_bytes END, CASE WHEN c.held + p.live_bytes > 131072 THEN c.grp + 1 ELSE c.grp END
  FROM chain c JOIN packed p ON p.source = c.source AND p.i = c.i + 1
),
groups AS (SELECT source, grp, count(*) AS n_files, sum(bytes) AS bytes, sum(live_bytes) AS live_bytes, sum(live_rows) AS live_rows, bool_or(dirty) AS dirty, arg_min(block, i) AS block, arg_min(slot, i) AS slot
  FROM packed JOIN chain USING (source, i) GROUP BY ALL),
queue AS (SELECT *, row_number() OVER w - 1 AS place, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(bytes) OVER () AS whole FROM groups WHERE n_files > 1 OR dirty WINDOW w AS (ORDER BY n_files DESC, bytes, source, block, slot)),
rewritten AS (SELECT * FROM queue WHERE 100 * upto <= 30 * whole),
homes AS (SELECT f.source, f.block, f.slot, coalesce(w.block, f.block) AS home_block, coalesce(w.slot, f.slot) AS home_slot, w.block IS NULL AS untouched
  FROM files f LEFT JOIN (SELECT p.source, p.block AS b, p.slot AS s, rw.block, rw.slot FROM packed p JOIN chain ch USING (source, i) JOIN rewritten rw ON rw.source = p.source AND rw.grp = ch.grp) w ON w.source = f.source AND w.b = f.block AND w.s = f.slot),
digests AS (SELECT h.source, home_block AS block, home_slot AS slot, sha256(string_agg(doc_id || ':' || text || chr(10), '' ORDER BY doc_id, text)) AS live_sha256
  FROM m JOIN homes h USING (source, block, slot) WHERE NOT deleted GROUP BY ALL),
units AS (SELECT source, block, slot, n_files, live_rows, bytes, bytes + live_bytes + 4096 * n_files AS cost, place // 4 AS wave, live_bytes FROM rewritten
  UNION ALL SELECT f.source, f.block, f.slot, 1, f.live_rows, f.bytes, NULL, NULL, f.live_bytes FROM files f JOIN homes h USING (source, block, slot) WHERE h.untouched)
SELECT u.source, CAST(u.block AS BIGINT) AS block, CAST(u.slot AS BIGINT) AS slot, CAST(n_files AS BIGINT) AS n_files, CAST(live_rows AS BIGINT) AS live_rows, CAST(bytes AS BIGINT) AS bytes,
  CAST(cost AS BIGINT) AS cost, CAST(wave AS BIGINT) AS wave, coalesce(live_sha256, sha256('')) AS live_sha256, CAST(live_bytes AS BIGINT) AS live_bytes
FROM units u LEFT JOIN digests d USING (source, block, slot)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenalign import aligned

    return aligned(table(spark, sf_dir, "documents"), BPE_VOCABULARY, PIECE_MODEL)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_labels

    return license_labels(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language": op1_language, "op2_lines": op2_lines, "op3_secrets": op3_secrets, "op4_warc": op4_warc, "op5_neardup": op5_neardup, "op6_bpe": op6_bpe, "op7_pii": op7_pii, "op8_quality": op8_quality, "op9_sharding": op9_sharding, "op10_decontamination": op10_decontamination, "op11_compaction": op11_compaction, "op12_alignment": op12_alignment, "op13_licenses": op13_licenses}


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": OP2_SQL, "op4_warc": OP4_SQL, "op8_quality": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_compaction": OP11_SQL, "op13_licenses": license_sql()}
