"""The queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compact_windows, contamination, html_template, langid, line_quality, mixing, secret_scan, simhash, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_read(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(_read(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_read(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(_read(spark, sf_dir, "documents")).drop("host", "h", "removed")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_read(spark, sf_dir, "documents"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compact_windows.classes(_read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws("+", p["start"], p["words"])), ",")
    return found.select("doc_id", "class_id", spans.alias("passages"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "containment")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_read(spark, sf_dir, "documents"), n=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html_template, op3_warc, op4_secret_scan, op5_line_quality, op6_langid, op7_compact_windows, op8_contamination, op9_url_filter, op10_simhash)}

OP1_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS s FROM ranked),
rounds AS (
  SELECT 0 AS r, 1.5 * s / (SELECT sum(w) FROM ranked) AS level FROM total
  UNION ALL
  SELECT r + 1, ((SELECT 1.5 * s FROM total) - coalesce((SELECT sum(2.0 * source_size) FROM ranked WHERE 2.0 * source_size <= level * w), 0))
    / nullif((SELECT sum(w) FROM ranked WHERE 2.0 * source_size > level * w), 0)
  FROM rounds WHERE r < 60 AND level IS NOT NULL),
level AS (SELECT arg_max(level, r) AS level FROM rounds WHERE level IS NOT NULL),
plan AS (SELECT source, source_size, least(2.0 * source_size, level * w) AS target FROM ranked, level),
rated AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix|' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS coin
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
  CAST((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM rated
"""

OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.v,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.h) DESC, length(r.p) DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.h OR suffix(s.host, '.' || r.h)) AND prefix(s.path, r.p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.k = 1
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS i FROM d),
sized AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
trigram AS (
  SELECT r, i, concat_ws(' ', word, w2, w3) AS g FROM (
    SELECT r, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)) x
  WHERE w3 IS NOT NULL),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM trigram) x WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) s(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (
  SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r),
normal AS (SELECT r, lower(array_to_string(ws, ' ')) AS line, sum(len(ws)) AS n FROM worded GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT t) AS total FROM d GROUP BY source),
often AS (
  SELECT d.source, l.line FROM normal l JOIN d USING (r) JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source
  GROUP BY d.source, l.line HAVING count(DISTINCT d.t) >= 10 AND 100 * count(DISTINCT d.t) >= max(h.total)),
lost AS (
  SELECT r, sum(n) AS n FROM normal l JOIN d USING (r) JOIN often o ON d.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY r),
joined AS (
  SELECT doc_id, CAST(coalesce(s.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(s.word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN sized s USING (r) LEFT JOIN dups u USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN lost l USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_words <= n_words AS kept FROM joined
"""

OP3_SQL = r"""
WITH hashed AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS keeper FROM hashed)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM coded
"""

_SHINGLES = r"""list_filter(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '') AS w"""
_OF_WORDS = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END"
OP8_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_OF_WORDS}) AS s FROM (SELECT doc_id, {_SHINGLES} FROM documents WHERE text IS NOT NULL) x),
b AS (SELECT DISTINCT item_id, unnest({_OF_WORDS}) AS s FROM (SELECT item_id, {_SHINGLES} FROM benchmark WHERE text IS NOT NULL) x),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, CAST(count(*) AS DOUBLE) / max(n.n) AS containment FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING CAST(count(*) AS DOUBLE) / max(n.n) >= 0.8 - 1e-9
"""

ORACLE_SQL = {"op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op5_line_quality": OP5_SQL, "op8_contamination": OP8_SQL, "op9_url_filter": OP9_SQL}
