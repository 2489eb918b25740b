"""The registered queries of the operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestra.llm import decontamination, language_id, media_ts, ngram_join, packing, pii, substring_dedup, token_counts, url_filter, warc
from nestra.llm.common import scratch, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf_dir, "documents")).drop("n_spanning_links")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "lang", "text"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(language_id.is_held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.filter_urls(pages, url_filter.listed_urls(pages)).drop("listed")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    captures = warc.read_captures(spark, folder, with_payload=False)
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), "response.refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit(docs)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS if kind != "secret"]
    sums = [F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans")]
    return found.select("doc_id", *counts, *sums, F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = media_ts.read_media(media_ts.media_table(table(spark, sf_dir, "documents")), with_payload=False)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("units="), F.size("pts")),
        F.concat(F.lit("pts="), F.array_min("pts"), F.lit("-"), F.array_max("pts")),
        F.concat(F.lit("random_access="), F.array_join(F.col("random_access").cast("array<string>"), ",")),
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("discontinuities="), F.col("discontinuities")),
    )
    return decoded.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_SQL_JOIN = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i : i + 3], ' ') for i in generate_series(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
), hashed AS (
  SELECT doc_id, hash(s) AS s FROM shingles
), sizes AS (
  SELECT doc_id, count(*) AS n FROM hashed GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM hashed a JOIN hashed b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM split
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT split.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = split.doc_id) AS component_id
FROM split LEFT JOIN sizes USING (doc_id)
"""

_SQL_WARC = """
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digested AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM sized
), judged AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response_id FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND response_id <> page_id THEN response_id END AS refers_to
FROM judged
"""

_SQL_URL = r"""
WITH parsed AS (
  SELECT page_id, regexp_extract(html, '<footer>&copy; ([^ <]*)', 1) AS credit,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, credit,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), judged AS (
  SELECT page_id, host, path, credit,
         CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
         CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') ||
              regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') END AS canonical
  FROM cut
), listed AS (
  SELECT DISTINCT canonical FROM judged
  WHERE list_has_any(string_split(credit, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'free-bets']) AND canonical IS NOT NULL
)
SELECT j.page_id, j.host, j.path, j.rule,
       CASE WHEN j.rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
            WHEN j.rule IS NOT NULL THEN 'allow'
            WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN listed l ON j.canonical = l.canonical
"""


_SQL_REPEATS = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS p FROM split WHERE len(w) >= 35
), windows AS (
  SELECT r, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, unnest(generate_series(p, p + 34)) AS p FROM windows JOIN repeated USING (h)
), words AS (
  SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM split
), kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.p) FILTER (covered.p IS NULL) AS t, count(covered.p) AS n_removed
  FROM words LEFT JOIN covered ON words.r = covered.r AND words.p = covered.p GROUP BY words.r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_url_filter, op4_warc, op5_token_counts, op6_decontamination, op7_substring_dedup, op8_pii, op9_media_columns, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _SQL_JOIN, "op3_url_filter": _SQL_URL, "op4_warc": _SQL_WARC, "op7_substring_dedup": _SQL_REPEATS}
