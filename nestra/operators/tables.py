"""Queries over flat tables: metrics, counts, compares, look-ups, cursors, functions; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nestra.functions.scalars import masked_url, retryable, snake_case
from nestra.operators.nested import table
from nestra.plans import contract
from nestra.sources.shared import numbered

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def keep_last_n(spark, d):
    last = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("r", F.row_number().over(last)).where("r <= 3").select("event_id", "user_id", "event_type")


@query("SELECT doc_id, substr(trim(text), 1, 32) AS head FROM documents WHERE trim(text) <> ''")
def truncate_text(spark, d):
    return table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", F.substring(F.trim("text"), 1, 32).alias("head"))


@query("""SELECT event_type AS method, count(*) AS calls, count(*) FILTER (value > 100) AS errors, floor(avg(value) * 1000 + 0.5) / 1000 AS avg_ms,
 coalesce(min(value), 0) AS min_ms, coalesce(max(value), 0) AS max_ms, sum(octet_length(encode(props))) AS bytes FROM events GROUP BY event_type""")
def call_metrics(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(
        F.count("*").alias("calls"), F.count_if(v > 100).alias("errors"), (F.floor(F.avg(v) * 1000 + 0.5) / 1000).alias("avg_ms"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("min_ms"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_ms"), F.sum(F.octet_length("props")).alias("bytes"),
    )


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') = 0 AS compatible FROM orders")
def summary_counts(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(status == "F").alias("done"), F.count_if(status == "O").alias("open"), (F.count_if(status == "P") == 0).alias("compatible"))


@query("SELECT coalesce(c_mktsegment, 'all') AS segment, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS negative FROM customer GROUP BY ROLLUP (c_mktsegment)")
def summary_rollup(spark, d):
    return table(spark, d, "customer").rollup("c_mktsegment").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("negative")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "total", "negative")


@query("SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('refund'), ('error')) AS k(kind) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) ON kind = event_type")
def zero_filled_counts(spark, d):
    kinds = spark.createDataFrame([("click",), ("view",), ("refund",), ("error",)], "kind string")
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.join(counts, kinds.kind == counts.event_type, "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS r
 FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL)) WHERE r = 1""")
def dominant_first_seen(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    best = counted.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("first_id")).alias("earlier"), "event_type")).alias("x"))
    return best.select("user_id", "x.event_type", "x.n")


@query("SELECT event_type, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS median, list_sort(list(value))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90 FROM events GROUP BY event_type")
def index_percentiles(spark, d):
    ranked = numbered(table(spark, d, "events").select("event_type", "value", "event_id"), "at", ["value"], ["event_type"])
    sizes = ranked.groupBy("event_type").agg(F.count("*").alias("n"))
    placed = ranked.join(sizes, "event_type").where((F.col("at") == F.floor(F.col("n") * 0.5)) | (F.col("at") == F.floor(F.col("n") * 0.9)))
    at = lambda q: F.max(F.when(F.col("at") == F.floor(F.col("n") * q), F.col("value")))
    return placed.groupBy("event_type").agg(at(0.5).alias("median"), at(0.9).alias("p90"))


@query("""SELECT coalesce(a.n_name, b.n_name) AS name, CASE WHEN b.n_name IS NULL THEN 'removed' WHEN a.n_name IS NULL THEN 'added' WHEN a.n_regionkey <> b.n_regionkey THEN 'changed' ELSE 'same' END AS change
 FROM (SELECT * FROM nation WHERE n_nationkey < 17) a FULL JOIN (SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey > 5) b ON a.n_name = b.n_name""")
def keyed_compare(spark, d):
    nation = table(spark, d, "nation")
    old = nation.where("n_nationkey < 17").select("n_name", "n_regionkey")
    new = nation.where("n_nationkey > 5").select("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    return contract.compare(old, new, ["n_name"], ["n_regionkey"]).select(F.col("n_name").alias("name"), "change")


@query("""SELECT o_orderkey, c_name, n_name, r_name, CASE WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' WHEN r_regionkey IS NULL THEN 'region' ELSE 'ok' END AS status
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 7 LEFT JOIN region ON n_regionkey = r_regionkey""")
def dependent_calls(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    calls = [("customer", customer, "o_custkey", "c_custkey"), ("nation", table(spark, d, "nation").where("n_nationkey <> 7"), "c_nationkey", "n_nationkey"), ("region", table(spark, d, "region"), "n_regionkey", "r_regionkey")]
    return contract.call_chain(orders, calls).select("o_orderkey", "c_name", "n_name", "r_name", "status")


@query("SELECT event_id, coalesce(target, 'fallback') AS target FROM events LEFT JOIN (VALUES ('click', 'ui'), ('view', 'ui'), ('purchase', 'billing')) AS r(kind, target) ON event_type = kind")
def route_fallback(spark, d):
    routes = spark.createDataFrame([("click", "ui"), ("view", "ui"), ("purchase", "billing")], "kind string, target string")
    return contract.route(table(spark, d, "events"), routes, "event_type", "kind", "target", "fallback").select("event_id", "target")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT c_nationkey AS a, (c_custkey * 7 + c_nationkey) % 25 AS b FROM customer),
 reach(a, b, lvl) AS (SELECT a, b, 1 FROM edges UNION ALL SELECT r.a, e.b, lvl + 1 FROM (SELECT DISTINCT a, b, lvl FROM reach) r JOIN edges e ON r.b = e.a WHERE lvl < 4)
 SELECT DISTINCT CAST(a AS BIGINT) AS source, CAST(b AS BIGINT) AS target FROM reach""")
def ref_closure(spark, d):
    edges = table(spark, d, "customer").selectExpr("cast(c_nationkey as long) source", "cast((c_custkey * 7 + c_nationkey) % 25 as long) target")
    return contract.closure(edges, depth=4)


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT c_nationkey AS a, (c_custkey * 7 + c_nationkey) % 25 AS b FROM customer),
 reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
 SELECT CAST(a AS BIGINT) AS source, CAST(b AS BIGINT) AS target FROM reach""")
def ref_closure_all(spark, d):
    edges = table(spark, d, "customer").selectExpr("cast(c_nationkey as long) source", "cast((c_custkey * 7 + c_nationkey) % 25 as long) target")
    return contract.closure(edges)


@query("""WITH old AS (SELECT p_name AS name, p_brand || p_size AS sig, p_brand AS scope FROM part WHERE p_partkey % 2 = 0), new AS (SELECT p_name || '2' AS name, p_brand || p_size AS sig, p_brand AS scope FROM part WHERE p_partkey % 2 = 1),
 o AS (SELECT *, count(*) OVER (PARTITION BY scope, sig) AS n FROM old), w AS (SELECT *, count(*) OVER (PARTITION BY scope, sig) AS n FROM new)
 SELECT o.name AS old_name, w.name AS new_name FROM o JOIN w USING (scope, sig) WHERE o.n = 1 AND w.n = 1""")
def rename_match(spark, d):
    part = table(spark, d, "part").withColumn("sig", F.concat("p_brand", F.col("p_size").cast("string")))
    old = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), "sig", F.col("p_brand").alias("scope"))
    new = part.where("p_partkey % 2 = 1").select(F.concat("p_name", F.lit("2")).alias("name"), "sig", F.col("p_brand").alias("scope"))
    return contract.renames(old, new)


@query("""SELECT event_id, len(list_filter(['k', 'id'], lambda x: NOT list_contains(json_keys(props), x))) AS n_missing, len(list_filter(json_keys(props), lambda x: NOT list_contains(['k', 'id'], x))) AS n_extra FROM events""")
def declared_vs_observed(spark, d):
    made = contract.drift(table(spark, d, "events"), F.col("props"), ["k", "id"])
    return made.select("event_id", F.size("missing").cast("long").alias("n_missing"), F.size("extra").cast("long").alias("n_extra"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id > 700")
def cursor_since(spark, d):
    return contract.since(table(spark, d, "events"), "event_id", 700).select("event_id", "user_id", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT n_nationkey, sha256(concat_ws('|', n_name, n_nationkey, n_regionkey)) AS fingerprint FROM nation")
def fingerprint(spark, d):
    return contract.fingerprint(table(spark, d, "nation"), ["n_name", "n_nationkey", "n_regionkey"]).select("n_nationkey", "fingerprint")


@query("SELECT p_name, p_partkey, 1000000000 + row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part WHERE p_size > 40 OR p_size IS NULL UNION ALL SELECT p_name, p_partkey, CAST(p_partkey AS BIGINT) FROM part WHERE p_size <= 40")
def lock_ordinals(spark, d):
    part = table(spark, d, "part").select("p_name", "p_partkey", "p_size")
    locked = part.where("p_size <= 40").select("p_name", "p_partkey", F.col("p_partkey").cast("long").alias("ordinal"))
    return contract.extend_lock(locked, part.select("p_name", "p_partkey"), order="p_partkey", next_ordinal=1_000_000_000)


@query("""WITH lock AS (SELECT p_name, p_partkey, CAST(p_partkey * 2 AS BIGINT) AS ordinal FROM part WHERE p_size <= 25)
 SELECT * FROM lock UNION ALL SELECT p_name, p_partkey, (SELECT coalesce(max(ordinal) + 1, 0) FROM lock) + row_number() OVER (ORDER BY p_partkey) - 1 FROM part WHERE p_size > 25 OR p_size IS NULL""")
def lock_ordinals_all(spark, d):
    part = table(spark, d, "part")
    locked = part.where("p_size <= 25").select("p_name", "p_partkey", (F.col("p_partkey") * 2).cast("long").alias("ordinal"))
    return contract.extend_lock(locked, part.select("p_name", "p_partkey"), order="p_partkey")


@query("""SELECT page_id, CASE WHEN q LIKE '%page_token=%' THEN 'page-token' WHEN regexp_matches(q, '(^|&)page=') THEN 'page' WHEN regexp_matches(q, '(^|&)cursor=') THEN 'cursor' WHEN regexp_matches(q, '(^|&)offset=') THEN 'offset' ELSE 'unknown' END AS kind
 FROM (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)""")
def classify_pages(spark, d):
    return table(spark, d, "pages").select("page_id", contract.pagination(F.col("url")).alias("kind"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN TRUE ELSE FALSE END AS retry, substr(regexp_replace(lower(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 1, 64) AS name FROM pages""")
def scalar_names(spark, d):
    status = F.when(F.col("page_id") % 3 == 0, 503).otherwise(501)
    return table(spark, d, "pages").select("page_id", retryable(status).alias("retry"), snake_case(masked_url(F.lower("url"))).alias("name"))


@query(r"""WITH given AS (SELECT page_id, [200, 404, 408, 429, 500, 501, 503][CAST(page_id % 7 AS INT) + 1] AS status,
  CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://u:pw@') ELSE url END || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=k' || page_id AS url FROM pages),
 masked AS (SELECT page_id, status, regexp_replace(regexp_replace(url, '://[^/@?#]*@', '://***@', 'g'), '([?&](?:[a-z_-]*(?:token|key|secret|password|auth)[a-z_-]*)=)[^&#]*', '\1***', 'gi') AS url FROM given)
 SELECT page_id, status IN (408, 429) OR (status >= 500 AND status <> 501) AS retry, url AS masked,
  substr(lower(regexp_replace(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 64) AS name FROM masked""")
def scalar_names_all(spark, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 408, 429, 500, 501, 503)]), (F.col("page_id") % 7 + 1).cast("int"))
    user = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.lit("://u:pw@"))).otherwise(F.col("url"))
    masked = masked_url(F.concat(user, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("api_key=k"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", retryable(status).alias("retry"), masked.alias("masked"), snake_case(masked).alias("name"))


@query("SELECT conv_id, list_distinct_ordered AS roles, n FROM (SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS list_distinct_ordered, CAST(sum(n) AS BIGINT) AS n FROM (SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id)")
def ordered_distinct(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first_turn", "role"))).alias("x"), F.sum("n").alias("n")).select("conv_id", F.array_join("x.role", ",").alias("roles"), "n")
