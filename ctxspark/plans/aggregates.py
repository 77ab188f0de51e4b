"""Queries over aggregates, joins and small states: activity, health, cache, requirements, debounce."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.operators import cache, dashboard, graph, health, requirements, vector
from ctxspark.plans.registry import Registry, table
from ctxspark.sources import gitlog
from ctxspark.streaming import streams

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
#: The time that reports are made at; a parameter, never the clock.
NOW = "2024-01-30 00:00:00"


def _activity(spark, d):
    return dashboard.activity(table(spark, d, "orders"), table(spark, d, "events"), 12, "o_orderdate", "ts")


@R.query("""WITH c AS (SELECT strftime(o_orderdate, '%Y-%W') AS week, count(*) AS commits FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
e AS (SELECT strftime(ts, '%Y-%W') AS week, count(*) AS entities FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
SELECT week, coalesce(commits, 0) AS commits, coalesce(entities, 0) AS entities FROM c FULL JOIN e USING (week)""")
def weekly_activity(spark, d):
    return _activity(spark, d)


@R.query("""WITH e AS (SELECT strftime(ts, '%Y-%W') AS week, count(*) AS n FROM events GROUP BY 1), l AS (SELECT week, n, lag(n) OVER (ORDER BY week) AS p FROM e)
SELECT week, n, CASE WHEN p IS NULL THEN NULL WHEN p = 0 THEN 'NEW' ELSE CAST(CAST(floor((n - p) / p * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS growth FROM l""")
def growth_rate(spark, d):
    weeks = table(spark, d, "events").groupBy(X.week(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return dashboard.growth(weeks, "n")


@R.query("SELECT event_type AS type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def entity_type_histogram(spark, d):
    h = dashboard.type_histogram(table(spark, d, "events").withColumnRenamed("event_type", "type"))
    return h.withColumn("share", F.round("share", 6))


@R.query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM conversations) AS conversations")
def overview_counts(spark, d):
    return dashboard.overview(**{t: table(spark, d, t) for t in ("documents", "orders", "lineitem", "events", "embeddings", "conversations")})


@R.query("""WITH c AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)
SELECT o_orderkey AS sha, count(l_orderkey) AS n_entities, coalesce(array_to_string(list_sort(list(lpad(CAST(l_partkey AS VARCHAR), 9, '0')) FILTER (l_partkey IS NOT NULL))[1:8], ','), '') AS entities
FROM c LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def commit_timeline(spark, d):
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_sha"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("id"))
    t = dashboard.timeline(commits, own)
    return t.select("sha", "n_entities", F.array_join("entities", ",").alias("entities"))


@R.query("""SELECT l_partkey AS from_id, p_name AS from_name, l_suppkey AS to_id, s_name AS to_name, l_returnflag AS relationship FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey ORDER BY 1, 3, 5 LIMIT 100""")
def relations_named(spark, d):
    links = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id"), F.col("l_returnflag").alias("relationship"), F.col("l_partkey"), F.col("l_suppkey")).distinct()
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    other = table(spark, d, "supplier").select(F.col("s_suppkey").alias("to_id"), F.col("s_name").alias("to_name"))
    j = links.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), "relationship")
    return j.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), "from_id").join(other, "to_id").select("from_id", "from_name", "to_id", "to_name", "relationship").orderBy("from_id", "to_id", "relationship").limit(100)


def _health_inputs(spark, d):
    """Documents as files, order lines as imports (returned: broken; open: external), labels as signals."""
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("parsed_at"))
    li = table(spark, d, "lineitem")
    imports = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("file_id"), F.concat(F.lit("part-"), (F.col("l_partkey") % 50).cast("string")).alias("source"), (F.col("l_returnflag") != "R").alias("resolved"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "R")).alias("external"))
    lab = table(spark, d, "labels")
    signals = lab.agg(F.avg("quality").alias("tests_pass"), F.avg("toxic").alias("lint_errors")).select(F.explode(F.create_map(F.lit("tests_pass"), "tests_pass", F.lit("lint_errors"), "lint_errors")).alias("key", "value"))
    return files, imports, signals


_NOW_MS = 1706572800000
_HEALTH = f"""f AS (SELECT count(*) AS n, count(*) FILTER (epoch_ms(o_orderdate) > {_NOW_MS - health.DAY_MS}) AS recent FROM orders),
i AS (SELECT count(*) FILTER (NOT (l_linestatus = 'O' AND l_returnflag <> 'R')) AS inside, count(*) FILTER (l_returnflag = 'R') AS broken FROM lineitem),
s AS (SELECT avg(quality) AS tests, avg(toxic) AS lint FROM labels),
d AS (SELECT CASE WHEN n = 0 OR recent = 0 THEN 0.5 ELSE recent / n END AS freshness, CASE WHEN inside = 0 THEN 0.5 ELSE greatest(0, least(1, 1 - broken / inside)) END AS consistency,
  coalesce(tests, 0.5) * coalesce(1 - lint, 0.5) AS coverage, coalesce(tests, 0.5) AS tests FROM f, i, s),
h AS (SELECT freshness, consistency, coverage, 0.5 * consistency + 0.5 * tests AS confidence FROM d)"""


@R.query(f"WITH {_HEALTH} SELECT round(freshness, 6) AS freshness, round(consistency, 6) AS consistency, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, CAST(floor((0.3 * freshness + 0.3 * consistency + 0.2 * coverage + 0.2 * confidence) * 100 + 0.5) AS BIGINT) AS score FROM h")
def health_report(spark, d):
    h = health.dimensions(*_health_inputs(spark, d), _NOW_MS)
    return h.select(*[F.round(c, 6).alias(c) for c in ("freshness", "consistency", "coverage", "confidence")], "score")


_ISSUES = f"""{_HEALTH}, b AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'broken_import' AS type, 'unresolved import: part-' || (l_partkey % 50) AS message, o_orderpriority AS location FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
w AS (SELECT {1 << 62} AS seq, 'low_coverage' AS type, 'coverage below 50%' AS message, NULL AS location FROM h WHERE coverage < 0.5 UNION ALL SELECT {(1 << 62) + 1}, 'low_confidence', 'confidence below 50%', NULL FROM h WHERE confidence < 0.5),
x AS (SELECT * FROM b UNION ALL SELECT * FROM w)"""


def _issues(spark, d):
    files, imports, signals = _health_inputs(spark, d)
    return health.issues(files, imports, health.dimensions(files, imports, signals, _NOW_MS))


@R.query(f"WITH {_ISSUES} SELECT type, message, count(*) AS count, min(seq) AS first_seq FROM x GROUP BY type, message ORDER BY 3 DESC, 4 LIMIT 10")
def issue_summary(spark, d):
    return health.issue_summary(_issues(spark, d))


@R.query(f"WITH {_ISSUES} SELECT seq, type, message, location FROM x ORDER BY seq LIMIT 50 OFFSET 100")
def issues_page(spark, d):
    return health.issue_page(_issues(spark, d), 50, 100)


@R.query("""WITH c AS (SELECT doc_id, strlen(text) AS size, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS before, sum(strlen(text)) OVER () AS total FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS key, size FROM c WHERE before < total - 1000000""")
def cache_eviction(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("last_access"))
    return cache.evicted(c, 1000000).select("key", "size")


@R.query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_detect(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def _corpus(spark, d):
    return table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def _meta(spark, d):
    """Labelled documents as embedded ones; those of bad quality have an old hash, some are gone."""
    m = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    gone = table(spark, d, "embeddings").where("label = 0").select(F.concat(F.lit("gone-"), F.col("vec_id").cast("string")).alias("doc_id"), F.lit("x").alias("hash"))
    have = m.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise("old").alias("hash"))
    return have.unionByName(gone).select(F.lit("doc").alias("kind"), "doc_id", "hash", F.lit(7).cast("long").alias("embedded_at"))


_META = """m AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE 'old' END AS hash FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'gone-' || vec_id, 'x' FROM embeddings WHERE label = 0), c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS now FROM documents)"""


@R.query(f"WITH {_META} SELECT c.doc_id FROM c LEFT JOIN m USING (doc_id) WHERE m.hash IS NULL OR m.hash <> now")
def staleness_scan(spark, d):
    return vector.staleness(_corpus(spark, d), _meta(spark, d)).select("doc_id")


@R.query(f"WITH {_META} SELECT m.doc_id FROM m ANTI JOIN c USING (doc_id)")
def orphan_purge(spark, d):
    return vector.orphans(_corpus(spark, d), _meta(spark, d)).select("doc_id")


@R.query(f"WITH {_META} SELECT count(*) AS total, (SELECT count(*) FROM m) AS embedded, round((SELECT count(*) FROM m) / count(*), 6) AS coverage, count(*) FILTER (m.hash IS NULL OR m.hash <> now) AS stale FROM c LEFT JOIN m USING (doc_id)")
def embed_status(spark, d):
    s = vector.embed_status(_corpus(spark, d), _meta(spark, d))
    return s.select("total", "embedded", F.round("coverage", 6).alias("coverage"), "stale")


@R.query("SELECT doc_id AS id FROM documents ANTI JOIN labels USING (doc_id)")
def requirement_orphans(spark, d):
    reqs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return requirements.orphan_requirements(reqs, table(spark, d, "labels").select(F.col("doc_id").alias("req_id")))


@R.query("SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity < 3)")
def untracked(spark, d):
    links = table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_quantity < 3").select(F.col("l_partkey").alias("symbol_id"))
    return requirements.untracked_symbols(table(spark, d, "part").select(F.col("p_partkey").alias("id")), links)


@R.query("""SELECT a.event_id, a.ts, a.user_id, b.ts AS next_ts, b.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'click') a
LEFT JOIN LATERAL (SELECT ts, event_id FROM events e WHERE e.event_type = 'purchase' AND e.user_id = a.user_id AND e.ts >= a.ts ORDER BY ts, event_id LIMIT 1) b ON true""")
def nearest_following(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type = 'click'").select("event_id", "ts", "user_id")
    ahead = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_ts"), F.col("event_id").alias("next_id"))
    return graph.nearest_following(marks, ahead, "user_id", "ts", "next_ts", ["next_id"])


@R.query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT CAST(user_id AS VARCHAR) AS path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s.n""")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    return streams.debounced(e, "1 hour")


@R.query("""SELECT conv_id, list_reduce(list(text ORDER BY turn), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || chr(10) || x END) AS content, arg_min(role, turn) AS type FROM conversations GROUP BY conv_id""")
def entity_accumulate(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").alias("type"))
    return gitlog.accumulated(c, "conv_id", "turn", "text", ("type",)).withColumnRenamed("text", "content")


@R.query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'customer-' || o_custkey || chr(10) || 'exports: ' || string_agg(o_orderstatus, ', ' ORDER BY o_orderstatus) || chr(10) || 'imports-out: ' || array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS text
FROM orders GROUP BY o_custkey""")
def module_cards(spark, d):
    o = table(spark, d, "orders")
    files = o.select(F.col("o_custkey").alias("id"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("path")).distinct()
    syms = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderstatus").alias("name"), F.lit(True).alias("exported"))
    imps = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("source"), F.lit(None).cast("long").alias("resolved_file_id"))
    none = o.limit(0)
    queries = none.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"))
    tables = none.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("table_name"))
    cards = vector.module_cards(files, syms, imps, queries, tables)
    return cards.select(F.regexp_replace("doc_id", "^mod:customer-", "").alias("doc_id"), "text")


@R.query("SELECT window_start AS start, event_type AS tool, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS window_start, event_type FROM events) GROUP BY ALL")
def tool_use_hourly(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "tool")
    return streams.per_window(e)


@R.query("SELECT (SELECT count(*) FROM part) AS entity, (SELECT count(*) FROM supplier) AS symbol, (SELECT count(*) FROM region) AS module, (SELECT count(*) FROM documents) AS doc")
def corpus_counts(spark, d):
    kinds = {"part": "entity", "supplier": "symbol", "region": "module", "documents": "doc"}
    rows = [table(spark, d, t).select(F.lit(k).alias("kind")) for t, k in kinds.items()]
    return vector.corpus_counts(rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3]))


@R.query("SELECT count(DISTINCT l_returnflag) AS tables, count(DISTINCT l_orderkey) AS queries, count(DISTINCT l_suppkey) AS files FROM lineitem")
def dataflow_counts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("table_name"), F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("path"))
    return graph.counts(li)


@R.query("""SELECT CAST(d.doc_id AS VARCHAR) AS key, CASE WHEN quality = 1 OR l.doc_id IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN quality = 1 OR l.doc_id IS NULL THEN 1 ELSE 9 END AS updated_at,
CASE WHEN l.doc_id IS NULL THEN d.doc_id ELSE 9 END AS last_access, CASE WHEN quality = 1 OR l.doc_id IS NULL THEN strlen(text) ELSE 3 END AS size FROM documents d LEFT JOIN labels l USING (doc_id)""")
def cache_put(spark, d):
    """Labelled documents are put again, those of bad quality with another content."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    f = cache.fingerprint(F.col("text"))
    have = docs.select("key", F.col("text").alias("content"), f["hash"].alias("hash"), F.lit(1).cast("long").alias("version"), f["confidence"].alias("confidence"), f["size"].alias("size"), F.lit(1).cast("long").alias("updated_at"), F.col("doc_id").alias("last_access"))
    new = table(spark, d, "labels").join(docs, "doc_id").select("key", F.when(F.col("quality") == 1, F.col("text")).otherwise("new").alias("content"))
    return cache.put(have, new, 9).select("key", "version", "updated_at", "last_access", "size")
