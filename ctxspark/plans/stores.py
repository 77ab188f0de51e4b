"""Queries over a store's tables: corpus, entities, data flow, resolution, requirements, cache. The test tables stand in for
the store's; each oracle says the same of them in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.functions import udfs
from ctxspark.operators import cache, dashboard, graph, requirements, resolve, search, vector
from ctxspark.plans.aggregates import NOW
from ctxspark.plans.graphs import _FLOW, _flow
from ctxspark.plans.registry import Registry, table
from ctxspark.plans.scalars import PREFIX, _html_sql
from ctxspark.sources import files, gitlog
from ctxspark.streaming import streams

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _text(name: str):
    return F.col(name).cast("string")


def _parts(spark, d):
    """Parts as files of a nation's folder."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), _text("p_size"), F.lit("/m"), _text("p_partkey"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"))


_PARTS = "f AS (SELECT p_partkey AS id, 'src/' || p_size || '/m' || p_partkey || '.ts' AS path FROM part)"


# --- the corpus to embed


@R.query("SELECT 'c' || conv_id || '-' || turn AS doc_id, role || ': turn ' || turn || chr(10) || CASE WHEN turn = 0 THEN '' ELSE text END AS text, 'turn ' || turn AS label FROM conversations")
def entity_docs(spark, d):
    e = table(spark, d, "conversations").select(F.concat(F.lit("c"), _text("conv_id"), F.lit("-"), _text("turn")).alias("id"), F.col("role").alias("type"), F.concat(F.lit("turn "), _text("turn")).alias("name"), F.when(F.col("turn") != 0, F.col("text")).alias("content"))
    return vector.entity_docs(e).select("doc_id", "text", "label")


@R.query(f"""WITH {_PARTS} SELECT 'sym:' || s_suppkey AS doc_id, s_name || ' (class)' || chr(10) || path || chr(10) || CASE WHEN s_acctbal > 0 THEN 'in credit' ELSE '' END AS text, s_name AS label, path AS source_path
FROM supplier JOIN f ON id = s_suppkey""")
def symbol_docs(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"), F.lit("class").alias("kind"), F.when(F.col("s_acctbal") > 0, "in credit").alias("docstring"))
    return vector.symbol_docs(s, _parts(spark, d)).select("doc_id", "text", "label", "source_path")


@R.query("""SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, sha256(text) AS hash, CAST(CASE WHEN l.quality = 1 THEN 7 ELSE 9 END AS BIGINT) AS embedded_at, substring(text, 1, 160) AS snippet
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def embed_refresh(spark, d):
    """Good labelled documents are stored as they are, bad ones with an old hash, and some stored ones are gone."""
    corpus = table(spark, d, "documents").select(F.lit("doc").alias("kind"), _text("doc_id").alias("doc_id"), "text", F.lit("").alias("label"), F.lit(None).cast("string").alias("source_path"))
    embedder = vector.HashedEmbedder(dim=16)
    good = table(spark, d, "labels").select(_text("doc_id").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    gone = table(spark, d, "embeddings").select(F.concat(F.lit("gone-"), _text("vec_id")).alias("doc_id"), F.lit("gone").alias("text"), F.lit(True).alias("good"))
    had = corpus.join(good, "doc_id").select("doc_id", "text", "good").unionByName(gone)
    stored = had.select(
        F.lit("doc").alias("kind"), "doc_id", F.when(F.col("good"), F.sha2("text", 256)).otherwise("old").alias("hash"), F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), F.lit(None).cast("string").alias("source_path"),
        F.lit(7).cast("long").alias("embedded_at"), F.lit("").alias("label"), F.substring("text", 1, 160).alias("snippet"), F.array(F.lit(0.0).cast("float")).alias("embedding"),
    )
    return vector.embed(corpus, stored, embedder, 9).select("doc_id", "hash", "embedded_at", "snippet")


# --- entities and their links


@R.query("SELECT CAST(doc_id AS VARCHAR) AS id, substring(text, 1, 160) AS snippet FROM documents WHERE lang = 'en' ORDER BY n_chars % 97 DESC, id LIMIT 50")
def entities_newest(spark, d):
    e = table(spark, d, "documents").select(_text("doc_id").alias("id"), F.col("lang").alias("type"), (F.col("n_chars") % 97).alias("created_at"), F.col("text").alias("content"))
    return dashboard.by_type(e, "en", 50).select("id", "snippet")


_PAGE = """e AS (SELECT 'o' || o_orderkey AS id, o_orderpriority AS name, o_custkey FROM orders WHERE '{0}' IN ('o' || o_orderkey, o_orderpriority) ORDER BY ('o' || o_orderkey) <> '{0}', id LIMIT 1)"""


def _page(spark, d, wanted: str):
    e = table(spark, d, "orders").select(F.concat(F.lit("o"), _text("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("name"), _text("o_custkey").alias("commit_sha"))
    c = table(spark, d, "customer").select(_text("c_custkey").alias("sha"), F.col("c_name").alias("message"), F.col("c_mktsegment").alias("author"), _text("c_nationkey").alias("author_date"))
    links = table(spark, d, "lineitem").select(F.concat(F.lit("o"), _text("l_orderkey")).alias("from_id"), F.concat(F.lit("p"), _text("l_partkey")).alias("to_id"), F.col("l_returnflag").alias("relationship"))
    found = dashboard.entity_page(e, c, links, wanted)
    return found.select("id", "name", F.col("commit.message").alias("message"), F.array_join(F.transform("related", lambda r: F.concat(r["id"], F.lit(":"), r["relationship"])), ",").alias("related"))


def _page_sql(wanted: str) -> str:
    return f"""WITH {_PAGE.format(wanted)}, l AS (SELECT 'o' || l_orderkey AS id, string_agg('p' || l_partkey || ':' || l_returnflag, ',' ORDER BY 'p' || l_partkey, l_returnflag) AS related FROM lineitem GROUP BY 1)
SELECT id, name, c_name AS message, related FROM e LEFT JOIN l USING (id) LEFT JOIN customer ON c_custkey = o_custkey"""


@R.query(_page_sql("o7"))
def entity_by_id(spark, d):
    return _page(spark, d, "o7")


@R.query(_page_sql("1-URGENT"))
def entity_by_name(spark, d):
    return _page(spark, d, "1-URGENT")


@R.query("SELECT l_orderkey AS from_id, l_partkey AS to_id, l_returnflag AS relationship FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'P'")
def related_links(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relationship"))
    return graph.related(links, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


@R.query(f"""WITH {_PARTS} SELECT DISTINCT l_orderkey AS entity_id, s_suppkey AS symbol_id FROM lineitem JOIN f ON f.id = l_partkey JOIN supplier ON s_suppkey = l_partkey
WHERE l_quantity < 25""")
def entity_symbols(spark, d):
    """Lines as entities that name their part's supplier, in capitals; those of many pieces name none."""
    li = table(spark, d, "lineitem").join(_parts(spark, d), F.col("id") == F.col("l_partkey"))
    name = F.when(F.col("l_quantity") < 25, F.concat(F.lit("SUPPLIER#"), F.lpad(_text("l_partkey"), 9, "0"))).otherwise("none")
    found = li.select(F.col("l_orderkey").alias("id"), name.alias("name"), F.array("path").alias("files"))
    symbols = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"))
    return gitlog.entity_symbols(found, symbols, _parts(spark, d))


@R.query("SELECT c_custkey, c_name || ' — files: ' || coalesce((SELECT string_agg(o_orderkey, ', ' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'none') AS content FROM customer")
def entity_content(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("files"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", X.entity_content(F.col("c_name"), F.coalesce("files", F.array().cast("array<string>"))).alias("content"))


@R.query(f"""SELECT conv_id || '-' || turn AS sha, CASE WHEN regexp_matches(text, '^(?i)(?:{PREFIX})(?:\\([^)]*\\))?:') THEN lower(regexp_extract(text, '^([A-Za-z]+)', 1)) ELSE 'other' END AS commit_type, turn // 10 AS batch FROM conversations""")
def commit_batches(spark, d):
    text = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("sha"), F.col("text").alias("message"), F.col("turn").alias("seq"))
    log = text.withColumns({c: F.lit("") for c in ("author", "author_date", "committer_date", "parent_sha")})
    return gitlog.batches(gitlog.commit_rows(log)).select("sha", "commit_type", "batch")


@R.query(f"WITH {_PARTS} SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS commit_sha, l_partkey AS file_id FROM lineitem JOIN f ON id = l_partkey")
def commit_files(spark, d):
    path = F.concat(F.lit("src/"), _text("p_size"), F.lit("/m"), _text("l_partkey"), F.lit(".ts"))
    log = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(_text("l_orderkey").alias("sha"), F.array(path, F.lit("gone.ts")).alias("files"))
    return gitlog.commit_files(log, _parts(spark, d))


@R.query("""WITH b AS (SELECT event_id // 10 AS batch, min_by('sha-' || event_id, event_id) AS commit_sha, string_agg('Commit ' || substring('sha-' || event_id, 1, 7) || ' by ' || user_id || chr(10) || 'Message: ' || event_type || chr(10) || 'Diff: ' || substring('+ [REDACTED:api_key] ' || repeat('ab ', 300), 1, 800), chr(10) || chr(10) ORDER BY event_id) AS blocks FROM events GROUP BY 1) SELECT * FROM b""")
def batch_prompts(spark, d):
    """What follows the task in each prompt."""
    e = table(spark, d, "events")
    diff = F.concat(F.lit("+ password = '"), F.lpad(_text("event_id"), 9, "x"), F.lit("' "), F.repeat(F.lit("ab "), 300))
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("sha-"), _text("event_id")).alias("sha"), _text("user_id").alias("author"), F.col("event_type").alias("message"), diff.alias("diff"))
    p = gitlog.batch_prompts(log)
    return p.select("batch", "commit_sha", F.regexp_replace("prompt", r"(?s)^.*?\n\n", "").alias("blocks"))


@R.query("""SELECT event_id AS batch, type, name, CASE WHEN type = 'decision' THEN 'why' ELSE '' END AS content, CAST(user_id AS VARCHAR) AS commit_sha
FROM events, (VALUES ('decision', 'a-'), ('bug_fix', 'b-')) t(type, prefix), LATERAL (SELECT prefix || event_type AS name) WHERE event_id % 3 <> 0""")
def batch_answers(spark, d):
    """Fenced answers with two good entities, one of no known type and one without a name; every third is cut off."""
    kind = F.col("event_type")
    body = F.concat(F.lit('{"entities": [{"type": "decision", "name": " A-'), kind, F.lit('", "content": "why"}, {"type": "bug_fix", "name": "b-'), kind, F.lit('"}, {"type": "guess", "name": "x"}, {"type": "pattern", "name": " "}]'))
    answer = F.when(F.col("event_id") % 3 == 0, body).otherwise(F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
    answers = table(spark, d, "events").select(F.col("event_id").alias("batch"), _text("user_id").alias("commit_sha"), answer.alias("answer"))
    return gitlog.answered_entities(answers).drop("id")


# --- data flow


@R.query(f"WITH {_FLOW}, t AS (SELECT DISTINCT table_name FROM g ORDER BY 1 LIMIT 200), q AS (SELECT DISTINCT query_id FROM g ORDER BY 1 LIMIT 200) SELECT DISTINCT table_name, query_id, path FROM g SEMI JOIN t USING (table_name) WHERE query_id IN (FROM q)")
def dataflow_edges(spark, d):
    return dashboard.dataflow(graph.projection(*_flow(spark, d)))["edges"]


@R.query(f"WITH {_FLOW} SELECT count(DISTINCT table_name) AS tables, count(DISTINCT query_id) AS queries, count(DISTINCT CASE WHEN k = 1 THEN 'OrderService' END) AS services FROM g")
def projection_counts(spark, d):
    return graph.validate(*_flow(spark, d))["counts"]


@R.query("SELECT c_custkey AS id FROM customer SEMI JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 1")
def unmapped_files(spark, d):
    return graph.validate(*_flow(spark, d))["unmapped_files"].select("id")


@R.query("SELECT DISTINCT 'user_account_' || l_linestatus AS table_name, l_orderkey AS query_id FROM lineitem WHERE l_returnflag = 'A'")
def tagged_tables(spark, d):
    """Lines that are returned are of a table of users, the others of carts."""
    name = F.concat(F.when(F.col("l_returnflag") == "A", "user_account_").otherwise("shopping_cart_"), "l_linestatus")
    rows = table(spark, d, "lineitem").select(name.alias("table_name"), F.col("l_orderkey").alias("query_id")).distinct()
    return graph.tagged(rows, {"domain": "User"})


@R.query(f"WITH {_PARTS} SELECT path, s_name AS name, 'class' AS kind, s_nationkey AS start_line FROM supplier JOIN f ON id = s_suppkey ORDER BY path, name, start_line LIMIT 500")
def symbols_by_path(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"), F.lit("class").alias("kind"), F.col("s_nationkey").alias("start_line"))
    return dashboard.symbols(_parts(spark, d), s)[1]


# --- files and imports


@R.query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'r' WHEN 3 THEN 'c' WHEN 4 THEN 'cpp' WHEN 5 THEN 'markdown' END AS language FROM part""")
def file_languages(spark, d):
    names = F.array(*[F.lit(x) for x in ("a/b.tsx", "a.b/c.py", "x.R", "y.h", "z.cxx", "README.MD", "no_ending", "v1.2/none")])
    return table(spark, d, "part").select("p_partkey", files.language_column(F.get(names, (F.col("p_partkey") % 8).cast("int"))).alias("language"))


@R.query("SELECT d.doc_id AS path FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 0")
def files_changed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    have = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "path"), "path").select("path", F.when(F.col("quality") == 1, F.sha2("content", 256)).otherwise("old").alias("hash"))
    return files.changed(docs, have).select("path")


@R.query(f"""WITH {_PARTS}, i AS (SELECT o_orderkey AS id, p_partkey, o_orderkey % 100 AS near, o_orderkey % 4 AS k, p_size FROM orders JOIN part ON p_partkey = o_custkey),
s AS (SELECT *, CASE k WHEN 0 THEN './m' || near WHEN 1 THEN '../' || p_size || '/m' || p_partkey || '.js' WHEN 2 THEN 'react' ELSE './lost' END AS source FROM i)
SELECT s.id, source, f.id AS resolved_file_id, k = 2 OR f.id IS NOT NULL AS resolved, k = 2 AS external FROM s LEFT JOIN f ON f.path = CASE k WHEN 0 THEN 'src/' || p_size || '/m' || near || '.ts' WHEN 1 THEN 'src/' || p_size || '/m' || p_partkey || '.ts' END""")
def imports_resolved(spark, d):
    """Orders import a neighbour that may be there, themselves as emitted script, a package and a file that isn't there."""
    o = table(spark, d, "orders").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("o_custkey"))
    k = F.col("o_orderkey") % 4
    source = F.when(k == 0, F.concat(F.lit("./m"), (F.col("o_orderkey") % 100).cast("string"))).when(k == 1, F.concat(F.lit("../"), _text("p_size"), F.lit("/m"), _text("p_partkey"), F.lit(".js"))).when(k == 2, "react").otherwise("./lost")
    imports = o.select(F.col("o_orderkey").alias("id"), F.col("p_partkey").alias("file_id"), source.alias("source"), F.lit(False).alias("static"))
    none = spark.createDataFrame([], "fqn string, package string, path string")
    return resolve.resolve(imports, _parts(spark, d), none).select("id", "source", "resolved_file_id", "resolved", "external")


@R.query("""WITH b AS (SELECT replace(p_brand, '#', '') AS pkg, min_by(p_partkey, p_partkey || '.java') AS first FROM part GROUP BY 1), i AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k, replace(p_brand, '#', '') AS pkg FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT id, CASE k WHEN 0 THEN id WHEN 1 THEN first END AS resolved_file_id, k <> 2 AS resolved, k = 3 AS external FROM i JOIN b USING (pkg)""")
def imports_of_packages(spark, d):
    """Suppliers' files import their own type, all of their package, a type that their package lacks and a foreign one."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(_text("p_partkey"), F.lit(".java")).alias("path"), F.concat(F.lit("com.x."), F.regexp_replace("p_brand", "#", "")).alias("package"))
    rows = part.select(F.concat(F.col("package"), F.lit(".C"), _text("id")).alias("fqn"), "package", "path")
    k = F.col("id") % 4
    source = F.when(k == 0, F.concat("package", F.lit(".C"), _text("id"))).when(k == 1, F.concat("package", F.lit(".*"))).when(k == 2, F.concat("package", F.lit(".Lost"))).otherwise("org.other.Thing")
    own = part.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    imports = own.select("id", F.col("id").alias("file_id"), source.alias("source"), F.lit(False).alias("static"))
    return resolve.resolve(imports, part.select("id", "path", F.lit("java").alias("language")), rows).select("id", "resolved_file_id", "resolved", "external")


@R.query("""WITH e AS (SELECT * FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'node_modules/' || user_id WHEN 1 THEN 'own.db-wal' ELSE 'src/' || user_id END AS path, ts FROM events) WHERE path LIKE 'src/%'),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY path, b""")
def debounce_quiet(spark, d):
    """Events on a store's own files and on vendored ones are no changes."""
    k = F.col("user_id") % 3
    path = F.when(k == 0, F.concat(F.lit("node_modules/"), _text("user_id"))).when(k == 1, "own.db-wal").otherwise(F.concat(F.lit("src/"), _text("user_id")))
    return streams.debounced(table(spark, d, "events").select(path.alias("path"), "ts"), "2 hours")


# --- requirements


@R.query(f"""SELECT 'P-' || page_id AS id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS title, {_html_sql("html")} AS description, CASE WHEN page_id % 2 = 0 THEN 'jira' ELSE url END AS source, CASE page_id % 3 WHEN 0 THEN 'implemented' WHEN 1 THEN 'approved' ELSE 'draft' END AS status,
CASE WHEN page_id % 3 = 2 THEN 'unmapped status: parked' END AS warning FROM pages WHERE page_id % 7 <> 0""")
def requirements_jira(spark, d):
    n = F.col("page_id")
    status = F.struct(F.when(n % 3 == 0, "Done").when(n % 3 == 1, "In Review").otherwise("parked").alias("name"))
    raw = table(spark, d, "pages").select(F.when(n % 7 != 0, F.concat(F.lit("P-"), _text("page_id"))).alias("key"), F.when(n % 2 != 0, F.col("url")).alias("self"), F.struct(F.when(n % 5 != 0, F.col("url")).alias("summary"), F.col("html").alias("description"), status.alias("status")).alias("fields"))
    return requirements.normalise(raw, "jira")


@R.query(f"""SELECT 'GH-' || page_id AS id, url AS title, {_html_sql("html")} AS description, 'github' AS source, CASE WHEN page_id % 3 = 0 THEN 'implemented' ELSE 'draft' END AS status FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0""")
def requirements_github(spark, d):
    n = F.col("page_id")
    labels = F.array(F.struct(F.lit("bug").alias("name")), F.struct(F.when(n % 2 == 0, "Requirement").otherwise("question").alias("name")))
    raw = table(spark, d, "pages").select(n.alias("number"), F.col("url").alias("title"), F.col("html").alias("body"), F.lit(None).cast("string").alias("html_url"), F.when(n % 3 == 0, "CLOSED").otherwise("open").alias("state"), labels.alias("labels"), F.when(n % 5 == 0, "pr").alias("pull_request"))
    return requirements.normalise(raw, "github").drop("warning")


@R.query("SELECT o_orderkey AS id, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'implemented' ELSE 'approved' END AS status FROM orders WHERE o_orderstatus IN ('F', 'P')")
def requirements_native(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "implemented").when(F.col("o_orderstatus") == "P", "approved").otherwise("open")
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("").alias("description"), F.lit("").alias("source"), status.alias("status"))
    return requirements.normalise(raw, "native").select("id", "title", "status")


@R.query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])the(?:$|[^0-9])')")
def citing_commits(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("text", "message")
    return requirements.citing_commits(c, "THE").select("conv_id", "turn")


@R.query("""WITH l AS (SELECT doc_id, string_split(replace(text, ' the ', ' @req T-1 '), chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(range(len(l))) + 1 AS line, unnest(l) AS t FROM l)
SELECT doc_id, line, unnest(regexp_extract_all(t, '@req\\s+([\\w-]+)', 1)) AS req_id FROM x""")
def requirement_marks(spark, d):
    marks = X.requirement_marks(F.replace("text", F.lit(" the "), F.lit(" @req T-1 ")))
    m = table(spark, d, "documents").select("doc_id", F.explode(marks).alias("m"))
    return m.select("doc_id", F.col("m.line").cast("long").alias("line"), "m.req_id")


# --- the cache


_CACHE = "c AS (SELECT source || ':' || doc_id AS key, strlen(text) AS size, n_chars % 1000 AS last_access FROM documents)"


def _cache(spark, d):
    return table(spark, d, "documents").select(F.concat("source", F.lit(":"), _text("doc_id")).alias("key"), F.octet_length("text").cast("long").alias("size"), (F.col("n_chars") % 1000).alias("last_access"))


@R.query(f"WITH {_CACHE} SELECT count(*) AS entries, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, min(last_access) AS oldest FROM c")
def cache_stats(spark, d):
    return cache.stats(_cache(spark, d))


@R.query(f"WITH {_CACHE}, m AS (SELECT min(source) AS s FROM documents) SELECT key, size FROM c, m WHERE NOT starts_with(key, s || ':')")
def cache_invalidate(spark, d):
    first = table(spark, d, "documents").agg(F.min("source")).first()[0]
    return cache.invalidate(_cache(spark, d), f"{first}:").select("key", "size")


@R.query(f"WITH {_CACHE}, m AS (SELECT min(key) AS k FROM c) SELECT key, CASE WHEN key = k THEN 5000 ELSE last_access END AS last_access FROM c, m")
def cache_touch(spark, d):
    c = _cache(spark, d)
    return cache.touch(c, c.agg(F.min("key")).first()[0], 5000).select("key", "last_access")


# --- the other text functions


@R.query("SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def fences_stripped(spark, d):
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_fences(fenced).alias("text"))


@R.query(f"""WITH a AS (SELECT event_id, ts, epoch(date_trunc('second', TIMESTAMP '{NOW}')) - epoch(date_trunc('second', ts)) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS BIGINT) || 's ago' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM a""")
def time_ago(spark, d):
    return table(spark, d, "events").select("event_id", X.time_ago(F.col("ts"), F.to_timestamp(F.lit(NOW))).alias("ago"))


@R.query("SELECT p_partkey, 'id INT|price DECIMAL(10, ' || p_size || ')|name TEXT DEFAULT ''' || p_name || ', new''' AS parts FROM part")
def columns_split(spark, d):
    sql = F.concat(F.lit("(id INT, price DECIMAL(10, "), _text("p_size"), F.lit("), name TEXT DEFAULT '"), "p_name", F.lit(", new')"))
    return table(spark, d, "part").select("p_partkey", F.array_join(udfs.split_columns(sql), "|").alias("parts"))


@R.query("SELECT p_partkey, unnest(list_distinct([replace(p_name, ' ', '_'), 't_' || p_size])) AS table_name FROM part")
def tables_of_settings(spark, d):
    xml = F.concat(F.lit('<class table="'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('"/>\nnotable="x"\n  table: t_'), _text("p_size"), F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", F.explode(X.config_tables(xml)).alias("table_name"))


@R.query("SELECT p_partkey, unnest(list_distinct(['orm_' || p_size, 'ent', 'col.' || p_size])) AS table_name FROM part")
def tables_of_mappings(spark, d):
    code = F.concat(F.lit('@Table(name = "orm_'), _text("p_size"), F.lit("\")\n@Entity(name='ent')\ndb.collection('col."), _text("p_size"), F.lit("')"))
    return table(spark, d, "part").select("p_partkey", F.explode(X.sql_tables(code)).alias("table_name"))


# --- fusion without vectors


@R.query("""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents QUALIFY rn <= 30), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 30),
u AS (SELECT 'entity' AS kind, * FROM a UNION ALL SELECT 'file', * FROM b) SELECT kind, id, round(sum(1 / (60 + rn)), 6) AS score FROM u GROUP BY kind, id""")
def hybrid_fallback(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    longest = search.numbered(docs, 30, F.desc("n_chars"), F.asc("id")).select(F.lit("entity").alias("kind"), "id", "rn", F.lit("").alias("label"))
    first = search.numbered(docs, 30, F.asc("id")).select(F.lit("file").alias("kind"), "id", "rn", F.lit("").alias("label"))
    return search.hybrid(spark, longest, None, first).select("kind", "id", F.round("score", 6).alias("score"))
