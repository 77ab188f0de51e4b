"""Queries over scalar functions: tokens, names, types, redaction, markup, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.functions import udfs
from ctxspark.operators import vector
from ctxspark.plans.registry import Registry, table
from ctxspark.sources import reports

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda t: length(t) > 1))"
#: The oracle's spelling of classification: RE2 has ASCII word boundaries of its own.
CLASSIFY = "CASE " + " ".join(f"WHEN regexp_matches({{x}}, '(?i)\\b(?:{w})\\b') THEN '{k}'" for k, w in X.TYPE_WORDS) + " ELSE 'concept' END"
PREFIX = "|".join(X.COMMIT_TYPES)
NAME = f"regexp_replace(regexp_replace(regexp_replace({{x}}, '^(?i)(?:{PREFIX})(?:\\([^)]*\\))?:\\s*', ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _name(x: str) -> str:
    return f"coalesce(nullif(lower({NAME.format(x=x)}), ''), 'untitled')"


def _uuid(x: str) -> str:
    h = f"sha1({x})"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({h}, 18, 3), '-', substr({h}, 21, 12))"


@R.query(f"SELECT doc_id, unnest({TOKENS.format(x='text')}) AS term FROM documents")
def tokenize_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("term"))


@R.query(f"""WITH t AS (SELECT item_id, unnest({TOKENS.format(x='text')}) AS t FROM benchmark)
SELECT item_id, t AS variant FROM t UNION SELECT item_id, t[:length(t) - 1] FROM t WHERE length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss'""")
def seed_variants(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.seed_variants(X.tokenize(F.col("text")))).alias("variant"))


@R.query(f"SELECT doc_id, {CLASSIFY.format(x='text')} AS type FROM documents")
def classify_type(spark, d):
    return table(spark, d, "documents").select("doc_id", X.classify_type(F.col("text")).alias("type"))


@R.query(f"SELECT conv_id, turn, {_name('text')} AS name FROM conversations")
def derive_name(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.derive_name(F.col("text")).alias("name"))


@R.query(f"""SELECT event_id, CASE WHEN t IN ({", ".join(f"'{x}'" for x in X.COMMIT_TYPES)}) THEN t ELSE 'other' END AS commit_type
FROM (SELECT event_id, lower(regexp_extract(CASE WHEN event_id < 500 THEN 'Fix(' || event_type || '): ' ELSE event_type || ': ' END, '^([A-Za-z]+)(?:\\([^)]*\\))?:', 1)) AS t FROM events)""")
def commit_type(spark, d):
    message = F.when(F.col("event_id") < 500, F.concat(F.lit("Fix("), "event_type", F.lit("): "))).otherwise(F.concat("event_type", F.lit(": ")))
    return table(spark, d, "events").select("event_id", X.commit_type(message).alias("commit_type"))


@R.query(f"SELECT doc_id, type, name, {_uuid("'type:' || type || ':' || name")} AS id FROM (SELECT doc_id, {CLASSIFY.format(x='text')} AS type, {_name('text')} AS name FROM documents)")
def entity_uuid5(spark, d):
    e = table(spark, d, "documents").select("doc_id", X.classify_type(F.col("text")).alias("type"), X.derive_name(F.col("text")).alias("name"))
    return e.select("*", X.entity_id(F.col("type"), F.col("name")).alias("id"))


_SANITIZE = "text"
for _label, _p in X.SECRETS:
    _sql = _p.replace(X.LEFT, r"\b").replace(X.RIGHT, r"\b").replace("'", "''")
    _SANITIZE = f"regexp_replace({_SANITIZE}, '{_sql}', '[REDACTED:{_label}]', 'g')"


@R.query(f"SELECT doc_id, {_SANITIZE} AS text FROM documents")
def sanitize_patterns(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact_patterns(F.col("text")).alias("text"))


@R.query()
def sanitize_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.redact_entropy(X.redact_patterns(F.col("text"))).alias("text"))


@R.query("""WITH c AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL),
s AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM c), e AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM s GROUP BY doc_id)
SELECT doc_id, round(coalesce(e, 0), 6) + 0.0 AS entropy FROM documents LEFT JOIN e USING (doc_id)""")
def shannon_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.round(X.shannon_entropy(F.col("text")), 6) + 0.0).alias("entropy"))


def _html_sql(x: str) -> str:
    for p, to in (("(?i)<\\s*br\\s*/?\\s*>", "chr(10)"), ("(?i)<\\s*li[^>]*>", "'- '"), ("(?i)<\\s*/\\s*(?:p|div|li|ul|ol|h[1-6]|tr|table)\\s*>", "chr(10)"), ("<[^>]+>", "''")):
        x = f"regexp_replace({x}, '{p}', {to}, 'g')"
    for a, b in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{a}', {b})"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@R.query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@R.query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS t FROM l)
SELECT doc_id, pos, regexp_replace(t, '^[•*-]\\s+', '') AS statement, CASE WHEN regexp_matches(t, '^[•*-]\\s+') THEN 'bullet' WHEN regexp_matches(t, '(?i)\\b(?:shall|must|should|will)\\b') THEN 'modal' ELSE 'general' END AS type FROM s""")
def atomic_statements(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(X.atomic_statements(F.col("text"))).alias("s"))
    return s.select("doc_id", "s.pos", F.col("s.text").alias("statement"), "s.type")


@R.query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'implemented' WHEN 'P' THEN 'approved' ELSE 'draft' END AS status FROM orders")
def status_map(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", " Done ").when(F.col("o_orderstatus") == "P", "In Review").otherwise("mystery")
    return table(spark, d, "orders").select("o_orderkey", X.external_status(raw).alias("status"))


@R.query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') || 'Service' WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '_') || 'Repository' END AS service FROM part""")
def service_detect(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("src/a/"), name, F.when(k == 0, "Service.ts").when(k == 1, "Repository.java").otherwise(".py"))
    return table(spark, d, "part").select("p_partkey", X.service_name(path).alias("service"))


def _tag_sql(x: str, dim: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{v}'" for v, words in X.TAGS[dim]) + " END"


@R.query("SELECT doc_id, " + ", ".join(f"{_tag_sql("replace(lower(text), '_', '-')", dim)} AS {dim}" for dim in X.TAGS) + " FROM documents")
def tag_entity(spark, d):
    return table(spark, d, "documents").select("doc_id", *[X.tag(F.col("text"), dim).alias(dim) for dim in X.TAGS])


_BARE = "WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '--[^\\n]*', ' ', 'g'), '#[^\\n]*', ' ', 'g') AS t FROM documents)"


@R.query(_BARE + " UNION ".join(f" SELECT doc_id, unnest(regexp_extract_all(t, '(?i)\\b{p}', 1)) AS table_name FROM s" for p in X.SQL_TABLES))
def sql_tables_extracted(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.sql_tables(F.col("text"))).alias("table_name"))


@R.query("SELECT doc_id, 1 + len(regexp_extract_all(text, '\\b(?:if|for|while|switch)\\b')) + len(regexp_extract_all(text, '&&|\\|\\||\\?')) AS complexity FROM documents")
def complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", X.complexity(F.col("text")).alias("complexity"))


@R.query("""SELECT doc_id, sha256(text) AS hash, strlen(text) AS size, round(0.4 + 0.3 * least(1.0, n_chars / 1000.0) + 0.3, 3) AS confidence FROM documents""")
def fingerprints(spark, d):
    from ctxspark.operators import cache

    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"), cache.confidence(F.lit(1.0), F.col("n_chars") / 1000.0, F.lit(1.0)).alias("confidence"))


@R.query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS passed, CAST(json_extract(props, '$.k') AS BIGINT) + 2 AS total, 1.5 * CAST(json_extract(props, '$.k') AS BIGINT) AS duration_ms FROM events""")
def vitest_parse(spark, d):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"numPassedTests":'), k, F.lit(',"numFailedTests":1,"numPendingTests":1,"numTotalTests":'), (k.cast("long") + 2).cast("string"), F.lit(',"testResults":[{"startTime":0,"endTime":'), k, F.lit('},{"startTime":0.5,"endTime":'), (k.cast("double") * 0.5 + 0.5).cast("string"), F.lit("}]}"))
    e = table(spark, d, "events").select("event_id", reports.vitest_column(doc).alias("r"))
    return e.select("event_id", "r.passed", "r.total", "r.duration_ms")


@R.query("SELECT o_orderkey, n AS total, greatest(n - f - s, 0) AS passed, f AS failed, s AS skipped FROM (SELECT l_orderkey AS o_orderkey, CAST(sum(l_quantity) AS BIGINT) AS n, count(*) FILTER (l_returnflag = 'R') AS f, count(*) FILTER (l_linestatus = 'O') AS s FROM lineitem GROUP BY l_orderkey)")
def junit_parse(spark, d):
    li = table(spark, d, "lineitem")
    suite = F.concat(F.lit('<testsuite name="x" tests="'), F.col("l_quantity").cast("long").cast("string"), F.lit('" failures="'), F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), F.lit('" errors="0" skipped="'), F.when(F.col("l_linestatus") == "O", "1").otherwise("0"), F.lit('"><testcase/></testsuite>'))
    docs = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("<testsuites>"), F.array_join(F.collect_list(suite), ""), F.lit("</testsuites>")).alias("value"))
    return docs.select("o_orderkey", reports.junit_column(F.col("value")).alias("r")).select("o_orderkey", "r.*")


@R.query("SELECT l_orderkey AS o_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS errors, CAST(sum(l_linenumber - 1) AS BIGINT) AS warnings, count(*) AS files, count(*) FILTER (l_linenumber > 0) AS files_with_errors FROM lineitem GROUP BY l_orderkey")
def eslint_parse(spark, d):
    one = F.concat(F.lit('{"errorCount":'), F.col("l_linenumber").cast("string"), F.lit(',"warningCount":'), (F.col("l_linenumber") - 1).cast("string"), F.lit("}"))
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    return docs.select("o_orderkey", reports.eslint_column(F.col("value")).alias("r")).select("o_orderkey", "r.*")


@R.query("SELECT l_orderkey AS o_orderkey, round(count(*) FILTER (l_linenumber > 2) / count(*), 6) AS lines_pct, round(1.0, 6) AS functions_pct FROM lineitem GROUP BY l_orderkey")
def coverage_parse(spark, d):
    one = F.concat(F.lit('"f'), F.col("l_linenumber").cast("string"), F.lit('":{"s":{"0":'), F.when(F.col("l_linenumber") > 2, "3").otherwise("0"), F.lit('},"b":{},"f":{}}'))
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(one), ","), F.lit("}")).alias("value"))
    r = docs.select("o_orderkey", reports.coverage_column(F.col("value")).alias("r"))
    return r.select("o_orderkey", F.round("r.lines_pct", 6).alias("lines_pct"), F.round("r.functions_pct", 6).alias("functions_pct"))


@R.query("SELECT page_id, first_line FROM (SELECT page_id, CASE WHEN length(l) > 160 THEN substr(l, 1, 159) || '…' ELSE l END AS first_line FROM (SELECT page_id, coalesce(list_filter(list_transform(string_split(html, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') AS l FROM pages))")
def first_lines(spark, d):
    return table(spark, d, "pages").select("page_id", X.first_line(F.col("html")).alias("first_line"))


@R.query("""WITH p AS (SELECT conv_id, string_agg('# ' || role || chr(10) || text, chr(10) ORDER BY turn) AS md, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'doc:c' || conv_id || '#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS doc_id,
  CASE WHEN length(t) > 700 THEN substr(t, 1, 699) || '…' ELSE t END AS text FROM (SELECT conv_id, turn, 'c' || conv_id || ' — ' || regexp_replace('# ' || role || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)""")
def md_chunks(spark, d):
    c = table(spark, d, "conversations")
    one = F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("t"))
    pages = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), "\n").alias("content"))
    return vector.markdown_chunks(pages.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), "content")).select("doc_id", "text")
