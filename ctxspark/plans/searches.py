"""Queries that rank: TF-IDF, BM25, hybrid retrieval, nearest neighbours, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.functions.udfs import stem_tokens, stemmed_tokens
from ctxspark.operators import search, vector
from ctxspark.plans.registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
QUERY, PHRASES, K = "license public general the", "the of", 10
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1)"
_TERMS = f"t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)"


@R.query(f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def term_df(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@R.query(f"WITH {_TERMS} SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def term_tf(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(X.all_tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _tfidf(spark, d):
    return search.tfidf(table(spark, d, "documents"), "doc_id", X.all_tokens(F.col("text")), search.query_tokens(QUERY))


_TFIDF = f"""{_TERMS}, q AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ({", ".join(f"'{x}'" for x in QUERY.split())}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM q GROUP BY term),
n AS (SELECT count(*) AS n FROM documents), s AS (SELECT doc_id, sum((1 + ln(tf)) * ln(1 + n / (1 + df))) AS score FROM q JOIN df USING (term), n GROUP BY doc_id)"""


@R.query(f"WITH {_TFIDF} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT {K}")
def tfidf_topk(spark, d):
    best = search.top(_tfidf(spark, d), K, F.round("score", 9).desc(), F.asc("doc_id"))
    return best.select("doc_id", F.round("score", 6).alias("score"))


_BM25 = f"""a AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents), l AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda t: t = 'the')) AS f0, len(list_filter(w, lambda t: t = 'of')) AS f1 FROM a),
n AS (SELECT count(*) AS n, avg(len) AS dl, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM l),
b AS (SELECT doc_id, -({" + ".join(f"greatest(0.000001, ln((n - n{i} + 0.5) / (n{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / dl))" for i in (0, 1))}) AS rank FROM l, n WHERE f0 > 0 AND f1 > 0)"""


def _plain(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


@R.query(f"WITH {_BM25} SELECT doc_id, round(rank * 1e6, 3) AS rank FROM b ORDER BY round(rank * 1e6, 3), doc_id LIMIT {K}")
def bm25_topk(spark, d):
    b = search.bm25(table(spark, d, "documents"), "doc_id", _plain(F.col("text")), search.phrases(PHRASES))
    return b.select("doc_id", F.round(F.col("rank") * 1e6, 3).alias("rank")).orderBy("rank", "doc_id").limit(K)


@R.query(f"WITH {_BM25} SELECT doc_id, round(rank * 1e6, 3) AS rank FROM b")
def bm25_indexed(spark, d):
    """Every hit, by way of the inverted index."""
    index = search.postings(table(spark, d, "documents"), "doc_id", _plain(F.col("text")))
    b = search.bm25_postings(*index, search.phrases(PHRASES))
    return b.select(F.col("id").alias("doc_id"), F.round(F.col("rank") * 1e6, 3).alias("rank"))


@R.query("""SELECT term, doc_id, len(positions) AS tf, array_to_string(positions, ',') AS positions FROM (SELECT term, doc_id, list(pos ORDER BY pos) AS positions FROM
(SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents)) GROUP BY ALL)""")
def postings(spark, d):
    found, _ = search.postings(table(spark, d, "documents"), "doc_id", _plain(F.col("text")))
    return found.select("term", F.col("id").alias("doc_id"), F.size("positions").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


@R.query()
def bm25_porter_topk(spark, d):
    b = search.bm25(table(spark, d, "documents"), "doc_id", stem_tokens(F.col("text")), search.phrases("licensing works", stemmed_tokens))
    return b.select("doc_id", F.round("rank", 6).alias("rank")).orderBy("rank", "doc_id").limit(K)


@R.query(f"""WITH {_TERMS}, q AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('the', 'license') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM q GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, sum((1 + ln(tf)) * ln(1 + n / (1 + df))) AS score FROM q JOIN df USING (term), n GROUP BY doc_id), z AS (SELECT doc_id, source, 0 AS depth FROM documents WHERE contains(lower(text), 'license')),
o AS (SELECT doc_id, 1 AS depth FROM documents SEMI JOIN z USING (source)), p AS (SELECT doc_id, min(depth) AS depth FROM (SELECT doc_id, depth FROM z UNION ALL SELECT * FROM o) GROUP BY doc_id)
SELECT doc_id, round(0.6 * coalesce(score, 0) + 0.4 / (1 + coalesce(depth, 3)), 6) AS score FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN p USING (doc_id) ORDER BY round(0.6 * coalesce(score, 0) + 0.4 / (1 + coalesce(depth, 3)), 9) DESC, doc_id LIMIT {K}""")
def retrieve_hybrid(spark, d):
    from ctxspark.operators import graph

    docs = table(spark, d, "documents")
    zero = docs.where(F.lower("text").contains("license")).select("doc_id", "source")
    one = docs.join(zero.select("source").distinct(), "source", "left_semi").select("doc_id", F.lit(1).alias("depth"))
    depth = zero.select("doc_id", F.lit(0).alias("depth")).unionByName(one).groupBy("doc_id").agg(F.min("depth").alias("depth"))
    score = search.tfidf(docs, "doc_id", X.all_tokens(F.col("text")), ["the", "license"])
    all_ = docs.select("doc_id").join(score, "doc_id", "left").join(depth, "doc_id", "left").select("doc_id", (0.6 * F.coalesce("score", F.lit(0.0)) + 0.4 * graph.proximity(F.col("depth"))).alias("score"))
    return search.top(all_, K, F.round("score", 9).desc(), F.asc("doc_id")).select("doc_id", F.round("score", 6).alias("score"))


def _query_vector(spark, d) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


_DIST = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS distance FROM embeddings, q)"


@R.query(f"WITH {_DIST} SELECT vec_id, round(distance, 6) AS distance, round(1 - distance * distance / 2, 6) AS cosine FROM v ORDER BY distance, vec_id LIMIT {K}")
def vector_knn(spark, d):
    v = vector.knn(table(spark, d, "embeddings"), _query_vector(spark, d), K)
    return v.select("vec_id", F.round("distance", 6).alias("distance"), F.round(vector.l2_to_cosine(F.col("distance")), 6).alias("cosine"))


@R.query(f"WITH {_DIST} SELECT label, vec_id, rn, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rn FROM v) WHERE rn <= 3")
def vector_knn_per_label(spark, d):
    v = vector.knn_by(table(spark, d, "embeddings"), _query_vector(spark, d), 3, "label")
    return v.select("label", "vec_id", "rn", F.round("distance", 6).alias("distance"))


@R.query(f"""WITH {_TFIDF}, {_DIST.replace("q AS (", "qv AS (").replace("embeddings, q)", "embeddings, qv)")}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rn FROM s QUALIFY rn <= 20),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS rn FROM v QUALIFY rn <= 20) SELECT id, round(sum(1 / (60 + rn)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_fusion(spark, d):
    a = search.numbered(_tfidf(spark, d), 20, F.round("score", 9).desc(), F.asc("doc_id")).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "rn", F.lit("lexical").alias("label"))
    v = vector.knn(table(spark, d, "embeddings"), _query_vector(spark, d), 20)
    b = search.numbered(v, 20, F.asc("distance"), F.asc("vec_id")).select(F.lit("doc").alias("kind"), F.col("vec_id").alias("id"), "rn", F.lit("vector").alias("label"))
    return search.fused_order(search.rrf([a, b])).select("id", F.round("score", 6).alias("score"))


_FILE_QUERY = "small rings 000000007"
_SEEDED = " OR ".join(f"contains(lower({{0}}), '{x}')" for x in search.query_variants(search.query_tokens(_FILE_QUERY)))
_CUT = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda t: length(t) > 1))"


@R.query(f"""WITH f AS (SELECT p_partkey AS id, p_name || '-' || p_partkey AS path FROM part), s AS (SELECT s_suppkey AS id, s_suppkey AS file_id, s_name AS name FROM supplier),
e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderstatus = 'P'), z AS (SELECT id FROM s WHERE {_SEEDED.format("name")}),
d1 AS (SELECT DISTINCT src AS id FROM e JOIN z ON dst = z.id), d2 AS (SELECT DISTINCT src AS id FROM e JOIN d1 ON dst = d1.id),
p AS (SELECT file_id AS id, min(depth) AS depth FROM (SELECT file_id, 0 AS depth FROM s SEMI JOIN z USING (id) UNION ALL SELECT id, 0 FROM f WHERE {_SEEDED.format("path")}
  UNION ALL SELECT file_id, 1 FROM s SEMI JOIN d1 USING (id) UNION ALL SELECT file_id, 2 FROM s SEMI JOIN d2 USING (id)) GROUP BY 1),
c AS (SELECT id, path, depth FROM f JOIN p USING (id)), w AS (SELECT id, unnest({_CUT.format("path")}) AS term FROM c UNION ALL SELECT file_id, unnest({_CUT.format("name")}) FROM s SEMI JOIN c ON file_id = c.id),
q AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('small', 'rings', '000000007') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM q GROUP BY term), n AS (SELECT count(*) AS n FROM c),
x AS (SELECT id, sum((1 + ln(tf)) * ln(1 + n / (1 + df))) AS score FROM q JOIN df USING (term), n GROUP BY id)
SELECT path, round(0.6 * coalesce(score, 0) + 0.4 / (1 + depth), 6) AS score FROM c LEFT JOIN x USING (id)""")
def retrieve_files(spark, d):
    """Parts as files, suppliers as their symbols, open orders as edges from customers' numbers to orders' numbers."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("path"))
    symbols = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"))
    edges = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    found = search.retrieve(files, symbols, edges, _FILE_QUERY, (1 << 31) - 1)  # the whole ranking
    return found.select("path", F.round("score", 6).alias("score"))


_EXCERPT = r"coalesce(regexp_replace(list_filter(l[{0}:{1}], lambda x: regexp_matches(x, '^\s*[^\s/#*]'))[1], '^\s+|\s+$', '', 'g'), '{2}')"


@R.query(f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, {_EXCERPT.format(1, 3, "head")} || ' | none | ' || {_EXCERPT.format(4, 6, "tail")} AS s FROM a)
SELECT doc_id, CASE WHEN length(s) > 200 THEN substring(s, 1, 197) || '...' ELSE s END AS summary FROM b""")
def retrieve_summary(spark, d):
    def symbol(name: str, start: int, end: int):
        return F.struct(F.lit(name).alias("name"), F.lit(start).alias("start_line"), F.lit(end).alias("end_line"))

    symbols = F.array(symbol("head", 1, 3), symbol("none", 0, 0), symbol("tail", 4, 6))
    return table(spark, d, "documents").select("doc_id", search.summary(F.col("text"), symbols).alias("summary"))


@R.query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name = 'red widget'")
def symbols_named(spark, d):
    return search.symbols_named(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "red widget")


_KINDS = "['entity', 'symbol', 'module', 'doc'][CAST(label % 4 AS INT) + 1]"
_HITS = f"""{_DIST}, k AS (SELECT {_KINDS} AS kind, 'v' || vec_id AS id, distance FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN kind IN ('module', 'doc') THEN 'doc' ELSE kind END ORDER BY distance, kind, id) AS rn FROM k),
h AS (SELECT kind, id, 1 - distance * distance / 2 AS score FROM r WHERE rn <= 30 ORDER BY score DESC, list_position(['entity', 'symbol', 'module', 'doc', 'file'], kind), id LIMIT 30)"""


def _hits(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("entity", "symbol", "module", "doc")]), (F.col("label") % 4 + 1).cast("int"))
    id_ = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    stored = table(spark, d, "embeddings").select(kind.alias("kind"), id_.alias("doc_id"), F.lit("").alias("label"), F.lit("").alias("snippet"), F.lit(None).cast("string").alias("source_path"), "embedding")
    return search.vector_hits(stored, _query_vector(spark, d), 30).select("kind", "id", "label", F.round("score", 6).alias("score"))


@R.query(f"WITH {_HITS} SELECT kind, id, id AS label, round(score, 6) AS score FROM h")
def vector_hits(spark, d):
    return _hits(spark, d)


@R.query(f"WITH {_HITS} SELECT kind, id, id AS label, round(score, 6) AS score FROM h WHERE kind = 'doc'")
def hits_of_kind(spark, d):
    return search.of_kind(_hits(spark, d), "doc")
