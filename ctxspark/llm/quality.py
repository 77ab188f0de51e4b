"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes bad (-1) or good (1) on a document or abstains (0). Expectation-maximisation over the counts of vote
patterns (3^7 at most, whatever the input) estimates how often each rule says bad of bad and of good documents; a
document's posterior probability of being good decides. The fit has a prior, see PRIOR.

Null text counts as empty: no words, base_failed, never kept. Empty tables give empty results. Repeated rows are judged
alike, each on its own row. Extra columns of the input are left alone, whatever their names: they stay in one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize

SYMBOLS = "#*$%&|<>"
#: A rule: (name, metric, bad from, good up to); between the two it abstains.
RULES = (
    ("symbols", "n_symbols / n_words", 0.25, 0.05),
    ("repeated_words", "n_repeat_words / n_words", 0.5, 0.3),
    ("repeated_lines", "n_dup_lines / n_lines", 0.5, 0.3),
    ("capitals", "n_capitals / word_chars", 0.5, 0.2),
    ("shouting", "n_exclaims / n_words", 0.5, 0.1),
    ("long_words", "word_chars / n_words", 12.0, 9.0),
    ("short_words", "n_words / word_chars", 0.4, 0.3),
)
ROUNDS = 30
#: Share of bad documents; how often a rule says bad of good documents, of those with its own defect, of those with others.
START = (0.1, 0.001, 0.95, 0.05)
#: Defects mostly exclude one another, so one class of bad documents would have votes that depend on one another, and a free
#: fit would take the most correlated rules for the class and turn the others round. So each rule has a class of its own, of
#: documents with its defect. The prior says that rules rarely call good documents bad and mostly call those of their own
#: class bad; it weighs PRIOR times as much as the documents themselves, and SHARES of them for the classes' shares.
PRIOR, SHARES = 9, 0.1


def features(text: Column) -> Column:
    """The struct of counts for a whole text: one pass in the JVM, arrays bound once by a one-element transform."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)

    def repeats(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), repeats(w).alias("rep"))

    return _let(
        F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), F.translate(t, " \t\n\x0b\f\r", "").alias("solid")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            F.length(x["solid"]).cast("long").alias("word_chars"),
            (F.length(x["solid"]) - F.length(F.translate(x["solid"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            x["l"]["dup"].cast("long").alias("n_dup_lines"),
            x["w"]["rep"].cast("long").alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
            (F.length(x["solid"]) - F.length(F.regexp_replace(x["solid"], r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
            (F.length(x["solid"]) - F.length(F.translate(x["solid"], "!", ""))).cast("long").alias("n_exclaims"),
        ),
    )


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it in inner lambdas."""
    return F.transform(F.array(value), body)[0]


def _covered(h: Column) -> Column:
    """Positions in 3-windows whose hash occurs twice or more; h: the hashes by start. Sorting keeps it n log n."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    return _let(pairs, starts)


def votes(f: str) -> Column:
    """The votes on the struct column f as an array of -1, 0, 1; a metric without a value (no words) abstains."""
    out = []
    for _, metric, bad, good in RULES:
        over, under = metric.split(" / ")
        m = F.col(f"{f}.{over}") / F.nullif(F.col(f"{f}.{under}").cast("double"), F.lit(0.0))
        out.append(F.when(m >= bad, -1).when(m <= good, 1).otherwise(0))
    return F.array(*out)


def posteriors(patterns: DataFrame) -> DataFrame:
    """(v, p_good) for each vote pattern of patterns(v, n): expectation-maximisation as one expression over one row, whose
    array has 3^7 entries at most. Class 0 is of good documents, class r of those with rule r's defect. No rule may say
    bad less often in another class than in class 0, so that a bad vote never speaks for a document."""
    k = len(RULES)
    bad, of_good, of_own, of_others = START
    prior = [[of_good] * k] + [[of_own if r == c else of_others for r in range(k)] for c in range(k)]
    shares = [1 - bad] + [bad / k] * k

    def numbers(xs: list[float]) -> str:
        return f"array({', '.join(f'{x}D' for x in xs)})"

    like = "aggregate(zip_with(p.v, q, (v, x) -> CASE v WHEN -1 THEN ln(x) WHEN 1 THEN ln(1 - x) ELSE 0D END), 0D, (a, x) -> a + x)"
    weights = f"zip_with(s.share, s.q, (w, q) -> w * exp({like}))"
    shared = f"transform(array({weights}), w -> transform(w, x -> x / aggregate(w, 0D, (a, y) -> a + y)))[0]"
    seen = "aggregate(e, 0D, (a, p) -> a + if(p.v[r] <> 0, p.n * p.w[c], 0D))"
    hit = "aggregate(e, 0D, (a, p) -> a + if(p.v[r] = -1, p.n * p.w[c], 0D))"
    total, own = "aggregate(e, 0D, (a, p) -> a + p.n)", "aggregate(e, 0D, (a, p) -> a + p.n * p.w[c])"
    trust = f"if(c = 0 OR c = r + 1, {PRIOR}D * {seen}, 0D) + 1D"
    rates = f"transform(sequence(0, {k}), c -> transform(sequence(0, {k - 1}), r -> transform(array({trust}), t -> ({hit} + t * o.q[c][r]) / ({seen} + t))[0]))"
    step = (
        f"transform(array(transform(all_p, p -> struct(p.v AS v, p.n AS n, {shared} AS w))), e -> struct("
        f"transform(o.share, (x, c) -> ({own} + {SHARES}D * {total} * x + x) / ((1D + {SHARES}D) * {total} + 1D)) AS share, "
        f"transform(array({rates}), q -> transform(q, x -> zip_with(x, q[0], (y, g) -> greatest(y, g))))[0] AS q))[0]"
    )
    start = f"struct({numbers(shares)} AS share, array({', '.join(map(numbers, prior))}) AS q)"
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("all_p"))
    fitted = one.withColumn("o", F.expr(start)).withColumn("s", F.expr(f"aggregate(sequence(1, {ROUNDS}), o, (s, i) -> {step})"))
    return fitted.select(F.explode("all_p").alias("p"), "s").select("p.v", F.expr(f"{shared}[0]").alias("p_good"))


def _judged(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(row, q): docs' columns keep in a struct, so that no name clashes, and the struct of counts, votes, base_failed, p_good
    and kept. The counts go once to a table in the shared folder, as the fit and the verdict both need them."""
    f = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), features(F.col(f"`{text}`")).alias("f"))
    f = materialize(f.withColumn("v", votes("f")))
    post = F.broadcast(posteriors(f.groupBy("v").agg(F.count(F.lit(1)).alias("n"))))  # 3^7 rows at most
    failed = (F.col("f.n_words") < 50) | (100 * F.col("f.n_repeat_words") > 50 * F.col("f.n_words"))
    verdict = F.struct("f.*", F.col("v").alias("votes"), failed.alias("base_failed"), F.col("p_good"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"))
    return f.join(post, "v", "left").select("row", verdict.alias("q"))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col with the counts, votes, base_failed, p_good and kept, for every row of docs."""
    return _judged(docs, text, [id_col]).select("row.*", "q.*")


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    return _judged(docs, text, docs.columns).where("q.kept").select("row.*")


def op2_quality_votes(spark, sf_dir: str) -> DataFrame:
    q = judged(load(spark, sf_dir, "documents", "doc_id", "text"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
