"""Mixing sources to target weights by weighted fair queueing.

Each source's documents come in a hashed order, again and again up to three passes. A copy's virtual finish time is the
source's running words divided by its target; all copies are range-sorted by it and the order is cut at the total
budget. Running sums come from a range shuffle (common.ranked), so a source with a third of all rows spreads out.

Null text has no words; documents without words are taken 0 words (in the pipeline they stay, once). A null source is a
source of its own, last. Repeated rows are separate documents. Ties in finish time: by source, then place in the
source's order, then pass. Empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import load, materialize, n_words, ranked

WEIGHTS = (5, 2, 1)
PASSES = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size): the sum of all sizes shared by weight, none above
    passes times its source; a round shares the rest among the others, until none is above."""
    order = ranked(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = materialize(order.select("source", "source_size", weight.cast("double").alias("weight"), F.col("_rank").alias("_source")))
    cap = F.col("source_size") * passes
    level = 0.0
    while True:  # each round adds a source to the capped ones at least
        capped = F.col("weight") * level > cap if level else F.lit(False)
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, cap)).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        if not r["w"]:
            break
        new = ((r["all"] or 0) - (r["capped"] or 0)) / r["w"]
        if new <= level:
            break
        level = new
    return s.select("source", "source_size", "_source", F.least(F.col("weight") * level, cap.cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, carry, size, source_size, target and taken for every row of docs."""
    t, s = F.col(text), F.col(source)
    rows = docs.select(id_col, *carry, s.alias("_src"), n_words(t).alias("size"), F.xxhash64(F.lit(42), F.col(id_col), t).alias("_dice"))
    rows = ranked(rows, [F.col("_src").asc_nulls_last(), F.col("_dice"), F.col(id_col), F.col("size")], ["size"])
    rows = materialize(rows)
    by = rows.groupBy(F.col("_src").alias("source")).agg(F.sum("size").alias("source_size"), F.min("_before_size").alias("_start"))
    goal = targets(by.select("source", "source_size")).withColumnRenamed("source", "_s")
    by = by.join(goal.drop("source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s")
    rows = rows.join(by, F.col("_src").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_upto", F.col("_before_size") - F.col("_start") + F.col("size"))

    def finish(n: Column) -> Column:
        return (F.col("_upto") + n * F.col("source_size")).cast("double") / F.col("target")

    passes = F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), lambda n: F.struct(finish(n).alias("at"), n.alias("n")))
    copies = rows.where("size > 0").select("_source", F.col("_rank").alias("_row"), "size", F.explode(passes).alias("c")).select("_source", "_row", "size", "c.at", "c.n")
    queue = ranked(copies, [F.col("at"), F.col("_source"), F.col("_row"), F.col("n")], ["size"])
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    last = queue.where(F.col("_before_size") + F.col("size") <= budget).agg(F.max(F.struct("at", "_source", "_row", "n")).alias("k")).first()["k"]
    if last is None:
        taken = F.lit(0)
    else:
        end = F.struct(F.lit(last["at"]).alias("at"), F.lit(last["_source"]).cast("long").alias("_source"), F.lit(last["_row"]).cast("long").alias("_row"), F.lit(last["n"]).alias("n"))
        place = [F.struct(finish(F.lit(n)).alias("at"), F.col("_source"), F.col("_rank").alias("_row"), F.lit(n).alias("n")) for n in range(PASSES)]
        taken = sum((F.when(p <= end, 1).otherwise(0) for p in place), F.lit(0))
        taken = F.when(F.col("size") > 0, taken).otherwise(0)
    return rows.select(id_col, *carry, "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it (0 to PASSES times), with its own columns; a row without words stays
    once. Texts are shuffled once, by id and text hash; repeated rows get their decisions in turn."""
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    picked = mix(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text"), key.alias("_hash")), "_id", "_text", "_source", ("_hash",))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size")).cast("int")
    picked = picked.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_i"), "_hash", times.alias("times"))
    picked = picked.groupBy("_i", "_hash").agg(F.sort_array(F.collect_list("times"), asc=False).alias("times"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = docs.select(row, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_i"), key.alias("_hash"))
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"_row.`{c}`") for c in docs.columns if c != text]))
    own = own.withColumn("_n", F.row_number().over(W.partitionBy("_i", "_hash").orderBy(rest)))  # rows equal in all: any order
    out = own.join(picked, ["_i", "_hash"]).withColumn("_times", F.get("times", F.col("_n") - 1))
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


def op8_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
