"""Helpers that the operators share: tables in the shared folder, and a global order with running sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contract: a word is a run of other characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in
    one process (tests); on a cluster it must be set."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ctxspark-")
        _OWN[app] = f"{base.rstrip('/')}/ctxspark-{app}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; its folder goes with the cluster's clean-up
        return
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, free: bool = True) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends there, and any executor can read it.
    With free the driver's garbage goes too, as Spark keeps a finished job's shuffle files on the executors' disks until
    then; worth it between many rounds."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """df with _rank (position from 0 in the global order) and, for each column c of sums, _before_c (its sum over the
    rows before this one), as a table in the shared folder.

    One range shuffle spreads the rows evenly, whatever key is hot; running sums restart in each partition, and the
    driver gets one row for each partition (never more) to make them global. Rows equal in all of order: any order.
    The sums' columns must be long and not null."""
    spark = df.sparkSession
    n = partitions(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType()), *[T.StructField(f"_before_{c}", T.LongType()) for c in sums]])
    names = [f.name for f in df.schema.fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = 0, dict.fromkeys(sums, 0)
        for b in batches:
            if not b.num_rows:
                continue
            own = [pa.array(np.arange(at, at + b.num_rows))]
            at += b.num_rows
            for c in sums:
                run = np.cumsum(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) + total[c]
                own.append(pa.array(np.concatenate([[total[c]], run[:-1]]).astype(np.int64)))
                total[c] = int(run[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*names, "_part", "_rank", *[f"_before_{c}" for c in sums]])

    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    table = materialize(placed.mapInArrow(number, schema))
    ends = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in sums]).orderBy("_part").collect()
    starts, at, total = [], 0, dict.fromkeys(sums, 0)
    for r in ends:  # one row for each partition of the shuffle
        starts.append((r["_part"], at, *[total[c] for c in sums]))
        at += r["n"]
        for c in sums:
            total[c] += r[f"s_{c}"]
    fields = "_part int, _from long" + "".join(f", _sum_{c} long" for c in sums)
    offsets = F.broadcast(spark.createDataFrame(starts, fields))  # bounded by the number of partitions
    return table.join(offsets, "_part").select(*names, (F.col("_rank") + F.col("_from")).alias("_rank"), *[(F.col(f"_before_{c}") + F.col(f"_sum_{c}")).alias(f"_before_{c}") for c in sums])
