"""WARC records and a Merkle fixity audit.

Records are written in order; each has its offset, length and SHA-256. The tree is a radix tree over record ids: a leaf
has the records of one id, and a node above has up to FANOUT consecutive nodes, hashing the place, the length in bytes
and the hash of each in order, that is, the ranges of bytes relative to its own start. So replicas are aligned by id, not
by place: a record that is missing or has another length changes the hashes of its own branch only. An audit compares
the replicas' roots and descends only where hashes differ, to the ids whose records are damaged, missing or surplus.
Levels are tables of hashes; each step down joins the children of mismatching nodes only.

Null url or html count as empty. Ids are whole numbers; a null id counts as the largest. Records with one id are one
leaf, digested in any order (exclusive or of the digests of different records with their counts), so a hot id is
aggregated before it is shuffled; if a replica has fewer copies of a record, all equal copies count as damaged. An empty
replica has no root: all of the other's records differ. Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ranked

BITS = 4
FANOUT = 1 << BITS


def record(url: Column, body: Column, number: Column) -> Column:
    """A WARC/1.1 resource record as a string whose UTF-8 bytes are the file's."""
    b = F.coalesce(body, F.lit(""))
    head = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:record:"), number.cast("string"), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(b).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), b, F.lit("\r\n\r\n"))


def hashed(records: DataFrame, order: str, content: str = "record") -> DataFrame:
    """(order, bytes, hash) of each record."""
    return records.select(F.col(order), F.octet_length(content).cast("long").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"))


def leaves(records: DataFrame, order: str, content: str = "record") -> DataFrame:
    """(leaf, order key, start, bytes, hash): the records' places in the file, by a global sort and running sums, so no task
    sees more than its part. Records with one order key: by their hash."""
    at = ranked(hashed(records, order, content).withColumnRenamed(order, "_order"), [F.col("_order"), F.col("hash")], ["bytes"])
    return materialize(at.select(F.col("_rank").alias("leaf"), F.col("_order").alias(order), F.col("_before_bytes").alias("start"), "bytes", "hash"))


def numbered(order: str) -> Column:
    return F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1))


def keyed(records: DataFrame, order: str) -> DataFrame:
    """(id, bytes, hash), as a tree takes them."""
    return records.select(numbered(order).alias("id"), "bytes", "hash")


def depth(*replicas: DataFrame) -> int:
    """Levels above the leaves that a tree needs for the ids of all replicas(id): one number from each comes to the driver."""
    most = 0
    for r in replicas:
        for x in r.agg(F.max("id").alias("hi"), F.min("id").alias("lo")).first():
            most = max(most, 64 if x is not None and x < 0 else int(x or 0).bit_length())
    return -(-most // BITS)


def digests(records: DataFrame) -> DataFrame:
    """(node, bytes, hash) of the leaves for records(id, bytes, hash)."""
    each = records.groupBy("id", "bytes", "hash").agg(F.count(F.lit(1)).alias("n"))
    d = each.select("id", (F.col("bytes") * F.col("n")).alias("bytes"), F.sha2(F.concat_ws(":", "hash", F.col("bytes").cast("string"), F.col("n").cast("string")), 256).alias("h"))
    parts = [F.bit_xor(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"x{i}") for i in range(8)]
    both = d.groupBy("id").agg(F.sum("bytes").alias("bytes"), *parts)
    return both.select(F.col("id").alias("node"), "bytes", F.sha2(F.concat_ws(":", *[F.col(f"x{i}").cast("string") for i in range(8)]), 256).alias("hash"))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Levels (node, bytes, hash) from the leaves to the root, for records(id, bytes, hash), each a table in the shared folder."""
    out = [materialize(digests(records))]
    for _ in range(levels):
        slot = F.col("node").bitwiseAND(F.lit(FANOUT - 1))
        children = F.sort_array(F.collect_list(F.struct(slot.alias("slot"), "bytes", "hash")))  # FANOUT at most
        ranges = F.transform(children, lambda c: F.concat_ws(":", c["slot"].cast("string"), c["bytes"].cast("string"), c["hash"]))
        up = out[-1].groupBy(F.shiftrightunsigned("node", BITS).alias("up")).agg(F.sum("bytes").alias("bytes"), F.array_join(ranges, "/").alias("h"))
        out.append(materialize(up.select(F.col("up").alias("node"), "bytes", F.sha2("h", 256).alias("hash"))))
    return out


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(id) numbers whose records differ between two replicas' trees of one depth."""
    wrong = None
    for left, right in zip(reversed(a), reversed(b), strict=True):
        own = [x.select("node", "hash") for x in (left, right)]
        if wrong is not None:
            own = [x.withColumn("up", F.shiftrightunsigned("node", BITS)).join(wrong, "up", "left_semi").select("node", "hash") for x in own]
        both = own[0].withColumnRenamed("hash", "ha").join(own[1].withColumnRenamed("hash", "hb"), "node", "full_outer")
        differ = materialize(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node"))
        if differ.isEmpty():
            break
        wrong = differ.select(F.col("node").alias("up"))
    return differ.select(F.col("node").alias("id"))


def compared(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records (id, hash) of a, distinct, of which b has fewer, and the ids at which either differs from the other."""
    levels = depth(a, b)
    differ = audit(tree(a, levels), tree(b, levels))
    counts = [x.join(differ, "id", "left_semi").groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")) for x in (a, b)]
    other = counts[1].withColumnRenamed("n", "m")
    lost = counts[0].join(other, ["id", "hash"], "left").where(F.coalesce("m", F.lit(0)) < F.col("n")).select("id", "hash")
    return lost, differ


def damaged(html: Column, url: Column) -> Column:
    """A second replica for tests of the audit: the first character of some pages is another one."""
    hurt = F.md5(F.coalesce(url, F.lit(""))).startswith("a7") & (F.length(html) > 0) & (F.substring(html, 1, 1) != "?")
    return F.when(hurt, F.concat(F.lit("?"), F.substring(html, 2, 2147483647))).otherwise(html)


def op7_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """The records of all pages against a replica with damaged pages: a row for each record."""
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    number = F.col("page_id")
    first = leaves(pages.select("page_id", record(F.col("url"), F.col("html"), number).alias("record")), "page_id")
    second = pages.select("page_id", record(F.col("url"), damaged(F.col("html"), F.col("url")), number).alias("record"))
    lost, _ = compared(keyed(first, "page_id"), materialize(keyed(hashed(second, "page_id"), "page_id")))
    wrong = lost.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.lit(True).alias("_wrong"))
    out = first.join(wrong, (numbered("page_id") == F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return out.select("page_id", "leaf", F.col("start").alias("rec_offset"), F.col("bytes").alias("rec_bytes"), F.col("hash").alias("rec_sha256"), F.col("_wrong").isNull().alias("intact"))


OP7_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), w AS (
  SELECT page_id, url, html, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: resource', 'WARC-Record-ID: <urn:record:' || page_id || '>',
    'WARC-Target-URI: ' || url, 'Content-Type: text/html', 'Content-Length: ' || strlen(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM r
), h AS (
  SELECT page_id, strlen(rec) AS rec_bytes, sha256(rec) AS rec_sha256,
    NOT (md5(url) LIKE 'a7%' AND length(html) > 0 AND substr(html, 1, 1) <> '?') AS intact FROM w
)
SELECT page_id, row_number() OVER o - 1 AS leaf,
  CAST(coalesce(sum(rec_bytes) OVER (ORDER BY page_id, rec_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rec_offset,
  CAST(rec_bytes AS BIGINT) AS rec_bytes, rec_sha256, intact
FROM h WINDOW o AS (ORDER BY page_id, rec_sha256)
"""
