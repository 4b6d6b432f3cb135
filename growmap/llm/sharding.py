"""Operator 6: shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a table: the key seeds a
generator that jumps from shard to shard. One shard more takes 1/(n+1) of the rows, all into itself.

Slots number the rows of a shard without gaps. A shard is cut in buckets by hash; counts of the
buckets give each its first slot, so no task ever sorts a whole shard.

Defined cases: a null text has no bytes and checksum 0; a text of any length counts whole; null ids share one
key, hence one shard; rows alike in id, size and checksum are interchangeable and take neighbouring slots; an
empty table gives an empty result; further columns are kept by ``shard``, whatever their names, but one named
like the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growmap.llm.common import bytes_of, table, unused, written
from growmap.llm.mixing import hash60

#: The generator's multiplier, a fixed value of the published algorithm.
STEP = 2862933555777941757
#: Least buckets of a shard, rows of a bucket, and rows alike that are dealt out together.
BUCKETS, BUCKET_ROWS, ALIKE = 256, 50_000, 10_000
OVERHEAD = 16


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards of uint64 keys."""
    keys = keys.astype(np.uint64)
    shard, nxt = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        shard[todo] = nxt[todo]
        keys[todo] = keys[todo] * np.uint64(STEP) + np.uint64(1)
        draw = (keys[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[todo] = ((shard[todo] + 1) * (2147483648.0 / draw)).astype(np.int64)
        todo = todo[nxt[todo] < n]
    return shard.astype(np.int32)


def shard_of(key: Column, n: int) -> Column:
    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), n))

    return run(key)


def shard(docs: DataFrame, n: int, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """docs + shard; a narrow operation."""
    rest, key = [c for c in docs.columns if c != out], unused(docs, "key")[0]
    return docs.withColumn(key, hash60(F.col(id_col))).select(*rest, shard_of(F.col(key), n).alias(out))


def number(rows: DataFrame, shard_col: str, key: Column, order: list[str], out: str = "slot", buckets: int | None = None) -> DataFrame:
    """rows + slot: from 0 in each shard, by (bucket, order). Rows should be short: those alike in all columns
    are counted and travel as one, then are dealt out again ALIKE at a time, so however often a row is repeated
    no task gets all. ``buckets`` of a shard, by default BUCKETS or one for each BUCKET_ROWS of its rows."""
    alike = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")), "alike")
    if buckets is None:
        most = alike.groupBy(shard_col).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = max(BUCKETS, -(-most // BUCKET_ROWS))
    alike = alike.withColumn("__bucket", F.pmod(key, F.lit(buckets)))
    counts = alike.groupBy(shard_col, "__bucket").agg(F.sum("__n").alias("__sum"))
    before = Window.partitionBy(shard_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(shard_col).alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))
    earlier = Window.partitionBy(shard_col, "__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    placed = placed.join(firsts, (placed[shard_col] == firsts["__s"]) & (placed["__bucket"] == firsts["__b"])).withColumn("__first", F.col("__first") + F.col("__before"))
    one = placed.filter("__n = 1").select(*rows.columns, F.col("__first").cast("long").alias(out))
    if alike.filter("__n > 1").isEmpty():
        return one
    parts = placed.filter("__n > 1").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(ALIKE).cast("long"))))
    spread = parts.repartition(F.xxhash64("__s", "__first", "__part"))
    last = F.least(F.col("__part") + ALIKE, F.col("__n")) - 1
    many = spread.select(*rows.columns, "__first", F.explode(F.sequence(F.col("__part"), last)).alias("__k"))
    return one.unionByName(many.select(*rows.columns, (F.col("__first") + F.col("__k")).cast("long").alias(out)))


def op6(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    text = bytes_of(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = written(shard(shard(rows, n), n + 1, out="grown_shard"), "sharded")
    rows = number(rows, "shard", hash60(F.col("doc_id")) + F.col("text_crc32"), ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 runs over the bytes with a table that is made from the polynomial.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS b, i AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
j AS (SELECT r, h::HUGEINT AS k, -1::BIGINT AS s, 0::BIGINT AS nxt FROM d
    UNION ALL SELECT r, k2, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT
    FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE nxt < 41)),
s AS (SELECT r, (max(s) FILTER (s < 40))::INT AS shard, max(s)::INT AS grown_shard FROM j GROUP BY r),
x AS (SELECT r, doc_id, size, h, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY (h + text_crc32) % 256, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM x JOIN s USING (r)
"""
