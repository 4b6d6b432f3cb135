"""Operator 1: mixing sources to target weights by hash-threshold histograms.

Each row has a hash of its id. Tokens are summed by source and hash bucket; the bucket in which a
source's budget ends is the only one that is refined, 2**BITS parts at a time, until it holds a single
hash. What remains is one threshold per source, so rows are taken by a filter and nothing is sorted.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last
in order; rows with the same id (null ids included) share a hash and are taken together; an empty table
gives an empty result; further columns are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growmap.llm.common import cut, join_small, table, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: A hash has HASH_BITS bits, and each level of a histogram splits a range in 2**BITS parts.
HASH_BITS, BITS = 60, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> + weight, target.

    ``share`` of all sizes is dealt out by weight; a target stops at ``cap`` times its source's size, and
    the excess is dealt to the others. Sources with the least cap per weight fill up first, so one pass
    in that order finds the level at which the rest is left. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    t = t.withColumns({"k": F.row_number().over(order), "filled": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "weight_left": F.sum("weight").over(after), "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
    t = t.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("weight_left"))
    free = F.col("most") >= F.col("level") * F.col("weight")
    t = t.withColumn("first", F.min(F.when(free, F.struct("k", "level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("most")).otherwise(F.col("first.level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, int]:
    """rows (source, size, h) -> (one row per source: source_size, target, epochs, below), their number.

    A source's rows are taken ``epochs`` times, and those with h < ``below`` once more. The rows up to
    and with the hash at which the budget ends are taken if that comes nearer to the target.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(totals, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    open_ = (F.col("rest") > 0) & (F.col("source_size") > 0)
    state = cut(t.withColumns({"open": open_, "lo": F.lit(0).cast("long"), "acc": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}))
    n = state.count()
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        if state.filter("open").isEmpty():
            break
        at = state.filter("open").select("source", "lo", "acc", "rest")
        near = join_small(rows.filter("size > 0"), at, ["source"], n, salt=F.col("h"))
        near = near.filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(1 << (shift + BITS))))
        hist = near.groupBy("source", "lo", "acc", "rest", F.shiftright(F.col("h") - F.col("lo"), shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        w = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("acc") + F.sum("size").over(w))
        edge = hist.filter("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", "size", "h0", "h1", "upto", "lo", "rest")).alias("e"))
        start = F.col("e.upto") - F.col("e.size")
        edge = edge.select(
            "source",
            (F.col("e.h0") < F.col("e.h1")).alias("open_"),
            (F.col("e.lo") + F.shiftleft(F.col("e.bucket"), shift)).alias("lo_"),
            start.alias("acc_"),
            F.when(start + F.col("e.upto") <= 2 * F.col("e.rest"), F.col("e.h1") + 1).otherwise(F.col("e.h0")).alias("below_"),
        )
        state = join_small(state, edge, ["source"], n, "left")
        state = cut(state.select("source", "source_size", "weight", "target", "epochs", "rest", F.coalesce("open_", F.lit(False)).alias("open"), *[F.coalesce(f"{c}_", c).alias(c) for c in ("lo", "acc", "below")]))
    return state.select("source", "source_size", "target", "epochs", "below"), n


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, names: list[str]) -> DataFrame:
    return docs.withColumns(dict(zip(names, (n_words(F.col(text_col)), hash60(F.col(id_col)), F.col(source_col).cast("string")))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """docs + size, source_size, target, copies (times the mix takes the row), taken (size x copies), each
    name after ``prefix``.

    ``keep``: columns of docs to carry, all by default; without the text the result comes from the
    written sizes, else the text is read once more rather than shuffled.
    """
    keep = docs.columns if keep is None else keep
    compact = [c for c in keep if c != text_col]
    size, h, source, *plans = unused(docs, "size", "h", "source", "source_size", "target", "epochs", "below")
    few = keyed(docs, id_col, text_col, source_col, [size, h, source]).select(*compact, size, h, source)
    rows = written(few, "mix")
    sources, n = plan(rows.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(h).alias("h")), weights, share, cap)
    base = rows if text_col not in keep else keyed(docs, id_col, text_col, source_col, [size, h, source]).select(*keep, size, h, source)
    sources = sources.select(F.col("source").alias(source), *[F.col(c.lstrip("_")).alias(c) for c in plans])
    out = join_small(base, sources, [source], n, salt=F.col(h))
    source_size, target, epochs, below = map(F.col, plans)
    copies = F.when(F.col(size) > 0, epochs + (F.col(h) < below).cast("long")).otherwise(F.lit(0).cast("long"))
    made = {"size": F.col(size), "source_size": source_size, "target": target, "copies": copies, "taken": F.col(size) * copies}
    made = {prefix + k: v for k, v in made.items()}
    return out.select(*[c for c in keep if c not in made], *[v.alias(k) for k, v in made.items()])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
o AS (SELECT *, row_number() OVER r AS k, coalesce(sum(most) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS filled,
    sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
    FROM w WINDOW r AS (ORDER BY most / weight, source NULLS LAST)),
l AS (SELECT *, (budget - filled) / weight_left AS level FROM o),
f AS (SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM l WHERE most >= level * weight),
t AS (SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN most ELSE level0 * weight END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
c AS (SELECT source, h, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, size FROM g)
SELECT d.doc_id, d.size, e.source_size, e.target,
    (d.size * (e.epochs + CASE WHEN e.target > e.epochs * e.source_size AND c.upto + c.upto - c.size <= 2 * (e.target - e.epochs * e.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
