"""What the operators of this subpackage share: shared-folder tables, size-checked joins, columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join with short rows is sent to every executor.
BROADCAST_ROWS = 200_000
#: Folders of this process's tables, for ``discard``.
WRITTEN: list[str] = []
#: Rows of one key beyond which it is joined apart from the others, unless the table has more of them.
HOT_ROWS = 10_000
#: Parts into which the large side of a salted join splits each key.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only where it is unset in a local
    session, as in tests, a temporary folder is set; a cluster without it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="growmap-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that ``discard`` removes."""
    WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def cut(df: DataFrame) -> DataFrame:
    """Small tables: the rows as they are now, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Larger tables: the rows as a Parquet table in the shared folder, which outlives executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes the tables that ``written`` made; their number. Results that still read them must be saved
    first."""
    jvm, n = spark.sparkContext._jvm, 0
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def join_small(big: DataFrame, small: DataFrame, keys: list[str], small_rows: int, how: str = "inner", salt: Column | None = None) -> DataFrame:
    """Join on keys where null equals null. ``small`` is broadcast only up to BROADCAST_ROWS rows,
    counted by the caller; beyond that both sides shuffle, each key of ``big`` spread over SALTS parts
    by ``salt`` (a deterministic integer column of ``big``)."""
    names = {k: f"__{k}_r" for k in keys}
    for k, v in names.items():
        small = small.withColumnRenamed(k, v)
    if small_rows <= BROADCAST_ROWS or salt is None:
        on = [big[k].eqNullSafe(small[v]) for k, v in names.items()]
        return big.join(F.broadcast(small) if small_rows <= BROADCAST_ROWS else small, on, how).drop(*names.values())
    big = big.withColumn("__salt", F.pmod(salt, F.lit(SALTS)))
    small = small.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    on = [big[k].eqNullSafe(small[v]) for k, v in names.items()] + [big["__salt"] == small["__salt_r"]]
    return big.join(small, on, how).drop("__salt", "__salt_r", *names.values())


def join_hot(big: DataFrame, small: DataFrame, key: str, n: str, rows: int | None = None) -> DataFrame:
    """Inner join on a key without nulls that ``small`` has once, with the number of its rows in ``big`` in
    column ``n``, which goes. Keys of more than HOT_ROWS rows, and more than a BROADCAST_ROWS-th of all, of
    which there are less than BROADCAST_ROWS, are sent out, so their rows stay where they are; only the others
    are shuffled. Both tables are read twice where there are any, so they should be stored ones. ``rows``: those
    of ``big`` where they are known; up to HOT_ROWS, no key can have more."""
    if rows is not None and rows <= HOT_ROWS:
        return big.join(small.drop(n), key)
    total, most = small.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_ROWS, (total or 0) // max(1, BROADCAST_ROWS))
    if (most or 0) <= bound:
        return big.join(small.drop(n), key)
    hot, rest = F.broadcast(small.filter(F.col(n) > bound).drop(n)), small.filter(F.col(n) <= bound).drop(n)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(rest, key))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names made longer than those of all columns of df."""
    return ["_" * (max(map(len, df.columns), default=0) + 1) + name for name in names]


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes; null: none."""
    return F.coalesce(text, F.lit("")).cast("binary")
