"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, shards.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and read
again. All but the last return the columns of documents. Each stage takes nulls, empty and very long texts,
repeated rows, empty tables and any further columns as the operator that it calls, whose docstring says how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm import decontaminate, mixing, outliers, sharding, simhash
from growmap.llm.common import new_folder, table, unused

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules or the outlier test reject go; rows alike in text, language and source go or stay
    together. Null and empty texts go."""
    return outliers.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the least (id, text's hash), null ids last. Groups are
    op9's (three words, 2 bits); README has their recall. Texts without words are one group."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of the benchmark go, however long they are; texts without words stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as the mix takes them, which for a text without words is not at all; a null source is
    one of its own."""
    prefix, copy = unused(docs, "mix_", "copy")
    out = mixing.mix(docs, prefix=prefix)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(f"{prefix}copies").cast("int")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs + shard, from 0; null ids share one. A column of that name is replaced."""
    return sharding.shard(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

COLUMNS = "doc_id, text, lang, source, n_chars"
SHARD_SQL = sharding.SQL[sharding.SQL.index("j AS (SELECT r, h::HUGEINT") : sharding.SQL.index("x AS (SELECT r, doc_id")].rstrip().rstrip(",")

#: Each stage reads the rows that the one before it kept.
ORACLE_SQL = f"""
WITH good AS MATERIALIZED (WITH RECURSIVE {outliers.statement("documents")} SELECT {COLUMNS} FROM rated WHERE kept),
single AS MATERIALIZED (WITH RECURSIVE {simhash.statement("good")} SELECT {COLUMNS} FROM grouped QUALIFY row_number() OVER (PARTITION BY root ORDER BY doc_id NULLS LAST) = 1),
hits AS MATERIALIZED ({decontaminate.SQL.replace("FROM documents", "FROM single")}),
clean AS MATERIALIZED (SELECT single.* FROM single JOIN hits ON single.doc_id IS NOT DISTINCT FROM hits.doc_id WHERE n_hit = 0),
mix AS MATERIALIZED ({mixing.SQL.replace("FROM documents", "FROM clean")}),
mixed AS MATERIALIZED (SELECT clean.*, unnest(range(taken // size)) AS copy FROM clean JOIN mix ON clean.doc_id IS NOT DISTINCT FROM mix.doc_id WHERE size > 0),
sharded AS MATERIALIZED (WITH RECURSIVE d AS (SELECT doc_id AS r, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM (SELECT DISTINCT doc_id FROM mixed)), {SHARD_SQL} SELECT r AS doc_id, shard FROM s)
SELECT {", ".join(f"mixed.{c}" for c in COLUMNS.split(", "))}, shard FROM mixed JOIN sharded ON mixed.doc_id IS NOT DISTINCT FROM sharded.doc_id
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
