"""Operator 8: quality rules by robust multivariate outliers.

Python counts five statistics of each whole text. The fixed rules come first; what passes them is a
vector of four transformed statistics, and its distance is taken from a minimum-covariance-determinant
estimate (MCD) of its language and source.

The estimate starts from medians and quartile ranges, exact ones of the statistics rounded to ROUNDED places,
which have few values and come out the same in whatever order rows are met, and takes C-steps: all rows are binned by squared
distance, each bin with its moments, and the bins up to a share ``keep_share`` of the group give the
next mean and covariance. So a step is one aggregation over every row, with as many result rows as bins,
and a hot group is summed where its rows are. ``FLOORS`` are the least standard deviations: statistics
that are constant in clean text, such as symbols, would else reject on any trace.

Groups with fewer than ``min_rows`` vectors take the estimate of their language, then that of all; if
these are smaller too, nothing is rejected.

Defined cases: a null or wordless text has zero counts and fails the rules; null languages and sources are
groups of their own; rows alike, ties in distance among them, get the same verdict, and repeated rows count
each; a text of any length is counted whole; an empty table gives an empty result; further columns are
ignored by ``rated`` and kept by ``clean_documents``, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm.common import BROADCAST_ROWS, bytes_of, cut, join_small, table, unused, written

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least standard deviations: log mean word length, roots of symbol, repeated-line and repeated-word rates. A rate r
#: alone adds r / floor^2 where a group has none, so the last two reject alone from 30 % of the lines and 40 % of the
#: words on: 0.3 / 0.0945^2 and 0.4 / 0.109^2 are just above the cut-off of TAIL, 33.4.
FLOORS = (0.06, 0.04, 0.0945, 0.109)
DIM = len(FLOORS)
KEEP_SHARE, STEPS, TAIL = 0.75, 8, 1e-6
#: Least vectors of a group: five for each dimension in the share that the estimate is made of.
MIN_ROWS = math.ceil(5 * DIM / KEEP_SHARE)
#: Decimal places of the statistics for the quartiles.
ROUNDED = 3
#: Bins of squared distances per doubling.
BINS = 16


def text_stats(text: bytes) -> tuple[int, int, int, int, int, int]:
    """STATS and the number of lines with a word."""
    words = text.split()
    chars = len(text.translate(None, CONTINUED + SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        n, inside = Counter(windows), bytearray(len(words))
        for k, w in enumerate(windows):
            if n[w] > 1:
                inside[k : k + 3] = b"\1\1\1"
        repeated = sum(inside)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def stats_of(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns, STATS and n_lines."""
    made = [*STATS, "n_lines"]
    names = [c for c in keep if c not in made]
    rows = docs.select(*names, bytes_of(F.col(text_col)).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{c} bigint" for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([text_stats(t.as_py()) for t in b.column(len(names))], np.int64).reshape(-1, len(made))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x) for x in got.T)], [*names, *made])

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_tail(x: float, df: int) -> float:
    """Probability above x; df even."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_above(p: float, df: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, df) > p else (lo, mid)
    return lo


def _model(n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    cov = cov + np.diag(np.square(FLOORS))
    return {"n": n, "mean": mean.tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "log_det": float(np.linalg.slogdet(cov)[1])}


MODEL = "g string, n bigint, mean array<double>, inverse array<double>, log_det double"


def distance2(x: list[Column]) -> Column:
    """Squared Mahalanobis distance of x from the model in columns mean, inverse."""
    d = [v - F.element_at("mean", k + 1) for k, v in enumerate(x)]
    out = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            out = out + (1 if i == j else 2) * F.element_at("inverse", i * DIM + j + 1) * d[i] * d[j]
    return F.greatest(out, F.lit(0.0))


def levels(lang: str = "lang", source: str = "source") -> Column:
    """The groups of a row, the closest first."""
    return F.array(F.to_json(F.array(F.col(lang).cast("string"), F.col(source).cast("string"))), F.to_json(F.array(F.col(lang).cast("string"))), F.lit("all"))


def fit_mcd(vectors: DataFrame, keep_share: float = KEEP_SHARE, min_rows: int = MIN_ROWS, steps: int = STEPS) -> DataFrame:
    """vectors (gs: groups of the row, v0..) -> MODEL, a row for each group of min_rows or more that is the closest
    such group of any row. Others, such as that of all rows where every language has enough, aren't estimated."""
    xs = [f"v{k}" for k in range(DIM)]
    counts = cut(vectors.groupBy("gs").agg(F.count("*").alias("n")))
    sized = counts.select("gs", "n", F.explode("gs").alias("g")).groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_rows)
    closest = counts.select("gs", F.posexplode("gs").alias("k", "g")).join(sized, "g").groupBy("gs").agg(F.min_by("g", "k").alias("g"))
    needed = cut(closest.select("g").distinct())
    rows = join_small(vectors.select(F.explode("gs").alias("g"), *xs), needed, ["g"], needed.count(), salt=F.xxhash64(*xs))
    alpha = keep_share
    radius = chi2_above(1 - alpha, DIM)
    factor = alpha / (1 - chi2_tail(radius, DIM + 2))

    def begin(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        q = np.array(part["q"].iloc[0].tolist(), float)
        scale = (q[:, 2] - q[:, 0]) / 1.349
        return pd.DataFrame([{"g": k[0]} | _model(int(part["n"].iloc[0]), q[:, 1], np.diag(scale**2))])

    quartiles = F.array(*[F.percentile(F.round(x, ROUNDED), [0.25, 0.5, 0.75]) for x in xs])
    start = rows.groupBy("g").agg(F.count("*").alias("n"), quartiles.alias("q")).filter(F.col("n") >= min_rows)
    models = cut(start.groupBy("g").applyInPandas(begin, MODEL))
    n_groups = models.count()

    def step(k: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        total = int(bins["n"].sum())
        last = int(np.searchsorted(bins["n"].cumsum().to_numpy(), math.ceil(alpha * total)))
        part = bins.iloc[: last + 1]
        n = part["n"].sum()
        mean = np.array([part[f"s{i}"].sum() for i in range(DIM)]) / n
        cov = np.zeros((DIM, DIM))
        for i in range(DIM):
            for j in range(i, DIM):
                cov[i, j] = cov[j, i] = part[f"p{i}{j}"].sum() / n - mean[i] * mean[j]
        return pd.DataFrame([{"g": k[0]} | _model(total, mean, factor * cov)])

    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)] + [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"p{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    for _ in range(steps):
        near = join_small(rows, models.select("g", "mean", "inverse"), ["g"], n_groups, salt=F.xxhash64(*xs))
        bin_ = F.floor(BINS * F.log2(distance2([F.col(x) for x in xs]) + 1e-3)).cast("int")
        bins = near.withColumn("bin", bin_).groupBy("g", "bin").agg(F.count("*").alias("n"), *sums)
        was, models = models, cut(bins.groupBy("g").applyInPandas(step, MODEL))
        moved = models.join(was.select("g", F.col("log_det").alias("was")), "g").agg(F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0]
        if moved is None or moved < 1e-9:
            break
    return models


def judge(stats: DataFrame, tail: float = TAIL, salt: Column | None = None, **fit: float) -> DataFrame:
    """stats (STATS, n_lines, lang, source) + base_failed, distance2 (null: not measured), kept."""
    rows = stats.withColumn("base_failed", base_failed()).withColumn("gs", levels())
    xs = {f"v{k}": v for k, v in enumerate(vector())}
    models = fit_mcd(rows.filter(~F.col("base_failed")).select("gs", *[v.alias(k) for k, v in xs.items()]), **fit)
    n = models.count()
    for k in range(3):
        own = models.select("g", F.struct("mean", "inverse").alias(f"m{k}"))
        rows = join_small(rows.withColumn("g", F.element_at("gs", k + 1)), own, ["g"], n, "left", salt=F.col("word_chars"))
    rows = rows.withColumn("m", F.coalesce("m0", "m1", "m2")).withColumns({"mean": F.col("m.mean"), "inverse": F.col("m.inverse")})
    rows = rows.withColumn("distance2", F.when(~F.col("base_failed"), distance2(list(xs.values()))))
    fine = F.coalesce(F.col("distance2") <= chi2_above(tail, DIM), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & fine).drop("g", "gs", "m", "m0", "m1", "m2", "mean", "inverse")


def rated(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    cols = tuple(dict.fromkeys([*keep, "lang", "source"]))
    return judge(written(stats_of(docs, cols, text_col), "stats"))


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rejected rows. A verdict follows from text, language and source, so the rejected
    ones are named by those and sent out if few; else both sides shuffle."""
    names = unused(docs, "k1", "k2", "lang", "source")
    key = dict(zip(names, (F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col)), F.col("lang"), F.col("source"))))
    own = docs.withColumns(key)
    few = own.select(*[F.col(c).alias(c.lstrip("_")) for c in names], F.col(text_col).alias("text"))
    bad = written(rated(few, ("k1", "k2")).filter(~F.col("kept")).select("k1", "k2", "lang", "source").distinct(), "rejected")
    n = bad.count()
    small = bad.toDF(*[f"{c}_" for c in names])
    on = [own[c].eqNullSafe(small[f"{c}_"]) for c in names]
    return own.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, "left_anti").drop(*key)


#: Pairs of dimensions, the lower triangle.
_LOWER = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _triangle(covariance: str) -> str:
    """covariance (c00, c10, c11, ...) -> its Cholesky factor in columns l00, l10, ..., a column of it at a time."""
    out = f"SELECT * FROM {covariance}"
    for j in range(DIM):
        inner = lambda i, j=j: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out = f"SELECT *, sqrt(c{j}{j}{inner(j)}) AS l{j}{j} FROM ({out})"
        if j + 1 < DIM:
            out = f"SELECT *, {', '.join(f'(c{i}{j}{inner(i)}) / l{j}{j} AS l{i}{j}' for i in range(j + 1, DIM))} FROM ({out})"
    return out


def _distance(rows: str) -> str:
    """rows (v0.., m0.., l00..) + d2, the squared distance by forward substitution."""
    for i in range(DIM):
        rows = f"SELECT *, (v{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i} FROM ({rows})"
    return f"SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(DIM))} AS d2 FROM ({rows})"


def statement(docs: str = "documents") -> str:
    """DuckDB SQL: docs + STATS, base_failed, kept, row (a number)."""
    radius = chi2_above(1 - KEEP_SHARE, DIM)
    factor = KEEP_SHARE / (1 - chi2_tail(radius, DIM + 2))
    vs = ", ".join(f"v{i}" for i in range(DIM))
    floor = lambda i, j: f" + {FLOORS[i] ** 2!r}::DOUBLE" if i == j else ""
    scale = lambda i: f"((q{i}[3] - q{i}[1]) / 1.349::DOUBLE) ** 2"
    first = ", ".join([f"q{i}[2] AS m{i}" for i in range(DIM)] + [f"({scale(i) if i == j else '0'}{floor(i, j)})::DOUBLE AS c{i}{j}" for i, j in _LOWER])
    moments = ", ".join([f"sum(v{i}) AS s{i}" for i in range(DIM)] + [f"sum(v{i} * v{j}) AS p{i}{j}" for i, j in _LOWER])
    total = ", ".join([f"sum(s{i}) / sum(n) AS m{i}" for i in range(DIM)] + [f"{factor!r}::DOUBLE * (sum(p{i}{j}) / sum(n) - sum(s{i}) / sum(n) * (sum(s{j}) / sum(n))){floor(i, j)} AS c{i}{j}" for i, j in _LOWER])
    state = ", ".join([f"m{i}" for i in range(DIM)] + [f"c{i}{j}" for i, j in _LOWER])
    return rf"""
    t AS (SELECT row_number() OVER () AS row, *, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {docs}),
    win AS (SELECT row, unnest(range(1, len(w) - 1)) AS k, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS s FROM t WHERE len(w) > 2),
    again AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([k, k + 1, k + 2]) AS p FROM win WHERE (row, s) IN (SELECT (row, s) FROM win GROUP BY row, s HAVING count(*) > 1)) GROUP BY row),
    st AS (SELECT t.*, len(w)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN again USING (row)),
    sv AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, ln(greatest(word_chars, 1) / greatest(n_words, 1)::DOUBLE) AS v0, sqrt(n_symbols / greatest(word_chars, 1)::DOUBLE) AS v1,
        sqrt(n_dup_lines / greatest(len(lines), 1)::DOUBLE) AS v2, sqrt(n_repeat_words / greatest(n_words, 1)::DOUBLE) AS v3 FROM st),
    gv AS (SELECT row, unnest([1, 2, 3]) AS level, unnest([to_json([lang, source])::VARCHAR, to_json([lang])::VARCHAR, 'all']) AS g, {vs} FROM sv WHERE NOT base_failed),
    q AS (SELECT g, {', '.join(f"quantile_cont(round(v{i}, {ROUNDED}), [0.25, 0.5, 0.75]) AS q{i}" for i in range(DIM))} FROM gv GROUP BY g HAVING count(*) >= {MIN_ROWS}),
    it AS (SELECT 0 AS step, g, {first} FROM q
        UNION ALL (WITH ch AS ({_triangle('it')}), di AS ({_distance('SELECT step, gv.*, ch.* EXCLUDE (g, step) FROM gv JOIN ch ON ch.g = gv.g')}),
        bi AS (SELECT step, g, floor({BINS} * log2(d2 + 0.001::DOUBLE)) AS bin, count(*) AS n, {moments} FROM di GROUP BY ALL),
        cu AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bin) - n AS before, ceil({KEEP_SHARE} * sum(n) OVER (PARTITION BY g)) AS least FROM bi)
        SELECT step + 1, g, {total} FROM cu WHERE before < least AND step < {STEPS} GROUP BY step, g)),
    mo AS ({_triangle(f"(SELECT g, {state} FROM it WHERE step = {STEPS})")}),
    fd AS (SELECT row, arg_min(d2, level) AS d2 FROM ({_distance('SELECT gv.*, mo.* EXCLUDE (g) FROM gv JOIN mo ON mo.g = gv.g')}) GROUP BY row),
    rated AS (SELECT sv.* EXCLUDE ({vs}, w, lines, body), NOT base_failed AND coalesce(d2 <= {chi2_above(TAIL, DIM)!r}::DOUBLE, true) AS kept FROM sv LEFT JOIN fd USING (row))"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(table(spark, sf_dir, "documents"), ("doc_id",)).select("doc_id", *STATS, "base_failed", "kept")


SQL = f"WITH RECURSIVE {statement()} SELECT doc_id, {', '.join(STATS)}, base_failed, kept FROM rated"
