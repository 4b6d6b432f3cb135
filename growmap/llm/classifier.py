"""Operator 3: a quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles; trees of fixed depth grow on gradient histograms and
are kept as arrays in heap order, which numpy walks for all rows and trees at once. Only the statistics
are inputs.

It is fitted on at most ``max_rows`` labels, those with the least hash of their id: the one bound here. Each row of docs is scored.

Defined cases: a null text is empty, and empty texts are scored like any other; without usable labels every
score is 0.5, with one class that class's smoothed share; a document with several labels counts once for
each, the same label once; null labels are left out; an id that several documents share is learnt from one of them, that with
the least hash of its text, and each of them is scored; a text of any length is read whole; an empty table
gives an empty result; further columns are ignored, kept ones named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm.common import bytes_of, table, unused

UPPER, DIGIT, CONTINUED = bytes(range(65, 91)), b"0123456789", bytes(range(0x80, 0xC0))
SPACE = b" \t\n\x0b\x0c\r"
MARKS = (b"#", b"$", b"%", b"&", b"*", b"|", b"<>", b"!", b".,;:", b"?", b"()[]{}", b"-_=+/\\@", b"'\"")
FEATURES = ("log_words", "word_length", "longest_word", "distinct_words", "repeats", "log_lines", "line_words", "dup_lines", "upper", "digits", "beyond_ascii", "title_words", *(f"marks_{k}" for k in range(len(MARKS))))
MAX_ROWS = 20_000


def features(text: bytes) -> list[float]:
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    return [
        np.log1p(len(words)),
        len(text.translate(None, CONTINUED + SPACE)) / n,
        max(map(len, words), default=0) ** 0.5,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)),
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        less(UPPER),
        less(DIGIT),
        sum(b >= 0xC0 for b in text.translate(None, bytes(range(0xC0)))) / size if not text.isascii() else 0.0,
        sum(map(bytes.istitle, words)) / n,
        *(less(m) for m in MARKS),
    ]


@dataclass
class Trees:
    """feature, threshold: (trees, 2**depth - 1) in heap order; leaf: (trees, 2**depth). A row goes right
    where its feature is over the threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        rows, t = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[t, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Newton steps on the logistic loss."""
    n, inner = len(y), 2**depth - 1
    none = np.zeros((0, inner))
    if not n:
        return Trees(0.0, none.astype(int), none, np.zeros((0, inner + 1)))
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(base, none.astype(int), none, np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    width = max(len(c) for c in cuts) + 1
    where, cells = code + np.arange(x.shape[1]) * width, x.shape[1] * width
    score = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * cells + where).ravel()
            hist = lambda v: np.bincount(flat, np.repeat(v, x.shape[1]), many * cells).reshape(many, x.shape[1], width).cumsum(axis=2)
            gs, hs, ns = hist(g), hist(h), hist(np.ones(n))
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ns < least) | (nt - ns < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def _features_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (names, __text) -> names, x."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py()) for t in b.column(len(names))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], [*names, "x"])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Trees:
    """labels: only those to learn from."""
    order = F.xxhash64(id_col)
    names = h, key, y = unused(docs, "h", "id", "y")
    few = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(order.alias(h), F.col(id_col).alias(key), F.col(label_col).cast("int").alias(y)).distinct().orderBy(*names).limit(max_rows)
    # of the texts of an id, the one with the least hash, so that no more than max_rows are collected
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.join(F.broadcast(few), docs[id_col] == few[key]).select(*names, F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t"))
    rows = rows.groupBy(*names).agg(F.min("t").alias("t")).select(*names, bytes_of(F.col("t.text")).alias("__text"))
    got = sorted(_features_of(rows, names).collect(), key=lambda r: r[:3])
    return fit(np.array([r.x for r in got], float).reshape(-1, len(FEATURES)), np.array([r[y] for r in got], float))


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, score, predicted."""
    names = [c for c in keep if c not in ("score", "predicted")]
    rows = docs.select(*names, bytes_of(F.col(text_col)).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([features(t.as_py()) for t in b.column(len(names))], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return score(docs, model, ("doc_id", "held_out"))
