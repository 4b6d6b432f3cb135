"""Operator 9: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``2 * half`` bits of each other share a word within ``half`` bits of both.
So each distinct fingerprint sends out its ball of that radius; for half = 1 that is itself and its 64
single flips. The ball's words are grouped with one fixed-size mask of the flips that led there, which
names all fingerprints that met: at most 65, whatever the number of copies. They are verified against
the least of them, and linked to it as a star, which loses no connection as all are linked pairwise.

Copies never multiply: they share a fingerprint, and links run between distinct fingerprints.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; one or two words are
one shingle; a text of any length is taken whole, its bits counted in blocks; repeated rows get the same
result; a component whose ids are all null has a null id; an empty table gives an empty result; columns
that aren't kept are ignored, and ``one_of_each`` keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm.common import BROADCAST_ROWS, bytes_of, cut, join_hot, join_small, table, unused, written

SHINGLE, SEED = 3, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bytes methods take exactly A-Z and the six ASCII white spaces."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    cuts = map(slice, begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """The kept columns and fp (the 64 bits as a signed long)."""
    names = [c for c in keep if c != "fp"]
    rows = docs.select(*names, bytes_of(F.col(text_col)).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(len(names))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, schema)


def star_links(fps: DataFrame) -> DataFrame:
    """Distinct fp -> (a, b), a < b: links within 2 bits, enough of them to connect all that are linked.

    Fingerprints compare as signed longs here, which only has to be one order everywhere."""
    flip = F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("k")
    bit = F.when(F.col("k") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k")))
    # distinct fingerprints are few bytes, which would be read by few tasks, and grow 65 times here
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.select("fp").repartition(parts, F.xxhash64("fp"))
    ball = fps.select("fp", flip).select(F.col("fp").bitwiseXOR(bit).alias("word"), bit.alias("mask"), (F.col("k") < 0).cast("int").alias("own"))
    met = ball.groupBy("word").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
    met = met.filter(F.bit_count("mask") + F.col("own") > 1)
    flips = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("mask"), k) == 1)
    members = F.transform(flips, lambda k: F.col("word").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    members = F.when(F.col("own") == 1, F.array_append(members, F.col("word"))).otherwise(members)
    star = met.select(F.array_min(members).alias("a"), F.explode(members).alias("b"))
    return star.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the least node reachable.

    Rounds of large star and small star: every node's greater neighbours, then its lesser ones and
    itself, are linked to the least it knows. Minima are aggregated and joined back, and those of nodes with
    many neighbours are sent to these rather than shuffled with them (``join_hot``). Each round's links replace the last ones on shared storage;
    a round that changes none ends it, after about log2 of the nodes in a component."""
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(links)
    while was[0]:
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.filter("v > u"), least, "u", "n", was[0]).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        lesser = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = lesser.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(lesser, least, "u", "n", was[0]).select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        links = cut(small.filter("a <> b").distinct())
        if (now := state(links)) == was:
            break
        was = now
    return links.select(F.col("b").alias("node"), F.col("a").alias("root"))


def grouped(rows: DataFrame) -> DataFrame:
    """rows (id, fp, ...) + component: the least id reachable over links within 2 bits. Rows should be a stored
    table. A fingerprint that many rows share, as copies and empty texts do, is joined apart from the others."""
    fps = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = components(star_links(fps.select("fp")))
    linked = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "least", "n", "root")
    linked = cut(linked.unionByName(fps.join(roots.select(F.col("root").alias("r")).distinct(), F.col("fp") == F.col("r"), "left_semi").withColumn("root", F.col("fp"))))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = join_small(linked, least, ["root"], least.count(), salt=F.col("fp")).select("fp", "component", "root", "n")
    alone = fps.join(linked.select(F.col("fp").alias("f")), F.col("fp") == F.col("f"), "left_anti").select("fp", F.col("least").alias("component"), F.col("fp").alias("root"), "n")
    named = written(found.unionByName(alone), "named")
    return join_hot(rows, named, "fp", "n")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp, component) of each row."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return grouped(written(fingerprints(few, "text", ("id",), size), "simhash")).select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """docs with one row of each group, the one with the least (id, hash of the text).

    The rows to drop are named by id and text and sent out if few, else both sides shuffle. Of rows alike
    in both, which only repeated rows are, one stays."""
    key = F.xxhash64(text_col)
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    rows = written(grouped(written(fingerprints(few, "text", ("id", "key"), size), "simhash")), "groups")
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("s")).select(F.col("s.id").alias("__sid"), F.col("s.key").alias("__skey"))
    # id and text decide the root, so rows that stay are told by those, and a large group isn't met by its root
    drop = rows.join(stays, rows["id"].eqNullSafe(stays["__sid"]) & (rows["key"] == stays["__skey"]), "left_anti")
    drop = written(drop.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct(), "copies")
    twice = rows.groupBy("id", "key").count().filter("count > 1").select(F.col("id").alias("__id"), F.col("key").alias("__key"))
    twice = written(twice.join(drop, twice["__id"].eqNullSafe(drop["__id"]) & (twice["__key"] == drop["__key"]), "left_anti"), "repeated")
    mark = unused(docs, "own")[0]
    own = docs.withColumn(mark, key)

    small = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    out = own.join(small, own[id_col].eqNullSafe(drop["__id"]) & (own[mark] == drop["__key"]), "left_anti")
    if twice.isEmpty():
        return out.drop(mark)
    on = [out[id_col].eqNullSafe(twice["__id"]), out[mark] == twice["__key"]]
    small = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    return out.join(small, on, "left_anti").unionByName(out.join(small, on, "left_semi").dropDuplicates([id_col, mark])).drop(mark)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The multipliers of XXH64, fixed values of the published algorithm.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _mul(a: str, k: int) -> str:
    return f"({a} * {_u(PRIMES[k - 1])} % {_u(1 << 64)})"


def _rot(a: str, k: int) -> str:
    """Bits rotated to the left; a product by 2^k modulo 2^64 - 1."""
    return f"({a} * {_u(1 << k)} % {_u((1 << 64) - 1)})"


def _add(*a: str) -> str:
    return f"(({' + '.join(a)}) % {_u(1 << 64)})"


def _lane(at: str, n: int) -> str:
    """n bytes from place ``at`` of the hexadecimal text x, the last one first."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * (n - 1 - k) + 1}, 2)" for k in range(n)) + ")::UBIGINT::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    return _mul(_rot(_add(acc, _mul(lane, 2)), 31), 1)


def _fold(first: str, items: str, body: str) -> str:
    return f"list_reduce(list_prepend({first}, {items}), lambda h, v: {body})"


def xxh64_sql(strings: str, seed: int = SEED) -> str:
    """CTEs in DuckDB SQL, the last of which is xx (s, h): XXH64 of the strings (s) of a table."""
    first, size = _u((seed + PRIMES[4]) % (1 << 64)), 1 << 64
    starts = [(seed + PRIMES[0] + PRIMES[1]) % size, (seed + PRIMES[1]) % size, seed, (seed - PRIMES[0]) % size]
    lanes = ", ".join(f"list_transform(range(0, n - n % 32, 32), lambda o: {_lane(f'o + {8 * k}', 8)}) AS l{k}" for k in range(4))
    folds = ", ".join(f"{_fold(_u(s), f'l{k}', _round('h', 'v'))} AS v{k}" for k, s in enumerate(starts))
    merged = _add(*(_rot(f"v{k}", b) for k, b in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = _add(_mul(f"xor({merged}, {_round(_u(0), f'v{k}')})", 1), _u(PRIMES[3]))
    eights = _add(_mul(_rot(f"xor(h, {_round(_u(0), 'v')})", 27), 1), _u(PRIMES[3]))
    fours = _add(_mul(_rot(f"xor(h, {_mul('v', 1)})", 23), 2), _u(PRIMES[2]))
    ones = _mul(_rot(f"xor(h, {_mul('v', 5)})", 11), 1)
    return f"""
    xb AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM {strings}),
    xl AS (SELECT s, x, n, {lanes}, list_transform(range(n - n % 32, n - 7, 8), lambda o: {_lane('o', 8)}) AS eights,
        list_transform(range(n - n % 8, n - 3, 4), lambda o: {_lane('o', 4)}) AS fours, list_transform(range(n - n % 4, n, 1), lambda o: {_lane('o', 1)}) AS ones FROM xb),
    xv AS (SELECT *, {folds} FROM xl),
    xm AS (SELECT s, eights, fours, ones, {_add(f"CASE WHEN n >= 32 THEN {merged} ELSE {first} END", 'n::UHUGEINT')} AS h FROM xv),
    x8 AS (SELECT s, fours, ones, {_fold('h', 'eights', eights)} AS h FROM xm),
    x4 AS (SELECT s, ones, {_fold('h', 'fours', fours)} AS h FROM x8),
    x1 AS (SELECT s, {_fold('h', 'ones', ones)} AS h FROM x4),
    xa AS (SELECT s, {_mul(f"xor(h, h // {_u(1 << 33)})", 2)} AS h FROM x1),
    xc AS (SELECT s, {_mul(f"xor(h, h // {_u(1 << 29)})", 3)} AS h FROM xa),
    xx AS (SELECT s, xor(h, h // {_u(1 << 32)})::UBIGINT AS h FROM xc)"""


def statement(docs: str = "documents") -> str:
    """CTEs in DuckDB SQL, the last of which is grouped: docs + fp (a whole number), component_id."""
    upper = "".join(map(chr, range(65, 91)))
    shingles = f"list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' '))"
    return rf"""
    t AS (SELECT row_number() OVER () AS row, *, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
    g AS (SELECT row, unnest(CASE WHEN len(w) > {SHINGLE} THEN {shingles} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
    gs AS (SELECT DISTINCT s FROM g), {xxh64_sql('gs')},
    c AS (SELECT row, count(*) AS n, {', '.join(f"sum(h >> {k} & 1) AS b{k}" for k in range(64))} FROM g JOIN xx USING (s) GROUP BY row),
    f AS (SELECT t.* EXCLUDE (w), coalesce({' + '.join(f"CASE WHEN 2 * b{k} > n THEN {1 << k}::UBIGINT ELSE 0 END" for k in range(64))}, 0)::UBIGINT AS fp FROM t LEFT JOIN c USING (row)),
    k AS (SELECT DISTINCT fp FROM f),
    e AS (SELECT a.fp AS a, b.fp AS b FROM k a JOIN k b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
    q AS (SELECT fp AS a, fp AS b FROM k UNION SELECT q.a, e.b FROM q JOIN e ON e.a = q.b),
    m AS (SELECT a AS fp, min(doc_id) AS component_id, min(b) AS root FROM q JOIN f ON f.fp = q.b GROUP BY a),
    grouped AS (SELECT f.*, component_id, root FROM f JOIN m USING (fp))"""


SQL = f"WITH RECURSIVE {statement()} SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM grouped"
