"""Operator 4: benchmark decontamination with a distributed positional inverted index.

1. ``term_counts`` counts, over the whole corpus, the terms that the test phrases use.
2. ``build_index`` stores the corpus's postings (term, text key, position) for the terms asked for: first
   the two rarest terms of each phrase.
3. ``phrase_starts`` shifts each list by its term's offset in the phrase and intersects the two.
4. The texts in which the two met are split once more, and the postings of all other terms at the places
   where the phrases would stand are stored as well; ``occurrences`` intersects these lists too, to the
   exact phrases. No text is read beyond that: what is joined are terms and positions.
``proximity`` finds places where terms stand within a distance of each other, from the same index.

Texts are keyed by 128 bits of hash, so copies share their postings and a repeated or null id does no harm.
Items with the same words are searched once. Lists that are collected are no longer than an item.

Defined cases: a null or wordless text has no words and hits nothing; an item without words has no
window; a text of any length is taken whole; repeated rows each get their result; with an empty table of
items nothing is hit, and an empty table of texts gives an empty result; further columns of docs are kept
by ``contamination``, also those named like a column in here, and those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm.common import BROADCAST_ROWS, join_small, table, written

#: What lies between words once A-Z are lower-case: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before that.
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Item names in results up to which these are sent to every executor; beyond that the texts are shuffled.
BROADCAST_NAMES = 200_000
KEY = ["k1", "k2"]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z alone; lower() does the same, and faster, where all is ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def split_words(text: Column) -> Column:
    """The words in order. The first or last element is '' where the text starts or ends with a gap, so
    positions are those in this array; '' is no term."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP, -1)


def count_words(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), ANY_GAP, -1)
    first, last = (F.element_at(words, 1) == "").cast("int"), (F.element_at(words, -1) == "").cast("int")
    return (F.size(words) - first - F.when(F.size(words) > 1, last).otherwise(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """k1, k2, text and salt, an even number from 0 for each row."""
    return docs.select(*[k.alias(n) for n, k in zip(KEY, text_key(F.col(text_col)))], F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("salt"))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, words) of distinct items, words without gaps, and (item, id); items without words go."""
    words = F.filter(split_words(F.col(text_col)), lambda w: w != "")
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), words.alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("item", F.md5(F.array_join("words", " ").cast("binary")))
    return rows.select("item", "words").distinct(), rows.select("item", "id").distinct()


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, w (start in the item), phrase."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return items.select("item", "words", F.explode(starts).alias("w")).select("item", "w", F.slice("words", F.col("w") + 1, size).alias("phrase"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text_col: str = "text") -> DataFrame:
    """terms (term) + n, the times each occurs in the corpus; 0 counts too."""
    words = docs.select(F.explode(split_words(F.col(text_col))).alias("term"))
    near = words.join(F.broadcast(terms), "term", "left_semi") if n_terms <= BROADCAST_ROWS else words
    n = near.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(n, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, text_col: str = "text") -> DataFrame:
    """Stored postings (term, k1, k2, pos) of the given terms; terms too many to send out are shuffled."""
    words = keyed(docs, text_col).select(*KEY, F.posexplode(split_words(F.col("text"))).alias("pos", "term"))
    near = words.join(F.broadcast(terms), "term", "left_semi") if n_terms <= BROADCAST_ROWS else words.join(terms, "term", "left_semi")
    return written(near.select("term", *KEY, "pos"), "postings")


def rarest(windows: DataFrame, counts: DataFrame, lists: int = 2) -> DataFrame:
    """item, w, term, q: of each window its ``lists`` rarest terms (ties: the first), each at its first
    place in the window; q is that place in the item."""
    terms = windows.select("item", "w", F.posexplode("phrase").alias("offset", "term")).groupBy("item", "w", "term").agg(F.min("offset").alias("offset"))
    ranked = terms.join(counts, "term").groupBy("item", "w").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))), 1, lists).alias("t"))
    return ranked.select("item", "w", F.explode("t").alias("t")).select("item", "w", "t.term", (F.col("w") + F.col("t.offset")).alias("q"))


def phrase_starts(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(k1, k2, item, diag, ws): where all lists asked for window w of an item, moved by their places, have an
    entry; diag is where the item's first word stands in the text, ws the windows.

    Lists are asked once for each place in an item, not for each window over it."""
    lists = asked.select("term", "item", "q").distinct()
    met = join_small(index, lists, ["term"], lists.count(), salt=F.col("k1"))
    diag = met.groupBy(*KEY, "item", (F.col("pos") - F.col("q")).alias("diag")).agg(F.collect_set("q").alias("qs"))
    need = asked.groupBy("item", "w").agg(F.collect_set("q").alias("qs"))
    n_need = need.count()
    need = need.groupBy("item").agg(F.collect_list(F.struct("w", "qs")).alias("need"))
    # a common passage makes a hot item
    both = join_small(diag, need, ["item"], n_need, salt=F.col("k1"))
    ws = F.transform(F.filter("need", lambda n: (F.col("diag") + n["w"] >= 0) & (F.size(F.array_except(n["qs"], "qs")) == 0)), lambda n: n["w"])
    return both.select(*KEY, "item", "diag", ws.alias("ws")).filter(F.size("ws") > 0)


def places(starts: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, item, diag, n, ws, q, pos, term): each place of an item that a window of ``ws`` covers, and where
    in the text its term must stand; n is the windows' length."""
    n_words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    both = join_small(starts, items, ["item"], n_words, salt=F.col("k1")).withColumn("n", F.least(F.lit(size), F.size("words")))
    covered = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.sequence(w, w + F.col("n") - 1))))
    each = both.select(*KEY, "item", "diag", "n", "ws", "words", F.explode(covered).alias("q"))
    return each.select(*KEY, "item", "diag", "n", "ws", "q", (F.col("diag") + F.col("q")).alias("pos"), F.element_at("words", F.col("q") + 1).alias("term"))


def extend_index(docs: DataFrame, asked: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored postings (k1, k2, pos, term) at the places asked for, from the texts in which any are."""
    keys = written(asked.select(*KEY).distinct(), "keys")
    texts = join_small(keyed(docs, text_col), keys.withColumn("asked", F.lit(True)), KEY, keys.count(), salt=F.col("salt"))
    words = texts.select(*KEY, F.posexplode(split_words(F.col("text"))).alias("pos", "term"))
    cells = asked.select(*KEY, "pos", "term").distinct()
    few = cells.count() <= BROADCAST_ROWS
    # copies repeat their postings, which are put together in each task before they are shuffled
    near = words.join(F.broadcast(cells), [*KEY, "pos", "term"], "left_semi").distinct() if few else words.distinct().join(cells, [*KEY, "pos", "term"], "left_semi")
    return written(near, "postings")


def occurrences(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(k1, k2, item, start, stop): windows all of whose places have their term in the index."""
    met = asked.join(index, [*KEY, "pos", "term"], "left_semi")
    found = met.groupBy(*KEY, "item", "diag", "n", "ws").agg(F.collect_set("q").alias("qs"))
    whole = F.filter("ws", lambda w: F.size(F.array_except(F.sequence(w, w + F.col("n") - 1), "qs")) == 0)
    each = found.select(*KEY, "item", "diag", "n", F.explode(whole).alias("w"))
    return each.select(*KEY, "item", (F.col("diag") + F.col("w")).alias("start"), (F.col("diag") + F.col("w") + F.col("n")).alias("stop"))


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_hit, items) of the texts that hold a window: their words inside any, and the names of items."""
    items, names = items_of(benchmark, id_col)
    items, names = written(items, "items"), written(names, "names")
    windows = windows_of(items, size)
    terms = windows.select(F.explode("phrase").alias("term")).distinct()
    counts = written(term_counts(docs, terms, terms.count(), text_col), "terms")
    asked = written(rarest(windows, counts), "asked")
    rare = asked.select("term").distinct()
    index = build_index(docs, rare, rare.count(), text_col)
    wanted = written(places(phrase_starts(index, asked), items, size), "places")
    found = written(occurrences(wanted, extend_index(docs, wanted, text_col)), "occurrences")
    hit = found.select(*KEY, F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).groupBy(*KEY).agg(F.count_distinct("pos").alias("n_hit"))
    which = join_small(found.select(*KEY, "item").distinct(), names, ["item"], names.count(), salt=F.col("k1"))
    which = which.groupBy(*KEY).agg(F.sort_array(F.collect_set("id")).alias("items"))
    return written(hit.join(which, KEY), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """docs + n_words, n_hit (words inside any occurrence of a window), items (ids, sorted as strings), each
    name after ``prefix``."""
    hits = search(docs, benchmark, size, id_col, text_col)
    made = tuple(prefix + c for c in ("n_words", "n_hit", "items"))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    text = F.col(text_col)
    # longer than the name of any column of docs
    inner = {c: "_" * (max(map(len, docs.columns)) + 1) + c for c in ("n_words", "k1", "k2", "salt", "n_hit", "items")}
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], count_words(text).alias(inner["n_words"]), *[k.alias(inner[n]) for n, k in zip(KEY, text_key(text))], F.monotonically_increasing_id().alias(inner["salt"]))
    n_rows, n_names = hits.agg(F.count("*"), F.sum(F.size("items"))).first()
    few = n_rows + (n_names or 0) <= BROADCAST_NAMES
    hits = hits.select(*[F.col(c).alias(inner[c]) for c in (*KEY, "n_hit", "items")])
    out = join_small(rows, hits, [inner[c] for c in KEY], 0 if few else BROADCAST_ROWS + 1, "left", salt=F.col(f"`{inner['salt']}`"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{inner['n_words']}`").alias(made[0]),
        F.coalesce(F.col(f"`{inner['n_hit']}`"), F.lit(0)).cast("long").alias(made[1]),
        F.coalesce(F.col(f"`{inner['items']}`"), F.array().cast("array<string>")).alias(made[2]),
    )


def proximity(docs: DataFrame, pairs: DataFrame, distance: int, text_col: str = "text") -> DataFrame:
    """pairs (pair, first, second) -> (k1, k2, pair, pos, other) where the second term stands within ``distance``
    words of the first: an equi-join on the text and on blocks of that many positions, in which each text has
    no more entries than that; places of the first term are looked up in three blocks."""
    pairs = written(pairs, "pairs")
    terms, n = pairs.select(F.explode(F.array("first", "second")).alias("term")).distinct(), pairs.count()
    index = build_index(docs, terms, terms.count(), text_col)
    side = lambda c: join_small(index, pairs.select("pair", F.col(c).alias("term")), ["term"], n, salt=F.col("k1")).select(*KEY, "pair", "pos").distinct()
    block = F.floor(F.col("pos") / distance)
    a = side("first").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    b = side("second").withColumn("block", block).withColumnRenamed("pos", "other")
    both = a.join(b, [*KEY, "pair", "block"]).filter((F.abs(F.col("pos") - F.col("other")) <= distance) & (F.col("pos") != F.col("other")))
    return both.select(*KEY, "pair", "pos", "other")


def near_items(docs: DataFrame, benchmark: DataFrame, distance: int = WINDOW, id_col: str = "item_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, item_id and n_near: how often the two rarest terms of an item stand within
    ``distance`` words of each other; texts without such a place, and items of one term, are left out."""
    items, names = items_of(benchmark, id_col)
    items = written(items, "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    counts = written(term_counts(docs, terms, terms.count(), text_col), "terms")
    two = rarest(items.select("item", F.lit(0).alias("w"), F.col("words").alias("phrase")), counts).join(counts, "term")
    two = two.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("n", "q", "term"))).alias("t")).filter(F.size("t") == 2)
    pairs = two.select(F.col("item").alias("pair"), F.get("t", 0)["term"].alias("first"), F.get("t", 1)["term"].alias("second"))
    n = proximity(docs, pairs, distance, text_col).groupBy(*KEY, F.col("pair").alias("item")).agg(F.count("*").alias("n_near"))
    found = written(join_small(n, names.withColumnRenamed("id", "item_id"), ["item"], names.count(), salt=F.col("k1")).select(*KEY, "item_id", "n_near"), "near")
    rows = docs.select(*[F.col(c) for c in keep], *[k.alias(f"__{c}") for c, k in zip(KEY, text_key(F.col(text_col)))], F.monotonically_increasing_id().alias("__salt_of"))
    out = join_small(rows, found.withColumnsRenamed({c: f"__{c}" for c in KEY}), [f"__{c}" for c in KEY], found.count(), salt=F.col("__salt_of"))
    return out.select(*keep, "item_id", "n_near")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of the benchmark, however long the rest of their texts is."""
    prefix = "_" * (max(map(len, docs.columns), default=0) + 1)
    out = contamination(docs, benchmark, text_col=text_col, prefix=prefix)
    return out.filter(F.col(f"{prefix}n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(words[s:s + 12], ' ') AS phrase, least(len(words), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS s FROM i WHERE len(words) > 0)),
n AS (SELECT DISTINCT n FROM w),
p AS (SELECT r, n, s, array_to_string(words[s:s + n - 1], ' ') AS phrase FROM (SELECT r, n, words, unnest(range(1, len(words) - n + 2)) AS s FROM d, n WHERE len(words) >= n)),
m AS (SELECT p.r, p.s, p.n, w.item_id FROM p JOIN w ON p.phrase = w.phrase AND p.n = w.n),
h AS (SELECT r, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

NEAR_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM d),
i AS (SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
u AS (SELECT item_id, words, term, min(q) AS q FROM (SELECT item_id, words, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS q FROM i) GROUP BY ALL),
c AS (SELECT term, count(*) AS n FROM t WHERE term IN (SELECT term FROM u) GROUP BY 1),
k AS (SELECT item_id, words, term, row_number() OVER (PARTITION BY item_id, words ORDER BY coalesce(n, 0), q) AS k FROM u LEFT JOIN c USING (term)),
p AS (SELECT a.item_id, a.words, a.term AS first, b.term AS second FROM k a JOIN k b ON a.item_id = b.item_id AND a.words = b.words AND a.k = 1 AND b.k = 2),
m AS (SELECT x.r, item_id, words, count(*)::BIGINT AS n_near FROM p JOIN t x ON x.term = first JOIN t y ON y.r = x.r AND y.term = second AND abs(x.pos - y.pos) <= 13 GROUP BY ALL)
SELECT doc_id, item_id, n_near FROM m JOIN d USING (r)
"""
