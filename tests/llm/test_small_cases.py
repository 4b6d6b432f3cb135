"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
whose names clash with results."""

import hashlib
import json
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from growmap.llm import chat, classifier, decontaminate, html, mixing, outliers, sharding, simhash, tokens, warc
from growmap.llm.common import table

LONG = "word " * 60_000 + "x" * 30_000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line here.", "en", "a", 3, 9.0, 1, "k"),
    (1, "The quick brown fox jumps over the lazy dog.\nA second line here.", "en", "a", 3, 9.0, 1, "k"),
    (2, None, "en", None, 3, 9.0, 1, "k"),
    (3, "", None, "a", 3, 9.0, 1, "k"),
    (None, "no id at all but words", None, None, 3, 9.0, 1, "k"),
    (4, LONG, "de", "b", 3, 9.0, 1, "k"),
    (5, " \t\n\x0b ", "fr", "b", 3, 9.0, 1, "k"),
    (6, "Straße éÉ 漢字 😀 <|im_end|> ### $$$", "de", "￿", 3, 9.0, 1, "k"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, size int, score double, n_words int, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with all tables, and one with empty ones."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    conv = "conv_id bigint, turn bigint, role string, text string, n_turns int"
    made = {
        "documents": spark.createDataFrame(DOCS, SCHEMA),
        "benchmark": spark.createDataFrame([(1, "brown fox jumps over the lazy dog"), (2, None), (3, "..."), (1, "brown fox jumps over the lazy dog")], "item_id bigint, text string"),
        "labels": spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, None), (2, None, 0)], "doc_id bigint, quality int, toxic int"),
        "pages": spark.createDataFrame([(3, "u", "x" * 200, "r"), (1, None, "x" * 200, "r"), (2, "a\r\nb", "x" * 200, "r"), (4, "u", "same", "r"), (5, "u", "same", "r"), (6, "u", None, "r"), (7, "u", "y\r\n\r\nWARC/1.1\r\n" * 20, "r")], "page_id bigint, url string, html string, record_type string"),
        "conversations": spark.createDataFrame([(1, 0, "user", "hi", 7), (1, 1, "assistant", None, 7), (1, 1, "assistant", "<\\|x <|im_end|>\n", 7), (2, None, None, "?", 7), (None, 3, "a\nb<|", "", 7)], conv),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


OPS = {"mixing": mixing.op1, "chat": chat.op2, "classifier": classifier.op3, "decontaminate": decontaminate.op4, "tokens": tokens.op5, "sharding": sharding.op6, "warc": warc.op7, "outliers": outliers.op8, "simhash": simhash.op9, "html": html.op10}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, tables, name):
    rows = OPS[name](spark, tables[1]).collect()
    assert [r.conv_id for r in rows] == [-1] if name == "chat" else rows == []


def test_mixing(spark, tables, docs):
    rows = mixing.op1(spark, tables[0]).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        text = next(t for i, t, *_ in DOCS if i == r.doc_id)
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
    twins = [r.taken for r in rows if r.doc_id == 1]
    assert twins[0] == twins[1]
    out = mixing.mix(docs)
    assert out.schema["size"].dataType.typeName() == "long" and "text" in out.columns


def test_mixing_targets_fill_up(spark):
    t = spark.createDataFrame([("a", 100), ("b", 1000), (None, 0), ("c", 10)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 0 and got["b"] == pytest.approx(1.5 * 1110 - 220)


def test_mixing_is_near_its_targets(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    rows = mixing.mix(df, keep=["doc_id", "source"])
    for r in rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect():
        assert abs(r.t - r.target) <= 25
    assert sorted(rows.collect()) == sorted(mixing.mix(df, keep=["doc_id", "source"]).collect())


def test_mixing_thresholds_nest(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    last = {}
    for share in (0.3, 0.8, 1.5):
        now = {r.doc_id: r.copies for r in mixing.mix(df, share=share, keep=["doc_id"]).collect()}
        assert all(now[k] >= n for k, n in last.items())
        last = now


def chat_unescape(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="<|\\>\nim_endstar😀", max_size=12), min_size=1, max_size=4))
def test_chat_round_trip(spark, texts):
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    r = out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted").cast("binary"), F.col("loss")).alias("learnt")).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, t) for *_, role, t in rows]
    data = r.formatted.encode()
    mine = [t for *_, role, t in rows if role == "assistant"]
    assert [chat_unescape(data[s.start : s.start + s.size].decode()) for s in r.loss] == mine
    assert r.learnt == mine


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3/a.png", None), None, ("audio", None, "b.wav", 7), ("other", "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df, parts=F.col("parts")).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|>end<|im_end|>\n"
    assert [(a.kind, a.ref, a.n_tokens) for a in r.attachments] == [("image", "s3/a.png", 256), ("audio", "b.wav", 7)] and r.expanded_tokens == 263


def test_chat_small_cases(spark, tables):
    got = {r.conv_id: r for r in chat.op2(spark, tables[0]).collect()}
    said = "user\nhi\nassistant\n\nassistant\n<\\|x <|im_end|>\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 3
    assert got[1].loss_sha256 == hashlib.sha256(b"<\\|x <|im_end|>\n").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"a\nb<|\n\n").hexdigest() and got[2].n_turns == 1 and -1 in got


def test_classifier(spark, tables):
    rows = classifier.op3(spark, tables[0]).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows}[1] == (zlib.crc32(b"1") % 3 == 1)
    assert classifier.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = classifier.fit(np.ones((4, 3)), np.ones(4)).score(np.ones((1, 3)))[0]
    assert one == pytest.approx(5 / 6)


def test_trees_by_brute_force():
    """Scores by walking each tree row by row; the first split by trying every feature and every cut."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 2] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    model = classifier.fit(x, y, trees=5, depth=3, bins=300, least=10)

    def walk(row):
        total = model.base
        for t in range(5):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = {}
    for f in range(4):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if 10 <= left.sum() <= len(y) - 10:
                gain[f, cut] = sum(g[part].sum() ** 2 / (h[part].sum() + 1) for part in (left, ~left))
    f, cut = model.feature[0, 0], model.threshold[0, 0]
    left = x[:, f] <= cut
    got = sum(g[part].sum() ** 2 / (h[part].sum() + 1) for part in (left, ~left))
    assert f == 2 and got >= 0.999 * max(gain.values())


def test_classifier_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = [r for r in classifier.op3(spark, sf).collect() if r.held_out and y.get(r.doc_id) is not None]
    assert np.mean([(r.score >= 0.5) == y[r.doc_id] for r in got]) > 0.95


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w, hit, ids = words(text), set(), set()
    for i, item in items:
        q = words(item)
        n = min(13, len(q))
        for a in range(len(q) - n + 1) if n else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == q[a : a + n]:
                    hit |= set(range(b, b + n))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_decontaminate_against_brute_force(spark):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice(["the", "of", "a", "Öl", "öl", "rare", "b1", "zzz"], n, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.04, 0.04, 0.02]))
    items = [(k, say(n)) for k, n in enumerate((20, 13, 14, 5, 1, 30))] + [(9, ""), (10, None)]
    texts = [say(80) for _ in range(12)] + ["--" + items[0][1].upper() + "!", say(20) + " " + items[1][1], items[2][1] * 2, "", None, "zzz", LONG[:2000] + items[5][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}


def test_decontaminate_small_cases(spark, tables, docs, monkeypatch):
    got = {r.doc_id: r for r in decontaminate.op4(spark, tables[0]).collect()}
    assert got[1].n_hit == 7 and got[1].contaminated and got[2].n_words == 0 and not got[3].contaminated and got[None].n_words == 6
    assert got[4].n_words == len(words(LONG))
    out = decontaminate.contamination(docs, table(spark, tables[0], "benchmark"), prefix="__")
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(DOCS)
    few = decontaminate.contamination(docs, table(spark, tables[0], "benchmark"), keep=["doc_id"])
    want = sorted(few.collect(), key=str)
    for name, value in (("BROADCAST_ROWS", 0), ("BROADCAST_NAMES", -1)):
        monkeypatch.setattr(decontaminate, name, value)
    monkeypatch.setattr("growmap.llm.common.BROADCAST_ROWS", 0)
    few = decontaminate.contamination(docs, table(spark, tables[0], "benchmark"), keep=["doc_id"])
    assert sorted(few.collect(), key=str) == want


def test_decontaminate_beside_clashing_columns(spark, tables, docs):
    more = docs.withColumns({c: F.lit("x") for c in ("found", "__key", "__k1", "k1", "k2", "salt", "item", "items", "n_hit", "__n_hit", "_n_hit")})
    out = decontaminate.contamination(more, table(spark, tables[0], "benchmark"))
    assert sorted(out.columns) == sorted({*more.columns, "n_words", "n_hit", "items"}) and out.count() == len(DOCS)
    assert {r.doc_id: r.n_hit for r in out.collect()}[1] == 7
    kept = decontaminate.clean_documents(more, table(spark, tables[0], "benchmark"))
    assert kept.columns == more.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, 5, 6, None]
    assert decontaminate.clean_documents(more, table(spark, tables[1], "benchmark")).count() == len(DOCS)


def test_decontaminate_repeated_passages(spark):
    """A text that repeats a passage many times, and a passage that all items and many texts share."""
    passage = " ".join(f"p{k}" for k in range(15))
    items = [(k, f"own{k} {passage} end{k}") for k in range(12)]
    texts = [" ".join([passage] * 60), *[f"t{k} {passage} {passage}" for k in range(40)], *["copy " + passage] * 40, "p0 p1 p2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    names = sorted(str(k) for k in range(12))
    assert got[0] == (900, 900, names) and got[1] == (31, 30, names) and got[41] == (16, 15, names) and got[81] == (3, 0, [])


def test_proximity(spark):
    docs = spark.createDataFrame([("a b c d e a",), ("b x x x x x x a",), ("b x x x x x x a",), (None,)], "text string")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "a")], "pair int, first string, second string")
    got = sorted((r.pair, r.pos, r.other) for r in decontaminate.proximity(docs, pairs, 4).collect())
    assert got == [(1, 0, 1), (1, 5, 1)]
    assert decontaminate.proximity(docs, pairs, 7).filter("pair = 1").count() == 3


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def counts(c, texts, *size):
    return c.count(pa.array(texts, pa.string()), *size).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="aAbetioné'sIıİ́ẛ̣Σ09² .,!\x1c\x85 <|endoftext>漢😀", max_size=40) | st.none(), max_size=4))
def test_tokens_as_the_library_counts(library, texts):
    c = tokens.counter(tokens.tokenizer_path())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert all(counts(c, texts, size) == n for size in (1, 12, 40, tokens.SLICE))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "-", "--", " ", "'s", *map(chr, range(0x2000, 0x200B))]), max_size=30).map("".join))
def test_block_ends_as_the_library_counts(library, text):
    c = tokens.counter(tokens.tokenizer_path())
    n = len(library.encode(text, add_special_tokens=False).ids)
    assert all(counts(c, [text], size) == [n] for size in (1, 4, 12, 28, 1 << 16))


def test_long_texts_as_the_library_counts(library):
    c = tokens.counter(tokens.tokenizer_path())
    rng = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    for text in ("ab" * 3000, "x" * 5001, word(20_000), "antidisestablishmentarianism" * 300, " ".join(word(int(n)) for n in rng.integers(1, 60, 2000)), "漢" * 3000 + "\u2003" * 2 + word(50)):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert counts(c, [text, text]) == [n, n] and counts(c, [text], 999) == [n]


def test_a_table_that_starts_anew_counts_the_same(library):
    small = tokens.Counter(tokens.tokenizer_path(), slot_bits=10, max_states=50)
    rng = np.random.default_rng(4)
    text = " ".join("".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(1, 12, 300))
    runs = [text, "y" + text.replace(" ", "")]
    group, tokens.GROUP = tokens.GROUP, 3
    try:
        assert counts(small, runs) == [len(library.encode(t, add_special_tokens=False).ids) for t in runs]
    finally:
        tokens.GROUP = group
    assert len(small.machine.keys) < 50 + 4 * 16 + 1 and 2 * small.machine.used < (1 << 10) + 4 * 16


def test_memory_of_rare_words_has_a_bound():
    """2 MB of random words, which would make ten times as many states, take less than 200 MB beyond the loaded
    tokenizer."""
    code = """if 1:
        import resource, numpy as np, pyarrow as pa
        from growmap.llm import tokens
        c = tokens.counter(tokens.tokenizer_path())
        rng = np.random.default_rng(1)
        words = np.frombuffer(rng.integers(97, 123, 2 << 20, dtype=np.uint8).tobytes(), np.uint8).copy()
        words[rng.random(len(words)) < 0.12] = 32
        texts = pa.array([words.tobytes().decode()])
        peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        before = peak()
        assert c.count(texts)[0] > 1 << 19
        print((peak() - before) // 1024)
    """
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert int(got.stdout) < 200


def test_tokens_beside_clashing_columns(spark, docs):
    more = docs.withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit("y"), "__text": F.lit("z")})
    got = tokens.count_tokens(more, keep=("doc_id", "n_bytes", "n_tokens"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"] and dict(got.dtypes)["n_tokens"] == "bigint"
    want = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want


def test_tokens_small_cases(spark, tables, library):
    got = {r.doc_id: r for r in tokens.op5(spark, tables[0]).collect()}
    for i, t, *_ in DOCS:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and got[i].n_bytes == len((t or "").encode())
    c = tokens.counter(tokens.tokenizer_path())
    assert counts(c, ["a<|endoftext|>b<|startoftext|>"])[0] == len(library.encode("a<|endoftext|>b<|startoftext|>", add_special_tokens=False).ids) == 4


def test_chunk_maps_compose():
    m = tokens.counter(tokens.tokenizer_path()).machine
    for word in (b"antidisestablishmentarianism" * 9, b"ab" * 100, b"x" * 77, b"a"):
        symbols = np.frombuffer(word, np.uint8).astype(np.int64)
        symbols[-1] += 256
        state, whole = 0, 0
        for s in symbols.tolist():
            value = m.step(state, s)
            state, whole = value >> 8, whole + (value & 255) - 128
        assert state == 0 and m.count(np.frombuffer(word, np.uint8), np.array([0, len(word)])).tolist() == [whole]
        for size in (1, 3, 16):
            begin = np.arange(0, len(word), size)
            length, head = np.minimum(len(word) - begin, size), begin == 0
            entry, exit_, n = m.maps(symbols, begin, length, head, 0)
            assert tokens.scan(entry, exit_, n, head).tolist() == np.cumsum(n).tolist() and n.sum() == whole


def test_tokens_fit_as_the_merges_leave_them():
    m = tokens.counter(tokens.tokenizer_path()).machine
    rng = np.random.default_rng(6)
    for a, b in zip(rng.integers(0, 3000, 4000).tolist(), rng.integers(0, 3000, 4000).tolist()):
        if all(m.bpe(m.split(t)) == [t] for t in (a, b)) and not 256 <= m.split(a)[-1]:
            assert m.fits(a, b) == (m.bpe(m.split(a) + m.split(b)) == [a, b])


def test_jump_by_the_published_loop():
    def slow(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(0).integers(0, 2**63, 500)
    for n in (1, 2, 40, 41):
        assert sharding.jump(keys, n).tolist() == [slow(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(b[a != b]) <= {40}


def test_sharding_small_cases(spark, tables, docs):
    rows = sharding.op6(spark, tables[0]).collect()
    assert len(rows) == len(DOCS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        text = next(t for i, t, *_ in DOCS if i == r.doc_id) or ""
        assert r.text_crc32 == zlib.crc32(text.encode()) and r.size == len(text.encode()) + 16
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard(docs.withColumn("shard", F.lit("x")), 5).schema["shard"].dataType.typeName() == "integer"


def test_warc_small_cases(spark, tables):
    got = {r.page_id: r for r in warc.op7(spark, tables[0]).collect()}
    assert [got[k].record_type for k in range(1, 8)] == ["response", "revisit", "revisit", "response", "response", "response", "response"]
    assert got[3].refers_to == 1 and got[1].refers_to is None and got[6].payload_bytes == 0
    for k, text in ((2, "x" * 200), (7, "y\r\n\r\nWARC/1.1\r\n" * 20), (6, "")):
        assert got[k].payload_digest == hashlib.sha256(text.encode()).hexdigest() and got[k].payload_bytes == len(text)


def test_warc_ids_of_other_types(spark, tmp_path):
    pages = spark.createDataFrame([("b<x>", "u", "x" * 200), ("a", "u", "x" * 200), (None, "u", "y")], "page_id string, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op7(spark, str(tmp_path)).collect()}
    assert got == {"a": ("response", None), "b<x>": ("revisit", "a"), None: ("response", None)}
    warc.write_warc(pages, f"{tmp_path}/w", file_records=1)
    assert sum(p.stat().st_size > 0 for p in tmp_path.glob("w/part-*")) == 3 and warc.read_warc(spark, f"{tmp_path}/w").count() == 3


def test_warc_pushdown(spark, tables, tmp_path):
    for compression in (None, "gzip"):
        path = str(tmp_path / str(compression))
        warc.write_warc(table(spark, tables[0], "pages"), path, compression)
        some = warc.read_warc(spark, path).filter("record_type = 'revisit'")
        assert sorted(r.target_uri or "" for r in some.collect()) == ["a%0D%0Ab", "u"]
        assert warc.read_warc(spark, path).filter(F.col("record_id").isin("<urn:page:7>", "<urn:page:9>")).count() == 1
        assert warc.read_warc(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader(path, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted == [("warc-type", {"revisit"})]


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(tri)
    inside = {k + d for k, t in enumerate(tri) if n[t] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@given(st.text(alphabet="ab \n\t#|é😀\x0b \x1c", max_size=80))
def test_statistics_by_brute_force(text):
    assert outliers.text_stats(text.encode())[:5] == brute_stats(text)


def test_outliers_small_cases(spark, tables):
    got = {r.doc_id: r for r in outliers.op8(spark, tables[0]).collect()}
    for i, t, *_ in DOCS:
        assert tuple(got[i][c] for c in outliers.STATS) == brute_stats(t)
        assert got[i].base_failed == (got[i].n_words < 50 or 100 * got[i].n_repeat_words > 50 * got[i].n_words)
    assert not any(r.kept for r in got.values() if r.base_failed)


def brute_mcd(x, share=outliers.KEEP_SHARE):
    """C-steps to a fixed point from the same start, with an exact subset."""
    radius = outliers.chi2_above(1 - share, outliers.DIM)
    factor = share / (1 - outliers.chi2_tail(radius, outliers.DIM + 2))
    floor = np.diag(np.square(outliers.FLOORS))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor
    for _ in range(50):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        part = x[np.argsort(d, kind="stable")[: int(np.ceil(share * len(x)))]]
        mean, cov = part.mean(0), factor * np.cov(part.T, bias=True) + floor
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_outlier_verdicts_against_exact_mcd(spark):
    sf = "/root/testdata/sf0.01"
    cut = outliers.chi2_above(outliers.TAIL, outliers.DIM)
    docs = table(spark, sf, "documents").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    stats = outliers.stats_of(docs, ("doc_id", "lang", "source"))
    got = outliers.judge(stats).filter(~F.col("base_failed")).select("doc_id", "distance2", "kept", *[v.alias(f"v{k}") for k, v in enumerate(outliers.vector())]).collect()
    want = brute_mcd(np.array([[r[f"v{k}"] for k in range(4)] for r in got]))
    near = np.abs(want - cut) < 0.2 * cut
    assert near.mean() < 0.02 and all(r.kept == (d <= cut) for r, d, n in zip(got, want, near) if not n)
    assert 0 < sum(not r.kept for r in got) < 0.2 * len(got)


def test_outliers_reject_repetition_alone(spark):
    text = lambda i, n: [f"w{(37 * i + k) % 900 + 100}" for k in range(n)]
    clean = [(i, "\n".join(" ".join(text(i, 120)[k : k + 8]) for k in range(0, 120, 8))) for i in range(200)]
    lines = " ".join(text(7, 80)) + "\nw100" * 20
    half = " ".join(["w101 w102 w103 w104"] * 12 + text(9, 52))
    trace = clean[3][1] + "\nw105\nw105"
    rows = [*clean, (1000, lines), (1001, half), (1002, trace)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.rated(docs, ("doc_id",)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001}
    assert {r.doc_id for r in outliers.clean_documents(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_outliers_least_rows_of_a_group(spark):
    plain = [(i, " ".join(f"w{(37 * i + k) % 900 + 100}" for k in range(80))) for i in range(26)]
    odd = (100, " ".join(f"w{k}###" for k in range(100, 180)))
    for rows, rejected in ((plain[:25], set()), (plain, {100})):
        docs = spark.createDataFrame([(i, t, "en", "a") for i, t in [*rows, odd]], "doc_id bigint, text string, lang string, source string")
        assert {r.doc_id for r in outliers.rated(docs, ("doc_id",)).filter("NOT kept").collect()} == rejected


def test_outlier_stage_keeps_columns(spark, docs):
    assert outliers.clean_documents(docs).columns == docs.columns


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@given(st.text(alphabet="aAb éÉ\n\x0b \x1c", max_size=60))
def test_fingerprint_by_brute_force(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def reach(fps):
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_links_and_components(spark):
    rng = np.random.default_rng(2)
    fps = [0, 1 << 63, (1 << 64) - 1]
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(12):  # chains whose ends are far apart
            base ^= int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
            fps.append(base)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "id bigint, fp bigint")
    got = {r.id: r.component for r in simhash.grouped(rows).collect()}
    assert got == dict(enumerate(reach(fps)))
    path = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(path).collect()} == {0}
    assert simhash.components(path.limit(0)).count() == 0


def test_simhash_small_cases(spark, tables, docs):
    got = {r.doc_id: r for r in simhash.op9(spark, tables[0]).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{brute_fingerprint(t):016x}" for i, t, *_ in DOCS}
    assert got[2].component_id == got[3].component_id == got[5].component_id == 2 and got[None].component_id is None
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 6, None]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    """One fingerprint, one component and one row hold half of all, over 211 partitions."""
    rng = np.random.default_rng(8)
    fps = [0] * 600 + [1 << int(k) for k in rng.integers(0, 40, 300)] + rng.integers(1 << 40, 1 << 60, 300).tolist()
    rows = spark.createDataFrame(list(enumerate(fps)), "id bigint, fp bigint").repartition(211)
    want = {r.id: r.component for r in simhash.grouped(rows).collect()}
    monkeypatch.setattr("growmap.llm.common.HOT_ROWS", 5)
    monkeypatch.setattr("growmap.llm.common.BROADCAST_ROWS", 400)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert {r.id: r.component for r in simhash.grouped(rows).collect()} == want
        star = spark.createDataFrame([(0, k) for k in range(1, 400)] + [(k, k + 1000) for k in range(400)], "a bigint, b bigint")
        assert {r.root for r in simhash.components(star).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {want[k] for k in range(600)} == {0}


def test_slots_of_rows_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(7, 2, 0)] * 95 + [(None, None, 1)] * 3, "doc_id bigint, size bigint, shard int")
    for alike, per_bucket in ((10_000, 50_000), (10, 4)):
        monkeypatch.setattr(sharding, "ALIKE", alike)
        monkeypatch.setattr(sharding, "BUCKET_ROWS", per_bucket)
        got = sharding.number(rows, "shard", mixing.hash60(F.col("doc_id")), ["doc_id", "size"]).collect()
        assert sorted((r.doc_id, r.size, r.shard) for r in got if r.shard == 0) == sorted([(k, 1, 0) for k in range(50)] + [(7, 2, 0)] * 95)
        assert sorted(r.slot for r in got if r.shard == 0) == list(range(145)) and sorted(r.slot for r in got if r.shard == 1) == [0, 1, 2]
        alike_slots = sorted(r.slot for r in got if r.size == 2)
        assert alike_slots == list(range(alike_slots[0], alike_slots[0] + 95))


def test_classifier_learns_from_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text number {k % 3}") for k in range(2000)] + [(2, "other " * 9), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id bigint, quality int")
    seen = []
    fit, classifier.fit = classifier.fit, lambda x, y, **kw: seen.append(len(y)) or fit(x, y, **kw)
    try:
        model = classifier.train(docs, labels)
    finally:
        classifier.fit = fit
    assert seen == [4] and classifier.score(docs, model).count() == 2002


def test_stages_beside_clashing_columns(spark, docs):
    own = ("__own", "__k1", "__k2", "__lang", "__source", "__size", "__h", "__key", "own", "k1", "key", "_own")
    more = docs.withColumns({c: F.lit(c) for c in own})
    outs = [outliers.clean_documents(more), simhash.one_of_each(more), mixing.mix(more, prefix="p_"), sharding.shard(more, 5)]
    for out in outs:
        assert set(more.columns) <= set(out.columns) and {r for r in out.select(*own).distinct().collect()} <= {own}
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int")
    odd = docs.withColumns({c: F.lit("x") for c in ("__h", "__id", "__y", "t", "h", "y")})
    assert classifier.score(odd, classifier.train(odd, labels), ("doc_id", "__h")).count() == len(DOCS)


def test_outlier_verdicts_over_partitionings(spark):
    """Two groups of thousands of rows; the verdicts don't depend on how these are dealt."""
    text = lambda i: " ".join(f"w{(i * 7919 + k * k * 31) % 5000}{'#' * (i % 61 == 0)}" for k in range(60 + i % 90)) + "\nsame line of it" * (i % 53 == 0) * 30
    docs = spark.createDataFrame([(i, text(i), "en", "ab"[i % 2]) for i in range(6000)], "doc_id bigint, text string, lang string, source string")
    stats = outliers.stats_of(docs, ("doc_id", "lang", "source")).cache()
    got = []
    for parts in (3, 50):
        dealt = stats.repartition(parts, F.xxhash64("doc_id", F.lit(parts)))
        got.append({r.doc_id: r.kept for r in outliers.judge(dealt).select("doc_id", "kept").collect()})
    stats.unpersist()
    odd = {i for i in range(6000) if i % 61 == 0 or i % 53 == 0}
    assert got[0] == got[1] and {i for i, kept in got[0].items() if not kept} == odd


def test_junk_is_caught_and_clean_rows_stay(spark):
    """Of the documents that the labels call bad or good, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id: r.kept for r in outliers.op8(spark, sf).collect()}
    share = lambda q: np.mean([kept[i] for i in kept if y.get(i) == q])
    assert share(1) > 0.93 and share(0) < 0.02


def test_html_small_cases(spark, tables):
    got = {r.page_id: r for r in html.op10(spark, tables[0]).collect()}
    assert got[6].text == "" and got[6].n_chars == 0 and got[4].text in ("", "same")
    page = "<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><article><h1>A &amp; B&nbsp;c</h1><p>one<br>two\n three<p>four <b>fi</b>ve<script>x('</p>')</script><!-- c --><aside>more to read</aside><div class='ad-box'>buy this</div></article><section id=comments><p>nice text, thanks a lot to you</p></section><footer>&copy; x</footer><form>go<input></form></body>"
    assert html.main_text(page) == "A & B c\n\none two three\n\nfour five"
    assert html.main_text("<article><p>x &am<b>p;</b> y") == "x &amp; y"
    for broken in ("", None, "<", "<p", "a < b", "<p title='x>y", "<!-- never ends", "<script>never ends", "&am &#x; &#99999999999;", "</p></div>"):
        assert isinstance(html.main_text(broken), str)
    assert len(html.main_text("<article>" + "<p>w " * 20_000)) > 50_000


#: Pages in layouts and words that the labelled ones don't have; main text carries a mark.
OTHER_PAGES = (
    "<body class='no-sidebar'><div class='page-header'><a href=/>The Daily</a><p>news since 1900</p></div><ul class='nav-list'><li><a>Home</a><li><a>World</a><li><a>Sport</a></ul><div id='cookieConsent'><p>We use cookies to give you the best experience on our site, please accept them all or change settings.</p></div><main><h1 m>A long and winding road to somewhere</h1><p m>{45}</p><div class='ad-slot'><p>Buy the new phone now and save a lot of money today only in our shop.</p></div><p m>{70}</p><p m>Short one.</p></main><div class='comment-list'><p>{38}</p><p>I agree.</p></div><form><label>Your name</label><p>Leave a reply below and we will publish it</p></form><footer><p>All rights reserved by the publisher of this site.</p></footer>",
    "<header><nav><a>One</a> <a>Two</a></nav></header><article class='story'><header><h1 m>Title of this story</h1></header><p m>{45}</p><p m>{70}</p><section class='comments'><h2>Comments</h2><p>{38}</p></section></article><aside><h3>Latest</h3><p>Something else that happened today in the city.</p></aside>",
    "<div id='wrapper'><div id='navigation'><a>a</a> <a>b</a> <a>c</a></div><div class='entry-content'><h2 m>Heading words here</h2><p m>{45}</p><ul><li m>first thing to know</li><li m>second thing that you should know</li></ul><p m>{70}</p></div><div class='sidebar-widget'><p>{38}</p></div><div id='bottom'><p>imprint and so on</p></div></div>",
    "<div><a>Start</a> <a>About us</a> <a>Contact</a></div><div><h1 m>What the wind brought</h1><div m>{45}</div><div m>{70}</div></div><div><a>Older posts here</a></div><div><a>Newer posts</a></div>",
)


def block_verdicts(page, with_markup=True):
    m = html.default_model()
    found = html.blocks(page, m.says if with_markup else None, labelled=True)
    return [(html.is_main(m.tree, v), b) for b, v in zip(found, html.vectors(found))]


def test_html_of_other_layouts():
    pages = [re.sub(r"\{(\d+)\}", lambda m: " ".join(f"word{k}" for k in range(int(m[1]))), p).replace(" m>", " data-main>") for p in OTHER_PAGES]
    got = [(kept == b.main) for p in pages for kept, b in block_verdicts(p)]
    assert np.mean(got) >= 0.95


def test_html_by_densities_alone(spark):
    """The test pages with nothing but divs, headings and links: 0.97 of the blocks."""
    rows = table(spark, "/root/testdata/sf0.01", "pages").collect()
    bare = lambda p: re.sub(r"<(/?)(article|nav|footer|ul|li)>", r"<\1div>", p).replace(' class="ad"', "")
    right = [(kept == (b.text in set(html.main_text(r.html).split("\n\n")))) for r in rows for kept, b in block_verdicts(bare(r.html), with_markup=False)]
    assert np.mean(right) > 0.95


def test_html_tree_uses_every_density():
    assert {html.FEATURES[f] for f in html.default_model().tree["feature"] if f >= 0} >= {f for f in html.FEATURES if f.startswith(("words", "links")) and f != "links_before2"}


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a "<a" ', "<div>", "<div></p>", "<li><p>", "<script ", "<!--", "<", "&amp", "</", "<p class='x' "])
def test_html_of_long_malformed_pages(part):
    start = time.perf_counter()
    html.main_text(part * ((5 << 20) // len(part)))
    assert time.perf_counter() - start < 10


def test_html_beside_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>main text of it", "x", "y"), (1, "u", None, "x", "y")], "page_id int, url string, html string, text string, n_chars string")
    got = html.extract(pages, keep=("page_id", "url", "text", "n_chars")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "main text of it", 15), (1, "u", "", 0)]


def test_html_of_the_test_pages(spark):
    import html as h

    def want(page):
        m = re.search(r"<article>(.*?)</article>", page, re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1])
        return "\n\n".join(x for x in (" ".join(h.unescape(re.sub(r"<br>|</?b>", " ", p)).split()) for p in parts) if x)

    rows = table(spark, "/root/testdata/sf0.01", "pages").collect()
    assert [html.main_text(r.html) for r in rows] == [want(r.html) for r in rows]


def test_registry_names_all_ten():
    from growmap.llm import registry

    assert list(dict.fromkeys(n.split("_")[0] for n in registry.QUERIES)) == [f"op{k}" for k in range(1, 11)] and set(registry.SQL) <= set(registry.QUERIES)
    json.dumps(registry.SQL)


@pytest.mark.parametrize("name", ["mixing", "decontaminate", "warc", "outliers", "simhash"])
def test_nothing_changes_where_nothing_may_be_sent_out(spark, name, monkeypatch):
    """The ways beyond the checked sizes, salted and shuffled, give the same rows."""
    sf = "/root/testdata/sf0.001"
    want = sorted(OPS[name](spark, sf).collect(), key=repr)
    for module in ("common", "decontaminate", "outliers", "simhash"):
        monkeypatch.setattr(f"growmap.llm.{module}.BROADCAST_ROWS", -1)
    monkeypatch.setattr(decontaminate, "BROADCAST_NAMES", -1)
    assert sorted(OPS[name](spark, sf).collect(), key=repr) == want


def test_stages_where_nothing_may_be_sent_out(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    stages = (outliers.clean_documents, simhash.one_of_each, lambda d: decontaminate.clean_documents(d, bench))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    want = [ids(f(docs)) for f in stages]
    for module in ("common", "decontaminate", "outliers", "simhash"):
        monkeypatch.setattr(f"growmap.llm.{module}.BROADCAST_ROWS", -1)
    monkeypatch.setattr(decontaminate, "BROADCAST_NAMES", -1)
    assert [ids(f(docs)) for f in stages] == want


def test_discard_removes_what_was_written(spark):
    import os

    from growmap.llm import common

    common.written(spark.range(3), "some")
    path = common.WRITTEN[-1].removeprefix("file:")
    assert os.path.exists(path) and common.discard(spark) > 0 and not os.path.exists(path) and not common.WRITTEN
