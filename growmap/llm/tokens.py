"""Operator 5: token counts by a finite-state tokenizer compiled from a vocabulary file.

Word-level BPE is run as a deterministic transducer over the bytes of a word. Its state holds, for each
place from which a token could still reach beyond the current byte, where in the trie of the vocabulary
what has been read since stands, the token that ends at that place, and how many tokens fewer there are
up to it. Reading a byte finds the one token that ends there and fits the token before it (two tokens
fit if BPE leaves them apart), so a transition is annotated with the change in the number of tokens.
States and transitions are compiled when first met, into one flat table of integers; beyond
``MAX_STATES`` the table starts anew, so its size has a bound whatever the texts hold.

Texts are taken in slices of at most ``SLICE`` bytes: many short texts, or a part of a long one, which
is cut at white space. White space brings every state back to the start, so the maps of the parts
compose by adding their counts. Of a slice only the distinct words are run. Their bytes are cut into
chunks of ``CHUNK``; all chunks are run at once, from the start state, then from the exit state of the
chunk before them, and where the true entry state is another one, again from that. The chunk maps
(entry state, exit state, count) then compose by a parallel prefix scan to the counts of words.

Defined cases: null and empty texts have 0 tokens; strings of special tokens in a text count as one
token, the library's default; a text of any length is counted whole, and one without white space
makes one slice; repeated rows get the same count each; an empty table gives an empty result; columns
of docs that aren't kept are ignored, and a kept one named like the result is replaced by it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm.common import table

#: Letters and numbers assigned after Unicode 16, which the library takes for neither.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEITHER = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split())
#: Lower case of letters that this Python's tables don't have yet.
LOWER = dict(zip("\u1c89\ua7cb\ua7cc\ua7ce\ua7d2\ua7d4\ua7da\ua7dc", "\u1c8a\u0264\ua7cd\ua7cf\ua7d3\ua7d5\ua7db\u019b")) | {chr(c): chr(c + 0x20) for c in range(0x10D50, 0x10D66)} | {chr(c): chr(c + 0x1B) for c in range(0x16EA0, 0x16EB9)}
#: The pre-tokenizer's words, and the white space between them. Fixed values of the file's format.
WORDS = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NEITHER}]]+|[\p{{N}}--[{NEITHER}]]|(?:[^\s\p{{L}}\p{{N}}]|[{NEITHER}])+"
#: The same words where all is ASCII and in lower case, with line feeds as words of their own.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+|\n")
#: Bytes of texts counted at once, bytes of a chunk, and chunks that are run between looks at the table's size.
SLICE, CHUNK, GROUP = 4 << 20, 16, 1 << 13
#: The table's slots as a power of 2, and the states up to which it grows: about 60 MB with their keys.
SLOT_BITS, MAX_STATES = 20, 200_000
#: Symbols are bytes, and bytes that end a word; no token stands before a word.
SYMBOLS, NONE = 512, 0xFFFF


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Transducer:
    """Counts of BPE tokens; state 0 is the start of a word. A token is its symbol, or SYMBOLS + its rank."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str, slot_bits: int = SLOT_BITS, max_states: int = MAX_STATES) -> None:
        symbols = byte_symbols()
        ids = {s: k for k, s in enumerate([*symbols, *(s + suffix for s in symbols)])}
        if len(merges) + SYMBOLS > NONE:
            raise ValueError("more tokens than a state has bits for")
        self.parts = array("q")
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            self.parts.extend((ids[a], ids[b]))  # so parts are always of lower rank
            self.ranks[ids[a] << 16 | ids[b]] = rank
            if ids.setdefault(a + b, SYMBOLS + rank) != SYMBOLS + rank:
                raise ValueError(f"two merges make {a + b!r}")
        self.trie: dict[int, int] = {}
        self.token, self.goes_on = array("i", [-1]), bytearray(1)
        for token in range(SYMBOLS + len(merges)):
            node = 0
            for s in self.split(token):
                self.goes_on[node] = 1
                if (child := self.trie.setdefault(node << 9 | s, len(self.token))) == len(self.token):
                    self.token.append(-1)
                    self.goes_on.append(0)
                node = child
            if self.bpe(self.split(token)) == [token]:
                self.token[node] = token
        self.bits, self.max_states = slot_bits, max_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.used = 0
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.state([self.pack(0, NONE, 0)])

    @staticmethod
    def pack(node: int, before: int, less: int) -> int:
        return node << 24 | before << 8 | less + 128

    def state(self, live: list[int]) -> int:
        key = array("q", live).tobytes()
        at = self.ids.setdefault(key, len(self.keys))
        if at == len(self.keys):
            self.keys.append(key)
        return at

    def split(self, token: int) -> list[int]:
        """The symbols of a token."""
        out, todo = [], [token]
        while todo:
            if (t := todo.pop()) < SYMBOLS:
                out.append(t)
            else:
                k = 2 * (t - SYMBOLS)
                todo += [self.parts[k + 1], self.parts[k]]
        return out

    def bpe(self, tokens: list[int]) -> list[int]:
        """The merges in order of rank; for short input."""
        tokens = list(tokens)
        while len(tokens) > 1:
            rank, k = min((self.ranks.get(a << 16 | b, 1 << 60), k) for k, (a, b) in enumerate(zip(tokens, tokens[1:])))
            if rank == 1 << 60:
                break
            tokens[k : k + 2] = [SYMBOLS + rank]
        return tokens

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b. At any time a's last part stands beside b's first one; each
        is taken up by its own parent at that one's rank, a's before b's, as merges go from left to right."""
        if a == NONE:
            return True
        lasts, firsts = [(a, 1 << 60)], [(b, 1 << 60)]
        while a >= SYMBOLS:
            lasts.append((self.parts[2 * (a - SYMBOLS) + 1], a - SYMBOLS))
            a = lasts[-1][0]
        while b >= SYMBOLS:
            firsts.append((self.parts[2 * (b - SYMBOLS)], b - SYMBOLS))
            b = firsts[-1][0]
        ranks = self.ranks
        while True:
            (x, until), (y, until_y) = lasts[-1], firsts[-1]
            rank = ranks.get(x << 16 | y, 1 << 60)
            if rank < until and rank <= until_y:
                return False
            if until == until_y == 1 << 60:
                return True
            (lasts if until <= until_y else firsts).pop()

    def step(self, state: int, symbol: int) -> int:
        """Compiles a transition: next state << 8 | change in the number of tokens + 128."""
        found, live = -1, []
        for p in array("q", self.keys[state]):
            if (child := self.trie.get(p >> 24 << 9 | symbol)) is None:
                continue
            before, less = p >> 8 & 0xFFFF, (p & 255) - 128
            if found < 0 and (token := self.token[child]) >= 0 and self.fits(before, token):
                found, change = token, less + 1
            if self.goes_on[child]:
                live.append((child, before, less))
        if symbol >= 256:
            return change + 128
        return self.state([*(self.pack(child, before, less - change) for child, before, less in live), self.pack(0, found, 0)]) << 8 | change + 128

    def find(self, key: np.ndarray) -> np.ndarray:
        """Values of state << 9 | symbol; -1 where there is none yet."""
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slots[at]
        out = np.where(got == key, self.values[at], -1)
        todo = np.flatnonzero((got != key) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            got = self.slots[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def value(self, key: int) -> int:
        """The same of one key, compiled if need be."""
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while (got := int(self.slots[at])) != key:
            if got == -1:
                made = self.step(key >> 9, key & 511)
                self.slots[at], self.values[at] = key, made
                self.used += 1
                return made
            at = (at + 1) & (len(self.slots) - 1)
        return int(self.values[at])

    def run(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each chunk, all chunks at once."""
        order = np.argsort(-length, kind="stable")
        begin, up_to, state, n = begin[order], -length[order], entry[order], np.zeros(len(order), np.int64)
        for j in range(int(length.max(initial=0))):
            k = int(np.searchsorted(up_to, -j))  # those longer than j
            key = state[:k] << 9 | symbols[begin[:k] + j]
            value = self.find(key)
            if len(new := np.flatnonzero(value < 0)):
                value[new] = list(map(self.value, key[new].tolist()))
            state[:k] = value >> 8
            n[:k] += (value & 255) - 128
        exit_, out = np.empty_like(state), np.empty_like(n)
        exit_[order], out[order] = state, n
        return exit_, out

    def run_one(self, symbols: np.ndarray, state: int) -> tuple[int, int]:
        n = 0
        for s in symbols.tolist():
            value = self.value(state << 9 | s)
            state, n = value >> 8, n + (value & 255) - 128
        return state, n

    def maps(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, head: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry state, exit state and count of consecutive chunks; ``head``: it begins a word. A first chunk
        that doesn't is entered in state ``carry``."""
        entry = np.zeros(len(begin), np.int64)
        entry[:1] = np.where(head[:1], 0, carry)
        exit_, n = self.run(symbols, begin, length, entry)
        inner = np.flatnonzero(~head[1:]) + 1
        entry[inner] = exit_[inner - 1]
        exit_[inner], n[inner] = self.run(symbols, begin[inner], length[inner], entry[inner])
        for k in inner.tolist():  # states mostly meet again within a chunk; where not, the chunk is run once more
            if entry[k] != exit_[k - 1]:
                entry[k] = exit_[k - 1]
                exit_[k], n[k] = self.run_one(symbols[begin[k] : begin[k] + length[k]], int(entry[k]))
        return entry, exit_, n

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each word; word k is data[offsets[k]:offsets[k + 1]]."""
        size = np.diff(offsets).astype(np.int64)
        total, chunks = np.zeros(len(size), np.int64), -(-size // CHUNK)
        word = np.repeat(np.arange(len(size)), chunks)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        symbols = data.astype(np.int64)
        symbols[offsets[1:][size > 0] - 1] += 256
        begin, length = offsets[:-1][word] + CHUNK * nth, np.minimum(size[word] - CHUNK * nth, CHUNK)
        carry = 0
        for k in range(0, len(word), GROUP):
            if len(self.keys) > self.max_states or 2 * self.used > len(self.slots):
                live = array("q", self.keys[carry])
                self.reset()
                carry = self.state(live)
            part = slice(k, k + GROUP)
            maps = self.maps(symbols, begin[part], length[part], nth[part] == 0, carry)
            n = scan(*maps, nth[part] == 0)
            last = np.flatnonzero(np.append(word[part][1:] != word[part][:-1], True))
            total[word[part][last]] += n[last]
            carry = int(maps[1][-1])
        return total


def scan(entry: np.ndarray, exit_: np.ndarray, n: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Counts of the prefix compositions of maps up to each chunk, from the last head on or, before any, from
    the first chunk. Each round composes all maps with those 1, 2, 4, ... before them."""
    n, going, d = n.copy(), ~head, 1
    going[:1] = False
    if np.any(exit_[:-1][going[1:]] != entry[1:][going[1:]]):
        raise ValueError("a map is entered in another state than it was made for")
    while len(k := np.flatnonzero(going)):
        n[k], going[k] = n[k] + n[k - d], going[k - d]
        d *= 2
    return n


class Lower(dict):
    """Code point -> lower case of that character alone."""

    def __missing__(self, c: int) -> str:
        self[c] = low = LOWER.get(chr(c)) or chr(c).lower()
        return low


class Counter:
    """The tokenizer of a vocabulary file."""

    def __init__(self, path: str, **machine: int) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.machine = Transducer([tuple(m) for m in spec["model"]["merges"]], spec["model"]["end_of_word_suffix"], **machine)
        self.marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.marks)))
        self.words, self.lower = regex.compile(WORDS + r"|\n"), Lower()

    def pieces(self, pieces: pa.StringArray) -> np.ndarray:
        """Tokens of each piece; pieces hold no ASCII white space."""
        extra = np.zeros(len(pieces), np.int64)
        for mark in self.marks:
            extra[pc.match_substring(pieces, mark).to_numpy(zero_copy_only=False)] = 1
        if len(marked := np.flatnonzero(extra)):  # a space in its place parts what was around it, as the library does
            listed = pieces.to_pylist()
            for k in marked.tolist():
                listed[k], extra[k] = self.special.subn(" ", listed[k])
            pieces = pa.array(listed, pa.string())
        out = extra
        plain = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)
        for these in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            if not len(these):
                continue
            joined = "\n".join(pieces.take(pa.array(these)).to_pylist())
            if joined.isascii():
                found = ASCII_WORDS.findall(joined.lower())
            else:
                found = self.words.findall(unicodedata.normalize("NFC", joined).translate(self.lower))
            coded = pa.array(["\n", *found], pa.string()).dictionary_encode()
            code, words = coded.indices.to_numpy()[1:], coded.dictionary
            _, offsets, data = words.buffers()
            offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            n = self.machine.count(np.frombuffer(data, np.uint8)[: offsets[-1]], offsets)
            n[0] = 0
            out[these] += np.bincount(np.cumsum(code == 0), n[code], len(these)).astype(np.int64)
        return out

    def slice(self, texts: pa.StringArray) -> np.ndarray:
        """Tokens of each of some texts. Their pieces between white space are counted once each."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        n = self.pieces(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return np.diff(upto[np.concatenate(([0], ends))])

    def count(self, texts: pa.Array, size: int = SLICE) -> np.ndarray:
        """Tokens of each text, in slices of at most ``size`` bytes where white space lets them be cut."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        out, length = np.zeros(len(texts), np.int64), pc.binary_length(texts).to_numpy()
        k = 0
        while k < len(texts):
            if length[k] > size:
                out[k] = sum(int(self.slice(pa.array([part], pa.string()))[0]) for part in parts(texts[k].as_py(), size))
                k += 1
                continue
            stop = k + max(1, int(np.searchsorted(np.cumsum(length[k : k + 100_000]), size, side="right")))
            out[k:stop] = self.slice(texts[k:stop])
            k = stop
        return out


SPACE = re.compile(r"[\t-\r ]")


def parts(text: str, size: int) -> Iterator[str]:
    """The text cut at the first white space from each ``size // 4`` characters on, at most 4 bytes each."""
    at = 0
    while at < len(text):
        found = SPACE.search(text, at + max(1, size // 4))
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens. ``path``: the vocabulary file on every machine, by default
    that of the installed package."""
    rows = docs.select(*[c for c in keep if c != out], F.col(text_col).alias("__text"))
    names = [c for c in keep if c != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or tokenizer_path())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(c.count(b.column(len(names))))], [*names, out])

    return rows.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, keep=("doc_id", "n_bytes")).withColumn("over_limit", F.col("n_tokens") > 2048)
