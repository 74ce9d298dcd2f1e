"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

The vocabulary file is one of the public ``tokenizers`` files with word ends (``word_bpe_49k.json``): texts are
composed (NFC), lower-cased, cut into words and mapped byte by byte to symbols; the last symbol of a word carries
the end mark. Within a word the root of a segment tree yields the leftmost pair of lowest rank; a merge updates at
most three leaves in logarithmic time, until no pair can be merged. So even a word of a million symbols
takes O(n log n). Words that come back are taken from a bounded two-generation cache.

Decoding joins the vocabulary's token strings with a space, as the file asks (it names no decoder).

Edge cases: a null text counts as empty and has no tokens; special tokens within a text are found before
anything else, as the library does; null ids, repeated rows and ties give one row each; an empty table gives an empty
result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table, text_udf

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_WORDS = 120_000
#: Characters up to here (Latin, Greek, Cyrillic) and common punctuation have had the same categories for many
#: Unicode versions; texts with others are composed and cut by the library, whose tables rule.
COMMON = 0x52F
PUNCTUATION = r"\u2010-\u2027\u20ac\u2122"
RARE = re.compile(rf"[^\0-\u{COMMON:04x}{PUNCTUATION}]")
#: White space among them.
SPACE = r"\t-\r \x85\xa0"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PairTree:
    """Segment tree whose leaves hold rank * 2^shift + place for the pair that starts at a place, or ``NONE``."""

    NONE = 1 << 62

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        tree = [self.NONE] * size + leaves + [self.NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree, self.size = tree, size

    def root(self) -> int:
        return self.tree[1]

    def set(self, place: int, value: int) -> None:
        tree, i = self.tree, self.size + place
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low


class Vocabulary:
    """What the file says: tokens, ranked merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.end] for s in symbols]
        kinds = {c: unicodedata.category(c) for c in map(chr, range(COMMON + 1))}
        letters, digits = ("".join(map(re.escape, (c for c, k in kinds.items() if k[0] == x))) for x in "LN")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+")
        self.library = Tokenizer.from_file(path)
        self.bytes = {s: b for b, s in enumerate(symbols)}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None

    def encode_word(self, word: str) -> list[int]:
        """Merge the symbols of a word, always the leftmost pair of lowest rank."""
        data = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        shift = n.bit_length()
        none, mask = PairTree.NONE, (1 << shift) - 1
        tree = PairTree([merges[p][0] << shift | i if (p := (ids[i], ids[i + 1])) in merges else none for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree.root()) != none:
            i = best & mask
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.set(j, none)
            if k < n:
                before[k] = i
                tree.set(i, merges[p][0] << shift | i if (p := (ids[i], ids[k])) in merges else none)
            else:
                tree.set(i, none)
            if (h := before[i]) >= 0:
                tree.set(h, merges[p][0] << shift | h if (p := (ids[h], ids[i])) in merges else none)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """Words of a text, special tokens among them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.parts(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.parts(part)
        return out

    def parts(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        lowered = normal(text)
        if not RARE.search(lowered):
            return self.words.findall(lowered)
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, word)).decode() for word, _ in shown]

    def decode(self, ids) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def normal(text: str) -> str:
    """NFC, then lower case of each character alone (so a capital sigma never takes its final form)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordCache(dict):
    """word -> (ids as little-endian 32-bit bytes, decoded ids). At ``CACHE_WORDS`` words the older generation goes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.old = vocabulary, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        found = self.old.get(word)
        if found is None:
            v = self.v
            ids = [v.special[word]] if word in v.special else v.encode_word(word)
            found = np.array(ids, "<u4").tobytes(), v.decode(ids)
        if len(word) > 64:
            return found
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


@lru_cache(2)
def loaded(path: str) -> WordCache:
    return WordCache(Vocabulary(path))


def encode(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    cache = loaded(path)
    return b"".join([cache[w][0] for w in cache.v.pieces(text)])


def decode(ids: bytes, path: str) -> str:
    return loaded(path).v.decode(np.frombuffer(ids, "<u4").tolist())


def make_digest(path: str):
    cache = loaded(path)
    pieces = cache.v.pieces

    def one(text: str) -> tuple:
        found = [cache[w] for w in pieces(text)]
        ids = b"".join([x[0] for x in found])
        decoded = " ".join([x[1] for x in found])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    return one


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row per document: its id and ``FIELDS``. One pass, no shuffle; each worker reads the vocabulary file once."""
    path = path or default_path()
    run = text_udf(lambda: make_digest(path), FIELDS)
    return docs.select(F.col(id_col), run(F.col(text)).alias("r")).select(id_col, "r.*")


def tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """All columns, and ``ids`` (binary, little-endian 32-bit) and ``decoded`` in a struct column ``bpe``."""
    path = path or default_path()
    run = text_udf(lambda: (lambda t: (b := encode(t, path), decode(b, path))), "ids binary, decoded string")
    return docs.withColumn("bpe", run(F.col(text)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
