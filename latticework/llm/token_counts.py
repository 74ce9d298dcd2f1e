r"""Token counts with a digest cache.

The cache is a Parquet table (``tokenizer``, ``digest``, ``n_tokens``) in a folder of the caller's, a partition for each tokenizer. ``tokenizer`` is the digest of all that decides a count: the
vocabulary file's bytes, the library and its version, and the version of our normalisation. ``digest`` is the SHA-256 of the normalised text. Texts are joined to the cache by both;
the distinct texts that it misses are encoded once and appended, then every document takes its count from the cache.

Normalisation only drops what can't change a count. For a vocabulary that drops white space and lower-cases (``word_bpe_49k.json``) runs of ASCII white space become one space, ends are trimmed, and texts
of ASCII characters that hold no special string in any case are lower-cased; other texts keep their case, because lower-casing before composition could change what is composed. For other vocabularies the text stays.

Shuffles: ids and digests, and the text of each distinct miss once for each task that reads it (copies meet within a task first, so a group of copies of any size never travels whole). When
few digests are missed (``FEW``, a proven bound of 32-byte keys) the missed ones are broadcast, so that a warm cache moves no text but those.

Counting: texts are cut into the words of the vocabulary's own rules; a word's count comes from a bounded memo, words that miss it are encoded together by the library. Files of other kinds go to their
library whole (``tokenizers`` for .json, ``sentencepiece`` for .model).

Edge cases: a null text counts as empty, and an empty one has no tokens; special strings within texts are special tokens, the library's default; repeated rows and null ids give one row each; two
writers may both append a digest, which is read as one row; an empty table gives an empty result and leaves the cache as it is; extra columns are dropped; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RARE, Vocabulary, default_path, loaded
from .common import scratch, slices, stored, table, tidy

LIMIT = 2048
NORMALISATION = "1"
KIND = "tokenizer string, digest binary, n_tokens long"
#: Missed digests up to here are broadcast (32 bytes each).
FEW = 200_000
#: Words whose counts a worker remembers, in two generations; longer words than ``LONGEST`` aren't kept.
MEMO_WORDS, LONGEST = 300_000, 64


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary | None:
    """The vocabulary, if its words can be counted one by one: white space dropped, a mark at the end of each word."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return loaded(path).v if spec["model"].get("end_of_word_suffix") and cutters[0].get("behavior") == "Removed" else None


def tokenizer_digest(path: str) -> str:
    """What the counts depend on, as one digest."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {version(library)} normalisation {NORMALISATION}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def normalised(text: Column, path: str) -> Column:
    """Texts with equal results have equal counts."""
    text = F.coalesce(text, F.lit(""))
    v = vocabulary(path)
    if v is None:
        return text
    squeezed = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    plain = ~squeezed.rlike(r"[^\x00-\x7F]")
    for special in v.special:
        plain = plain & ~F.contains(F.lower(squeezed), F.lit(special.lower()))
    return F.when(plain, F.lower(squeezed)).otherwise(squeezed)


class WordCounts:
    """Tokens of texts by the counts of their words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.ends = np.zeros(max(v.tokens) + 1, bool)
        self.ends[[i for i, t in v.tokens.items() if t.endswith(v.end) or t in v.special]] = True
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of words: those whose form the library would keep are encoded in one run and told apart by the end marks, others by the segment tree."""
        found, plain = {}, []
        for w in words:
            if w in self.v.special:
                found[w] = 1
            elif w.isascii() or not (RARE.search(w) or any(0x300 <= ord(c) <= 0x36F for c in w)):
                plain.append(w)
            else:
                found[w] = len(self.v.encode_word(w))
        if plain:
            ids = np.array(self.v.library.encode(" ".join(plain), add_special_tokens=False).ids)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(plain):
                found.update(zip(plain, np.diff(at, prepend=-1).tolist(), strict=True))
            else:
                found.update((w, len(self.v.encode_word(w))) for w in plain)
        return found

    def __call__(self, texts: list[str]) -> list[int]:
        words = [self.v.pieces(t) for t in texts]
        memo, old, fresh = self.memo, self.old, {}
        for w in {w for ws in words for w in ws if w not in memo}:
            if w in old:
                memo[w] = old[w]
            else:
                fresh[w] = 0
        fresh = self.learn(list(fresh))
        memo.update(fresh)
        counts = [sum(map(memo.__getitem__, ws)) for ws in words]
        for w in fresh:
            if len(w) > LONGEST:
                del memo[w]
        if len(memo) > MEMO_WORDS:
            self.old, self.memo = memo, {}
        return counts


class WholeCounts:
    """Tokens of texts by their library."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.run = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.run = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        return self.run(texts) if texts else []


@lru_cache(2)
def counter(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    v = vocabulary(path)
    return WholeCounts(path) if v is None else WordCounts(v)


def count_udf(path: str):
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        count, out = counter(path), []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 200):
            out += count(["" if t is None else t for t in part.column(0).to_pylist()])
        tidy()
        return pa.array(out, pa.int64())

    return run.asNondeterministic()


def read(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``digest``, ``n_tokens`` of one tokenizer; an absent cache is an empty one."""
    spark.createDataFrame([], KIND).write.mode("append").partitionBy("tokenizer").parquet(cache)
    rows = spark.read.schema(KIND).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counts(docs: DataFrame, cache: str, path: str | None = None, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT, few: int = FEW) -> DataFrame:
    """A row per document: its id, ``n_bytes``, ``n_tokens``, ``over_limit``. The cache grows by the distinct texts it missed, which the call encodes at once."""
    spark, path = docs.sparkSession, path or default_path()
    tokenizer = tokenizer_digest(path)
    given = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(normalised(F.col(text), path), 256))
    keyed = stored(docs.select(F.col(id_col).alias("id"), F.octet_length(given).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    wanted = keyed.select("digest").distinct()
    missed = stored(wanted.join(read(spark, cache, tokenizer), "digest", "left_anti"), "missed")
    n = missed.count()
    if n:
        texts = docs.select(digest.alias("digest"), given.alias("text"))
        if n <= few:
            texts = texts.join(F.broadcast(missed), "digest", "left_semi")
        once = texts.groupBy("digest").agg(F.min("text").alias("text"))
        if n > few:
            once = once.join(missed, "digest", "left_semi")
        fresh = once.select(F.lit(tokenizer).alias("tokenizer"), "digest", count_udf(path)(F.col("text")).alias("n_tokens"))
        fresh.write.mode("append").option("compression", "zstd").partitionBy("tokenizer").parquet(cache)
    # a table of its own, so that adaptive execution can split the join at the digest of a large group
    held = stored(wanted.join(read(spark, cache, tokenizer), "digest"), "counts")
    found = keyed.join(held, "digest")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted through a cache that starts empty."""
    return counts(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"))
