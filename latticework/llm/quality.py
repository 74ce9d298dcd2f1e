"""Quality rules: compression bands over whole documents and fixed chunks.

Every text is split on ASCII white space; six counts describe it, two base rules reject it, and zstandard
ratios decide the rest. A ratio is compressed bytes over bytes. A document is kept if

* the base rules hold (50 words or more; at most half of its words in repeated 3-word windows),
* the ratio of the whole text lies in the band of its length, and
* of its fixed chunks at most a share of ``Bands.bad_chunks`` lies below the chunk band, and at most that share above it. Where the last
  chunk isn't whole, the last ``Bands.chunk_bytes`` bytes of the text are judged in its place, so closing bytes count too; a text of one
  chunk or less is its own chunk, judged by the band of its length.

A ratio below its band means repetition or poor wording, above it text that doesn't compress (encoded or random bytes). How well good text
compresses depends on its length and on the corpus, so ``Bands.fit`` learns the limits from labelled rows: a curve of the ratio over
the length, and quantiles of what good texts of like length deviate from it (``TAILS`` at either end, and ``MARGIN``). All good
rows that aren't held out have a say, whole texts, measured on the workers; sums and counts by steps reach the driver. Without
``LEAST_FIT`` labelled rows the wide default limits hold.

Edge cases: a null text counts as empty, has no words and is rejected by the base rules; a very long text is measured whole, in one
worker's memory; limits beyond the longest text of the sample follow the curve and widen with each doubling; null ids, repeated
rows and ties pass through one row each; an empty table gives an empty result; extra columns are dropped by
``measure`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, fresh, stored, table, text_udf
from .labels import known

#: The fewest labelled good rows that will do, and rows around a length that tell its quantiles (a tenth of all if that is more).
LEAST_FIT, NEAREST = 200, 400
#: Cells of a doubling of the length, and steps of ratios and deviations, by which rows are counted.
CELLS, STEP = 8, 0.001
#: Share of good texts beyond the quantile at either end, room left beyond it, and more room for each doubling beyond the sample's lengths (shares of the ratio).
TAILS, MARGIN, WIDER = 0.001, 0.01, 0.05


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes, least ratio, most ratio) at some lengths, sorted; in between both limits run linearly over the logarithm of the length."""

    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.00, 9.00),
        (128, 0.40, 1.15),
        (256, 0.36, 0.95),
        (512, 0.34, 0.85),
        (1024, 0.31, 0.80),
        (2048, 0.28, 0.75),
        (8192, 0.25, 0.72),
        (32768, 0.22, 0.70),
    )
    chunk_bytes: int = 2048
    chunk_limits: tuple[float, float] = (0.30, 0.72)
    bad_chunks: float = 0.3
    level: int = 3

    def band(self, size: int) -> tuple[float, float]:
        x, low, high = np.array(self.limits).T
        at = np.log2(max(1, size))
        return float(np.interp(at, np.log2(x), low)), float(np.interp(at, np.log2(x), high))

    @staticmethod
    def fit(sample: list[tuple[int, float, float, float]], **settings) -> Bands:
        """``sample``: size, ratio, and the chunk ratios that must not lie below and above the band (0 where a text has no two chunks), of good texts."""
        rows = np.array([r for r in sample if r[0] >= 64], float).reshape(-1, 4)
        if len(rows) < LEAST_FIT:
            return Bands(**settings)
        x, y = np.log2(rows[:, 0]), np.log(rows[:, 1])
        terms = np.stack([np.ones_like(x), 1 / x, 1 / x**2], 1)
        w = np.linalg.lstsq(terms, y, rcond=None)[0]
        counted = lambda *columns: [(*map(int, k), int(n)) for k, n in zip(*np.unique(np.stack([np.floor(c) for c in columns], 1), axis=0, return_counts=True), strict=True)]
        chunked = rows[rows[:, 3] > 0]
        low, high = (counted(chunked[:, c] / STEP) if len(chunked) else [] for c in (2, 3))
        return Bands.learnt(w, (x.min(), x.max()), counted(x * CELLS, (y - terms @ w) / STEP), low, high, **settings)

    @staticmethod
    def learnt(w, sizes: tuple[float, float], rest: list[tuple[int, int, int]], low: list[tuple[int, int]], high: list[tuple[int, int]], **settings) -> Bands:
        """``w``: the curve; ``sizes``: least and most binary logarithm of a length; ``rest``: cell of the length, step of the deviation, how many texts; ``low``, ``high``: step of the chunk ratio, how many texts."""
        least, most = sizes
        cell, step, n = np.array(rest).T
        limits = []
        for k in range(6, 31):
            # whole cells around the length, the nearest first, until they hold enough texts
            away = np.abs((cell + 0.5) / CELLS - k)
            far = np.sort(away)[np.searchsorted(np.cumsum(n[np.argsort(away, kind="stable")]), min(n.sum(), max(NEAREST, n.sum() // 10)))]
            near = away <= far
            # the ratio falls with the length: beyond the texts' lengths each limit follows the curve or stays, whichever is wider
            curve_low, curve_high = (w[0] + w[1] / v + w[2] / v**2 for v in (max(k, least), min(k, most)))
            slack = MARGIN + WIDER * max(0.0, k - most, least - k)
            tails = outer(step[near], n[near])
            limits.append((float(2**k), float(np.exp(curve_low + tails[0] - slack)), float(np.exp(curve_high + tails[1] + slack))))
        if sum(m for _, m in low) >= LEAST_FIT:
            settings["chunk_limits"] = (outer(*np.array(low).T)[0] * (1 - MARGIN), outer(*np.array(high).T)[1] * (1 + MARGIN))
        return Bands(tuple(limits), **settings)


def outer(step: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The quantiles of ``TAILS`` at both ends of values counted by steps, outwards to the edge of a step."""
    order = np.argsort(step, kind="stable")
    step, upto = step[order], np.cumsum(n[order])
    last = int(upto[-1]) - 1
    at = lambda i: int(step[np.searchsorted(upto, i, side="right")])
    return at(int(TAILS * last)) * STEP, (at(last - int(TAILS * last)) + 1) * STEP


SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that is found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(" \t\n\r\v\f"))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at exactly the ASCII white space
    spaces = sum(map(text.count, " \t\n\r\v\f"))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words)


def chunk_starts(size: int, step: int) -> list[int]:
    """Where the chunks of a text begin; none for a text of one chunk or less."""
    return [min(at, size - step) for at in range(0, size, step)] if size > step else []


def ratios(bands: Bands):
    """A function from a text to its size, its ratio and those of its chunks."""
    size_of = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress

    def run(text: str) -> tuple[int, float, list[float]]:
        data, step = text.encode("utf-8", "surrogatepass"), bands.chunk_bytes
        return len(data), len(size_of(data)) / len(data) if data else 0.0, [len(size_of(data[at : at + step])) / step for at in chunk_starts(len(data), step)]

    return run


def base_fails(n_words: int, repeats: int) -> bool:
    return n_words < MIN_WORDS or 100 * repeats > 50 * n_words


def make_rule(bands: Bands = Bands()):
    """A function from a text to its row of ``FIELDS``."""
    measured = ratios(bands)

    def rule(text: str) -> tuple:
        n_words, chars, symbols, dup_lines, repeats = base_counts(text)
        failed = base_fails(n_words, repeats)
        size, ratio, chunks = measured(text)
        low, high = bands.band(size)
        below, above = sum(r < bands.chunk_limits[0] for r in chunks), sum(r > bands.chunk_limits[1] for r in chunks)
        kept = not failed and low <= ratio <= high and max(below, above) <= bands.bad_chunks * len(chunks)
        return n_words, chars, symbols, dup_lines, repeats, failed, kept, ratio, len(chunks), below + above

    return rule


def make_sample_row(bands: Bands):
    """A function from a text to its row of ``Bands.fit``; size 0 if the base rules reject it."""
    measured = ratios(bands)

    def row(text: str) -> tuple:
        n_words, *_, repeats = base_counts(text)
        if base_fails(n_words, repeats):
            return 0, 0.0, 0.0, 0.0
        size, ratio, chunks = measured(text)
        at = int(bands.bad_chunks * len(chunks))  # so many may lie outside
        chunks.sort()
        return size, ratio, *((chunks[at], chunks[-1 - at]) if chunks else (0.0, 0.0))

    return row


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> Bands:
    """Bands learnt from all documents labelled good. Each document is measured where it lies, so that the join with the labels moves no text; the driver gets sums and counts by steps, as many rows at most as there are steps."""
    run = text_udf(lambda: make_sample_row(Bands()), "size long, ratio double, low double, high double")
    measured = docs.select(F.col(id_col).alias("id"), run(F.col(text)).alias("r")).filter("id is not null and r.size >= 64")
    good = known(labels, id_col, label).filter("y = 1").select("id").hint("merge")
    rows = measured.join(good, "id").groupBy("id").agg(F.min("r").alias("r")).select("r.*")
    rows = stored(rows.withColumns({"x": F.log2("size"), "y": F.log("ratio")}), "ratios")
    # sums of decimals don't depend on the order of rows
    sums = [F.sum(c.cast("decimal(38,15)")) for c in [F.lit(1) / F.col("x") ** i for i in range(5)] + [F.col("y") / F.col("x") ** i for i in range(3)]]
    total, least, most, *s = rows.agg(F.count("*"), F.min("x"), F.max("x"), *sums).first()
    if total < LEAST_FIT:
        freed(rows)
        return Bands()
    p = np.array(s, float)
    w = np.linalg.lstsq(np.array([p[i : i + 3] for i in range(3)]), p[5:], rcond=None)[0].tolist()
    rest = F.col("y") - (F.lit(w[0]) + F.lit(w[1]) / F.col("x") + F.lit(w[2]) / F.col("x") ** 2)
    counted = lambda some, *columns: sorted(map(tuple, some.groupBy(*(F.floor(c).alias(f"c{i}") for i, c in enumerate(columns))).count().collect()))
    chunked = rows.filter("high > 0")
    bands = Bands.learnt(w, (least, most), counted(rows, F.col("x") * CELLS, rest / STEP), *(counted(chunked, F.col(c) / STEP) for c in ("low", "high")))
    freed(rows)
    return bands


def measure(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bands: Bands = Bands()) -> DataFrame:
    """A row per document: its id and ``FIELDS``. No shuffle; one pass over the texts."""
    run = text_udf(lambda: make_rule(bands), FIELDS)
    return docs.select(F.col(id_col), run(F.col(text)).alias("r")).select(id_col, "r.*")


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    verdict = fresh(docs, "kept")
    run = text_udf(lambda: (lambda t, rule=make_rule(bands): (rule(t)[6],)), "kept boolean")
    return docs.withColumn(verdict, run(F.col(text))).filter(F.col(f"{verdict}.kept")).drop(verdict)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return measure(docs, bands=fitted(docs, table(spark, sf_dir, "labels")))
