r"""Periodic runs of words, by a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words that its smallest period q fits, of max(6, 4 q) words or more, and that no neighbouring word extends. Each text gets the suffix automaton of its words. The sets of end positions
are merged along the suffix links, the smaller into the larger, in order of decreasing state length. Two positions that become neighbours in a state have that state's length as their longest common suffix;
so if their distance d isn't more than that length, they seed a square of period d whose left end is exact. A run's word of length n - q ends at two positions at distance q that nothing lies between, so each run is seeded.
Seeds of one run share (d, left end) and are extended to the right once; what is long enough and whose first d words aren't a power is a run. Sets are sorted in blocks, so an insertion costs the
logarithm and a block, in a text of one repeated word too.

First, without loss: the words of a run occur four times in it at least. So a word that is rarer ends every run, and stretches between such words get automata of their own (the test is repeated
within a stretch). Memory of a task is one stretch's automaton, some 700 bytes a word.

Edge cases: a null or empty text, or one without words, has no runs and collapses to ""; a text of any length is taken whole; a run of each period counts, runs may overlap; of runs of equal length the first, then the one of
smaller period is the longest; repeated rows, null ids and extra columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, text_udf

LEAST_WORDS, LEAST_PERIODS = 6, 4
BLOCK = 512
FIELDS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Ends:
    """A sorted set of end positions, in blocks."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert a position that isn't there yet; its neighbours."""
        at = bisect_right(self.heads, x) - 1
        if at < 0:
            block = self.blocks[0]
            block.insert(0, x)
            self.heads[0] = x
            at, before, after = 0, None, block[1]
        else:
            block = self.blocks[at]
            i = bisect_left(block, x)
            before = block[i - 1]
            after = block[i] if i < len(block) else self.heads[at + 1] if at + 1 < len(self.heads) else None
            insort(block, x, i)
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads.insert(at + 1, block[BLOCK])
        return before, after


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: for each state its greatest length, its suffix link, and the end position of the prefix that it was made for (-1 for copies and the root)."""
    length, link, end, out = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        cur = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        out.append({})
        p = last
        while p >= 0 and w not in out[p]:
            out[p][w] = cur
            p = link[p]
        if p >= 0:
            q = out[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                out.append(out[q].copy())
                while p >= 0 and out[p].get(w) == q:
                    out[p][w] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return length, link, end


def seeds(words: list) -> dict[tuple[int, int], int]:
    """(period, left end) of every square that neighbours seed, with the furthest end position known."""
    length, link, end = automaton(words)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        p = link[v]
        if p == 0:
            sets[v] = None
            continue
        small, large, sets[v] = sets[v], sets[p], None
        if large is None:
            sets[p] = small
            continue
        if small.size > large.size:
            small, large = large, small
        n, mine = length[p], None
        for x in small:
            before, after = large.add(x)
            # neighbours from the same set have a longer suffix in common, and were neighbours there
            if before is not None and before != mine and x - before <= n:
                key = (x - before, before - n + 1)
                if found.get(key, -1) < x:
                    found[key] = x
            if after is not None and after - x <= n:
                key = (after - x, x - n + 1)
                if found.get(key, -1) < after:
                    found[key] = after
            mine = x
        sets[p] = large
    return found


def primitive(words: list) -> bool:
    """Whether the words are no power of a shorter sequence."""
    fail, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k - 1]
        if words[i] == words[k]:
            k += 1
        fail[i] = k
    q = len(words) - (fail[-1] if words else 0)
    return q == len(words) or len(words) % q != 0


def stretches(words: list, start: int = 0) -> list[tuple[int, list]]:
    """(start, words) of the stretches in which every word occurs often enough for a run."""
    todo, done = [(start, words)], []
    while todo:
        at, ws = todo.pop()
        if len(ws) < LEAST_WORDS:
            continue
        rare = {w for w, n in Counter(ws).items() if n < LEAST_PERIODS}
        if not rare:
            done.append((at, ws))
            continue
        cuts = [-1, *(i for i, w in enumerate(ws) if w in rare), len(ws)]
        todo += [(at + a + 1, ws[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > LEAST_WORDS]
    return done


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, sorted by start, then period."""
    runs = []
    for at, ws in stretches(words):
        n = len(ws)
        for (q, start), e in seeds(ws).items():
            e += 1
            while e < n and ws[e] == ws[e - q]:
                e += 1
            if e - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and primitive(ws[start : start + q]):
                runs.append((at + start, e - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def dropped(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of words to drop, in order and apart: each run's words after its first period."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def analysed(text: str) -> tuple:
    words = text.encode().split()  # of bytes: cut at ASCII white space only
    runs = runs_of(words)
    for a, b in reversed(dropped(runs)):
        del words[a:b]
    return [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(words).decode()


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """All columns, and in a struct ``into`` the runs of each text and the text with each run cut to its first period (words joined by one space). One pass, no shuffle."""
    run = text_udf(lambda: analysed, FIELDS)
    return docs.withColumn(into, run(F.col(text)))


def planted(text: Column, h: Column) -> Column:
    """The query's test case: in texts whose ``h`` ends in 0 the words from some place on repeat with some period."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a)
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", planted(F.coalesce("text", F.lit("")), h).alias("text"))
    name = fresh(rows, "runs")
    found = periodic_runs(rows, into=name).select("doc_id", F.col(f"{name}.runs").alias("runs"), F.col(f"{name}.collapsed").alias("collapsed"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = found.withColumns({"best": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / (-F.col("best.period"))).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
