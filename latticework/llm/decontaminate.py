"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z only) and cut into words (runs of digits, a-z and everything beyond ASCII).
The automaton holds every substring of every item. A document's words stream through it; at each word it knows
the longest match that ends there. Where that is ``window`` words or more, the last ``window`` words are an
occurrence of a window; items shorter than the window are one window of their own.

Test items are few, but nothing bounds them: they are taken in blocks of at most ``BLOCK_WORDS`` words. One block is one broadcast automaton and one pass over
the documents without a shuffle. Several are taken one after the other: the driver builds a block's automaton, one pass writes the hits down, the broadcast
is destroyed before the next is made; then the hits of all blocks meet by the digest of the text. So neither the driver nor a worker holds more than one
block, whatever the items have in sum.

Edge cases: a null text has no words; a very long text streams through the automaton whole, in one worker's memory; an item longer than a block is a block of its own; items without words match nothing; equal items are all reported; several rows of
one item id count as one item; null item ids are listed as "null"; null document ids and repeated rows give one row
each; empty tables give no hits or no rows; extra columns are dropped by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, fresh, freed, slices, stored, table, text_udf, tidied, tidy

WINDOW = 10
BLOCK_WORDS = 300_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: For bytes in UTF-8: lower case, and a blank for all that isn't part of a word.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass
class Automaton:
    """Suffix automaton over word numbers; state 0 is the empty string.

    ``full[v]``: items with the window that ends a match in state v (its longest suffix state of ``window`` words);
    ``short[v]``: (words, items) of whole short items that end such a match.
    """

    window: int = WINDOW
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    full: list[tuple | None] = field(default_factory=list)
    short: list[tuple] = field(default_factory=list)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """Append a word to the string that ends in ``last``; other strings may hold it already."""
        step, link, length = self.step, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = self._state(length[p] + 1, dict(step[q]), link[q])
            link[q] = clone
            while p >= 0 and step[p].get(w) == q:
                step[p][w] = clone
                p = link[p]
            return clone

        if (q := step[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        new, p = self._state(length[last] + 1, {}, -1), last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    @staticmethod
    def build(items: list[tuple[str, str]], window: int = WINDOW) -> Automaton:
        """``items``: (id, text)."""
        a = Automaton(window)
        numbered = []
        for name, text in items:
            ids = [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in words_of(text)]
            numbered.append((name, ids))
            last = 0
            for w in ids:
                last = a._extend(last, w)
        ends: dict[int, set[str]] = {}
        wholes: dict[int, dict[int, set[str]]] = {}
        for name, ids in numbered:
            v = n = 0
            for w in ids:
                v, n = a.step[v][w], n + 1
                while n > window or a.length[a.link[v]] >= window:
                    n = window  # a window is all that counts: drop to its state
                    if a.length[a.link[v]] < window:
                        break
                    v = a.link[v]
                if n == window:
                    ends.setdefault(v, set()).add(name)
            if 0 < len(ids) < window:
                wholes.setdefault(v, {}).setdefault(n, set()).add(name)
        order = sorted(range(len(a.length)), key=a.length.__getitem__)
        a.full, a.short = [None] * len(order), [()] * len(order)
        for v in order:
            up = a.link[v]
            if a.length[v] >= window:
                a.full[v] = a.full[up] if a.length[up] >= window else tuple(sorted(ends[v]))
            a.short[v] = (*(a.short[up] if up >= 0 else ()), *((n, tuple(sorted(x))) for n, x in wholes.get(v, {}).items()))
        return a

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Maximal hit runs of words (start, end), the items that occur, and the longest match in words."""
        step, link, length, full, short, window = self.step, self.link, self.length, self.full, self.short, self.window
        runs: list[list[int]] = []
        items: set[str] = set()
        v = n = longest = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                v = n = 0
                continue
            to = step[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = step[v].get(w)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n > longest:
                longest = n
            if n >= window:
                items.update(full[v])
                size = window
            elif short[v]:
                size = 0
            else:
                continue
            for k, names in short[v]:
                if k <= n:
                    items.update(names)
                    size = max(size, k)
            if size:
                start = i + 1 - size
                if runs and start <= runs[-1][1]:
                    runs[-1][0] = min(runs[-1][0], start)
                    runs[-1][1] = i + 1
                    while len(runs) > 1 and runs[-1][0] <= runs[-2][1]:
                        runs[-2:] = [[min(runs[-2][0], runs[-1][0]), runs[-1][1]]]
                else:
                    runs.append([start, i + 1])
        return [(s, e) for s, e in runs], items, longest


def automata(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """One automaton after the other, each for a block of items; a block has at most ``block_words`` words (an item larger than that is
    alone in its block). Items reach the driver one block at a time."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).filter(F.length("text") > 0)
    block, size = [], 0
    for name, body in named.toLocalIterator():
        n = len(words_of(body))
        if block and size + n > block_words:
            yield Automaton.build(block, window)
            block, size = [], 0
        block.append((name, body))
        size += n
    yield Automaton.build(block, window)


def digest_items(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def result(n_words: int, runs: list[tuple[int, int]], items: set[str], longest: int) -> tuple:
    n = sum(e - s for s, e in runs)
    return n_words, n, len(items), digest_items(items), n > 0, longest


def search(built: list[Automaton], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
    """Hits of all blocks together."""
    if len(built) == 1:
        return built[0].hits(words)
    return together([{"runs": [{"s": s, "e": e} for s, e in runs], "items": items, "longest": longest} for runs, items, longest in (a.hits(words) for a in built)])


def make_find(built: list[Automaton]):
    def one(text: str) -> tuple:
        words = words_of(text)
        return result(len(words), *search(built, words))

    return one


def without(text: str, runs: list[tuple[int, int]]) -> str | None:
    """The text without these runs of words; None if nothing is left."""
    at = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for s, e in runs:
        out.append(text[end : at[s][0]])
        end = at[e - 1][1]
    left = "".join([*out, text[end:]])
    return left if left.strip() else None


def covers(runs: list[tuple[int, int]], text: str, coverage: float) -> bool:
    return sum(e - s for s, e in runs) > coverage * len(words_of(text))


def make_clean(built: list[Automaton], coverage: float):
    """The text without its hit spans, or None where hits cover more than ``coverage`` of its words or all is gone."""

    def one(text: str) -> tuple:
        now, first = text, True
        while now is not None:
            runs, _, _ = search(built, words_of(now))
            if not runs:
                return (now,)
            now = None if first and covers(runs, now, coverage) else without(now, runs)  # words beside a removed span may join to a new hit: look again
            first = False
        return (None,)

    return one


FOUND = "array<struct<runs: array<struct<s: bigint, e: bigint>>, items: array<string>, longest: bigint>>"


def hit_rows(get):
    """Input: key, text. Output: key, runs, items, longest match of the texts with any match."""
    runs_kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs, items, longest = get().hits(words_of(text or ""))
                if longest:
                    out.append((key, runs, sorted(items), longest))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), runs_kind, pa.list_(pa.string()), pa.int64()), strict=True)], names=["key", "runs", "items", "longest"])

    return run


def in_passes(texts: DataFrame, built: Iterator[Automaton]) -> DataFrame:
    """``texts``: key (digest of the text), text. ``key``, ``found``: what each block found in a text, an entry for each block with a match."""
    spark = texts.sparkSession
    parts = []
    for a in built:
        sent = spark.sparkContext.broadcast(a)
        hits = texts.mapInArrow(tidied(hit_rows(lambda sent=sent: sent.value)), "key string, runs array<struct<s: bigint, e: bigint>>, items array<string>, longest bigint")
        parts.append(stored(hits.dropDuplicates(["key"]), "hits"))
        sent.destroy()
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    out = stored(rows.groupBy("key").agg(F.collect_list(F.struct("runs", "items", "longest")).alias("found")), "found")
    freed(*parts)
    return out


def together(found: list[dict] | None) -> tuple[list[tuple[int, int]], set[str], int]:
    """Hits of all blocks."""
    found = found or []
    runs = merged([(x["s"], x["e"]) for f in found for x in f["runs"]])
    return runs, {i for f in found for i in f["items"]}, max((f["longest"] for f in found), default=0)


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def pair_udf(one, kind: str):
    """Arrow UDF of a text (null: "") and what the blocks found in it."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = [one(t or "", f) for at in range(0, len(texts), SLICE_ROWS) for t, f in zip(texts.slice(at, SLICE_ROWS).to_pylist(), found.slice(at, SLICE_ROWS).to_pylist(), strict=True)]
        tidy()
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], fields=list(target))

    return run.asNondeterministic()


def one_or_more(built: Iterator[Automaton]) -> tuple[Automaton, Automaton | None]:
    return next(built), next(built, None)


def again(first: Automaton, second: Automaton, rest: Iterator[Automaton]) -> Iterator[Automaton]:
    yield first
    yield second
    yield from rest


def find(
    docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per document: its id and ``FIELDS``. With one block of items one pass over the documents, no shuffle."""
    built = automata(items, item_id, item_text, window, block_words)
    first, second = one_or_more(built)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        run = text_udf(lambda: make_find([sent.value]), FIELDS)
        return docs.select(F.col(id_col), run(F.col(text)).alias("r")).select(id_col, "r.*")
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "key")
    found = in_passes(rows.select("key", F.coalesce("text", F.lit("")).alias("text")), again(first, second, built))
    run = pair_udf(lambda t, f: result(len(words_of(t)), *together(f)), FIELDS)
    out = rows.join(found, "key", "left").select("id", run("text", "found").alias("r"))
    return out.select(F.col("id").alias(id_col), "r.*")


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = 0.5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of the documents: hit spans are cut out of ``text``; documents of which hits cover more than
    ``coverage``, or of which nothing is left, go. Documents without hits, null and empty texts among them, stay untouched."""
    blocks = lambda: automata(items, item_id, item_text, window, block_words)
    first, second = one_or_more(blocks())
    made = fresh(docs, "clean")
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        run = text_udf(lambda: make_clean([sent.value], coverage), "text string")
        out = docs.withColumn(made, run(F.col(text))).filter(F.col(f"{made}.text").isNotNull())
        return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col(f"{made}.text"))).drop(made)
    del first, second
    # round by round over the texts that still change: words beside a removed span may join to a new hit
    bare = keyed(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), "text", "key")
    done, now, most = [], bare, coverage
    while True:
        found = in_passes(now.select("key", "text"), blocks()).filter(F.exists("found", lambda f: F.size(f["runs"]) > 0))
        cut = pair_udf(lambda t, f, most=most: (None if covers(together(f)[0], t, most) else without(t, together(f)[0]),), "text string")
        hit = now.join(found, "key").dropDuplicates(["key"])
        changed = stored(hit.select("key", cut("text", "found").alias("r")).select("key", "r.text"), "changed")
        if not changed.limit(1).count():
            break
        done.append(changed)
        now, most = changed.filter("text is not null"), 1.0
    rows = docs
    if done:  # a later round's text of a key stands for an earlier one's
        ranked = done[0].withColumn("n", F.lit(0))
        for i, d in enumerate(done[1:], 1):
            ranked = ranked.unionAll(d.withColumn("n", F.lit(i)))
        last = ranked.groupBy("key").agg(F.max_by(F.struct("text"), "n").alias(made))
        key = fresh(docs, "key")
        rows = keyed(docs, text, key).join(last.withColumnRenamed("key", key), key, "left")
        rows = rows.filter(F.col(made).isNull() | F.col(f"{made}.text").isNotNull())
        rows = rows.withColumn(text, F.when(F.col(made).isNotNull(), F.col(f"{made}.text")).otherwise(F.col(text))).select(*docs.columns)
    return rows


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select distinct coalesce(item_id::varchar, 'null') as item, {_WORDS} as w from benchmark),
iw as (select item, {WINDOW} as k, array_to_string(w[p:p + {WINDOW - 1}], ' ') as key from (select item, w, unnest(range(1, len(w) - {WINDOW - 2})) as p from i where len(w) >= {WINDOW})
  union select item, len(w), array_to_string(w, ' ') from i where len(w) between 1 and {WINDOW - 1}),
dw as (select r, k, p, array_to_string(w[p:p + k - 1], ' ') as key from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from iw) where len(w) >= k)),
h as (select r, p, k, item from dw join iw using (k, key)),
n as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from (select distinct r, p, k from h)) group by r),
s as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join s using (r)
"""
