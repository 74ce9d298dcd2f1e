"""A vector index: trained cells, residual codes, exact scores for what is left.

A coarse quantiser (k-means over directions) is trained on a bounded sample; every vector is indexed. A row lies in the folder of its cell with the difference from the cell's centre as one byte a dimension, the scale of
these bytes and the length of what they lose. So a code gives the cosine within a proven error, and a cell's least closeness to its centre bounds what a query can find in it. A search reads the codes of the nearest cells, then the vectors
of the best candidates. Codes of a cell meet the queries that ask for it in tasks of bounded size, by products of matrices; a task gives only rows that can be among a query's k. Its exact way takes the k-th score found so as a bar: cells whose bound is below it are not read, rows whose code and error are below it are not scored, all others are; so it gives what a full scan gives.

New vectors are appended with the same centres; nothing is built again. Centres and bounds of cells are small tables (cells x dimensions numbers), the only thing that is broadcast beside candidates, whose number is checked.

Edge cases: null, empty and zero vectors, and those of another length than the sample's, lie in a cell of their own, which every search reads; their score is 0 (for other lengths, what the full scan gives). Fewer than k rows: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine
from ..storage import stored

SAMPLE, ROUNDS, SEED = 20_000, 15, 1
K, PROBES, RERANK = 10, 8, 10
#: Candidates that are broadcast; more are shuffled.
FEW = 200_000
#: Rows and queries of a cell that meet in a task, about, and how many of the queries are multiplied at once.
ROWS_MOST, ASKS_MOST, ASKS_STEP = 25_000, 4_000, 64
#: Scores are rounded to 6 places.
SLACK = 2e-6
ODD = -1
ROW = "node_type string, node_slug string, embedding array<float>, code array<tinyint>, scale double, lost double, close double, cell int, same long"
_ROW = pa.schema([("node_type", pa.string()), ("node_slug", pa.string()), ("embedding", pa.list_(pa.float32())), ("code", pa.list_(pa.int8())), ("scale", pa.float64()), ("lost", pa.float64()), ("close", pa.float64()), ("cell", pa.int32()), ("same", pa.int64())])


def directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def centres_of(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the cells, from the ``sample`` vectors of least hash."""
    some = vectors.filter("size(embedding) > 0").orderBy(F.xxhash64("node_type", "node_slug"), "node_slug").select("embedding").limit(sample).collect()
    lengths = [len(r[0]) for r in some]
    dims = max(set(lengths), key=lengths.count) if lengths else 1
    x = np.array([r[0] for r in some if len(r[0]) == dims], float).reshape(-1, dims)
    x = directions(x[np.linalg.norm(x, axis=1) > 0])
    draw = np.random.default_rng(SEED)
    c = x[draw.permutation(len(x))[:cells]] if len(x) else np.eye(1, dims)
    for _ in range(ROUNDS):
        mine = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, mine, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c[full] = directions(sums[full])
    return c


def matrix_of(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists with ``dims`` numbers, no null and some length, and their numbers."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == dims)
    flat = lists.take(pa.array(whole)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(whole), dims)
    if flat.null_count:
        nulls = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(whole), dims).any(1)
        whole, x = whole[~nulls], x[~nulls]
    some = (x != 0).any(1)
    return whole[some], x[some]


def coded(centres: np.ndarray):
    """Rows (node_type, node_slug, embedding, same) with their cells and codes."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            good, x = matrix_of(batch.column("embedding"), dims)
            facts = {c: np.zeros(n) for c in ("scale", "lost", "close")}
            cell, size, codes = np.full(n, ODD, np.int32), np.zeros(n, np.int64), np.zeros(0, np.int8)
            if len(good):
                x = directions(x)
                near = x @ centres.T
                cell[good] = near.argmax(1)
                rest = x - centres[cell[good]]
                scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                facts["scale"][good] = scale
                facts["lost"][good] = np.linalg.norm(rest - code * scale[:, None], axis=1)
                facts["close"][good] = near.max(1)
                size[good] = dims
                codes = code.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(codes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node_type", "node_slug", "embedding")), lists, *map(pa.array, facts.values()), pa.array(cell), batch.column("same")], schema=_ROW)

    return run


@dataclass
class Index:
    spark: SparkSession
    root: str
    centres: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.root}/rows")

    def cells(self) -> dict[int, tuple[int, float]]:
        """Rows and least closeness of each cell."""
        found = self.spark.read.parquet(f"{self.root}/cells").groupBy("cell").agg(F.sum("n"), F.min("close")).collect()
        return {r[0]: (r[1], r[2]) for r in found}

    def insert(self, vectors: DataFrame) -> None:
        """Append rows (node_type, node_slug, embedding). Bounds are written first: too wide ones do no harm."""
        rows = stored(vectors.select("node_type", "node_slug", F.col("embedding").cast("array<float>").alias("embedding")).withColumn("same", F.xxhash64("embedding")).mapInArrow(coded(self.centres), ROW), "coded")
        rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("close").alias("close")).write.mode("append").parquet(f"{self.root}/cells")
        rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.root}/rows")


def built(vectors: DataFrame, root: str, cells: int, sample: int = SAMPLE) -> Index:
    """A new index of all rows."""
    spark = vectors.sparkSession
    centres = centres_of(vectors, cells, sample)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{root}/centres")
    index = Index(spark, root, centres)
    index.insert(vectors)
    return index


def opened(spark: SparkSession, root: str) -> Index:
    rows = spark.read.parquet(f"{root}/centres").orderBy("cell").collect()
    return Index(spark, root, np.array([r.centre for r in rows]))


PLAN = "qid string, cell int, bound double, place int"


def planned(index: Index, queries: DataFrame) -> DataFrame:
    """A row for each query and cell that has rows: bound of a score in it, place in the order of closeness."""
    cells, centres = index.cells(), index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([c for c in cells if c != ODD], np.int32)
        close = np.array([cells[c][1] for c in ids.tolist()])
        for batch in batches:
            n, m = batch.num_rows, len(ids)
            good, q = matrix_of(batch.column("q"), centres.shape[1])
            base, bound = np.zeros((n, m)), np.ones((n, m))
            base[good] = directions(q) @ centres[ids].T
            # the angle to a row is at least that to the centre less the widest one in the cell
            angle = np.arccos(np.clip(base[good], -1, 1)) - np.arccos(np.clip(close, -1, 1))
            bound[good] = np.cos(np.maximum(angle, 0))
            order = np.argsort(-base, axis=1, kind="stable")
            parts = [(np.repeat(np.arange(n), m), ids[order].ravel(), np.take_along_axis(bound, order, 1).ravel(), np.tile(np.arange(m), n))]
            if ODD in cells:
                parts.append((np.arange(n), np.full(n, ODD), np.ones(n), np.full(n, -1)))
            at, cell, high, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at)), pa.array(cell, pa.int32()), pa.array(high), pa.array(place, pa.int32())], names=["qid", "cell", "bound", "place"])

    return queries.select("qid", F.col("q").cast("array<double>").alias("q")).mapInArrow(run, PLAN)


FOUND = "qid string, cell int, node_type string, node_slug string, guess double, lost double"


def meeting(centres: np.ndarray, k: int, first: int, exact: bool):
    """Rows of a cell (with codes) and queries that ask for it (with ``bars``, scores that k rows of a type reach): for each query and type the rows that can be among its k nearest. A query without direction gives all
    ordinary rows one score, so the first k by name; of equal vectors (by a hash of 64 bits) only the first k by name count; rows of the odd cell have no codes: ``exact`` gives all that may count, else the ``first`` by name."""
    dims = centres.shape[1]

    def run(key: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        rows, asks = rows.combine_chunks(), asks.combine_chunks()
        kinds, names = rows.column("node_type").to_pylist(), rows.column("node_slug").to_pylist()
        by: dict[str, list[int]] = {}
        for i in sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or "")):
            by.setdefault(kinds[i], []).append(i)
        bars = [{b["node_type"]: b["bar"] for b in x or ()} for x in asks.column("bars").to_pylist()]
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        good, q = matrix_of(one(asks.column("q")), dims)
        plain = np.setdiff1d(np.arange(len(bars)), good)
        lost, same = (rows.column(c).to_numpy() for c in ("lost", "same"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def all_of(queries: list[int], some: list[int]) -> None:
            found.append((np.repeat(np.array(queries, np.int64), len(some)), np.tile(np.array(some, np.int64), len(queries)), np.zeros(len(queries) * len(some))))

        if cell != ODD and len(good):
            q = directions(q)
            code = one(rows.column("code")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            near = centres[cell] + code * rows.column("scale").to_numpy()[:, None]
        for kind, places in by.items():
            if cell == ODD:
                fit = set(good.tolist())
                needs = [i for i, b in enumerate(bars) if not (exact and i in fit and b.get(kind) is not None and b[kind] > SLACK)]
                all_of(needs, places if exact else places[:first])
                continue
            all_of(plain.tolist(), places[:k])
            if not len(good):
                continue
            at = np.array(places)
            order = np.argsort(same[at], kind="stable")
            start = np.append(True, np.diff(same[at][order]) != 0)
            at = at[np.sort(order[np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1] < k])]
            x, off = near[at], lost[at]
            bar = np.array([bars[i].get(kind) if bars[i].get(kind) is not None else np.nan for i in good.tolist()], float)
            for a in range(0, len(good), ASKS_STEP):
                guess = q[a : a + ASKS_STEP] @ x.T
                least = bar[a : a + ASKS_STEP].copy()
                none = np.isnan(least)
                if none.any():
                    least[none] = np.partition(guess[none] - off, len(at) - k, axis=1)[:, len(at) - k] if len(at) >= k else -np.inf
                i, j = np.nonzero(guess + off >= least[:, None] - SLACK)
                found.append((good[a + i], at[j], guess[i, j]))
        i, j, guess = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        i, j = i.astype(np.int64), j.astype(np.int64)
        return pa.table(
            [asks.column("qid").take(pa.array(i)), pa.array(np.full(len(i), cell), pa.int32()), rows.column("node_type").take(pa.array(j)), rows.column("node_slug").take(pa.array(j)), pa.array(guess), pa.array(lost[j])],
            names=["qid", "cell", "node_type", "node_slug", "guess", "lost"],
        )

    return run


def best(rows: DataFrame, k: int, score: str) -> DataFrame:
    w = Window.partitionBy("qid", "node_type").orderBy(F.desc(score), "node_slug")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def search(index: Index, queries: DataFrame, k: int = K, probes: int = PROBES, rerank: int = RERANK, exact: bool = False, few: int = FEW) -> DataFrame:
    """``queries``: qid, q. For each the k nearest of each node type (qid, node_type, node_slug, score), ranked together by score (rank). ``probes`` cells are read, and up to ``rerank`` times k rows of each type scored by
    their vectors, of those that can be among the k; ``exact`` reads and scores beyond that what could be among the k."""
    asked = queries.select(F.col("qid").cast("string").alias("qid"), "q")
    plan = stored(planned(index, asked), "plan")
    sizes = index.cells()

    def candidates(cells: DataFrame, exact: bool) -> DataFrame:
        """``cells``: qid, cell, bars."""
        counts = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}  # a row for each cell
        steps = [(c, -(-sizes[c][0] // ROWS_MOST), -(-n // ASKS_MOST)) for c, n in counts.items()]
        steps = F.broadcast(plan.sparkSession.createDataFrame(steps, "cell int, parts int, lots int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = index.rows.filter(F.col("cell").isin(list(counts))).select("node_type", "node_slug", "cell", "code", "scale", "lost", "same").join(steps, "cell")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node_type", "node_slug"), "parts").cast("int")).withColumn("lot", each("lots")).drop("parts", "lots")
        asks = cells.join(asked.select("qid", F.col("q").cast("array<double>").alias("q")), "qid").join(steps, "cell")
        asks = asks.withColumn("lot", F.pmod(F.xxhash64("qid"), "lots").cast("int")).withColumn("part", each("parts")).drop("parts", "lots")
        key = ["cell", "part", "lot"]
        return rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(meeting(index.centres, k, rerank * k, exact), FOUND)

    def scored(rows: DataFrame) -> DataFrame:
        rows = stored(rows.select("qid", "cell", "node_type", "node_slug"), "candidates")
        full = index.rows.select("cell", "node_type", "node_slug", "embedding")
        found = full.join(F.broadcast(rows) if rows.count() <= few else rows, ["cell", "node_type", "node_slug"]).join(asked.withColumnRenamed("q", "asked"), "qid")
        return found.select("qid", "node_type", "node_slug", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))

    kind = "array<struct<node_type:string,bar:double>>"
    near = candidates(plan.filter(F.col("place") < probes).select("qid", "cell", F.lit(None).cast(kind).alias("bars")), False)
    # over all cells of a query again: rows that k others surely exceed aren't scored
    sure = F.when(F.col("cell") != ODD, F.col("guess") - F.col("lost"))
    low = Window.partitionBy("qid", "node_type").orderBy(F.desc(sure))
    least = F.max(F.when(F.col("nth") == k, sure)).over(Window.partitionBy("qid", "node_type"))
    near = near.withColumn("nth", F.row_number().over(low)).withColumn("least", least).filter(F.col("least").isNull() | (F.col("cell") == ODD) | (F.col("guess") + F.col("lost") >= F.col("least") - SLACK))
    top = best(scored(best(near, rerank * k, "guess")), k, "score")
    if exact:
        bar = stored(top.groupBy("qid", "node_type").agg(F.when(F.count("score") >= k, F.min("score")).alias("bar")), "bars")
        # a type that has given fewer than k rows so far, or none, has no bar, and then every cell is read
        n_kinds = index.rows.agg(F.count_distinct("node_type")).first()[0]
        low = bar.groupBy("qid").agg(F.when(F.count("bar") >= n_kinds, F.min("bar")).alias("low"), F.collect_list(F.struct("node_type", "bar")).cast(kind).alias("bars"))
        wide = plan.join(low, "qid", "left").filter((F.col("place") < 0) | F.col("low").isNull() | (F.col("bound") >= F.col("low") - SLACK))
        top = best(scored(candidates(wide.select("qid", "cell", "bars"), True)), k, "score")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "node_type", "node_slug")  # at most k rows for each type
    return top.select("qid", "node_type", "node_slug", "score", F.row_number().over(w).cast("long").alias("rank"))


def probes_for(index: Index, queries: DataFrame, recall: float = 0.95, k: int = K) -> int:
    """The least number of cells that holds so large a share of the queries' k nearest. How many that are depends on the vectors: few where they lie in groups, most where they have no structure."""
    q = queries.withColumn("qid", F.col("qid").cast("string"))
    true = search(index, q, k, exact=True).join(index.rows.select("node_type", "node_slug", "cell"), ["node_type", "node_slug"])
    places = true.join(planned(index, q).select("qid", "cell", "place"), ["qid", "cell"]).groupBy("place").count().orderBy("place").collect()  # a row for each cell at most
    total, seen = sum(r[1] for r in places), 0
    for place, n in places:
        seen += n
        if seen >= recall * total:
            return max(1, place + 1)
    return 1


def share_read(index: Index, queries: DataFrame, probes: int = PROBES) -> float:
    """The mean share of all rows whose codes a query reads."""
    cells = index.cells()
    total = sum(n for n, _ in cells.values())
    read = planned(index, queries).filter(F.col("place") < probes).groupBy("cell").count().collect()
    return sum(cells[r[0]][0] * r[1] for r in read) / max(1, total * queries.count())
