"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled texts. A text compressed with both gives
``d = (bad size - good size) / (bad size + good size)``: above 0 where it resembles the good texts more. A text that repeats
itself compresses well under either dictionary, so the difference is calibrated together with the plain ratio: a logistic
regression over a few terms of the two and the length turns them into a probability between 0 and 1.

Training reads a bounded sample of labelled rows: at most ``PER_CLASS`` of each class (those of least hash of the id), whole texts. Two thirds of it
train the dictionaries (on a worker, one task a class), a third fits the calibration (its terms are made on the workers). The driver gets two
dictionaries and a dozen numbers for each row of calibration, never a text. Calibration rows weigh what their class has of all labelled rows, so scores
don't move with the bound. Rows with crc32(doc_id as text) mod 5 = 0 are held out. Scoring compresses whole texts.

Edge cases: a null or empty text is scored like any other (its ratio is 1, its difference 0); a very long text is compressed whole, its terms count as
the utmost of the calibration rows where they go beyond; a null id is not held out and has no
label; several labels of one id count as the highest; where a class has too few labelled rows every score is the share of good rows (0.5 without any);
repeated rows give one row each; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf
from .labels import fold, known, labelled_ids, texts_of

PER_CLASS = 3000
DICT_BYTES = 112_640
#: Length of the passages that a dictionary is made of, and of the strings that they are chosen by.
PASSAGE, GRAM = 512, 8
CUT = 0.3
LEVEL = 3
#: Fewest rows of a class in the sample.
LEAST = 9


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Content of a dictionary: passages that share most with all the texts; of few texts all there is."""
    if sum(map(len, texts)) > 2 * size and len(texts) > 8:
        return zstandard.train_dictionary(size, texts, k=PASSAGE, d=GRAM).as_bytes()
    return b"\n".join(texts)[:size]


class Sizes:
    """Compressed sizes of a text: plain, with the good and with the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.all = [compressor(b""), compressor(good), compressor(bad)]

    def terms(self, data: bytes) -> list[float]:
        """What the calibration sees: difference, plain ratio against its usual value at this length, and products."""
        plain, good, bad = (len(c.compress(data)) for c in self.all)
        d = (bad - good) / (bad + good)
        size = np.log2(len(data) + 1)
        ratio = plain / len(data) if data else 1.0
        r = np.log(ratio)
        return [1.0, d, r, d * r, size / 10, size * r / 10, size * d / 10, size * size / 100, max(0.0, -r - 1), max(0.0, r + 0.3), max(0.0, d - 0.1), max(0.0, -d)]


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method; each row counts ``share`` times."""
    share = np.ones(len(y)) if share is None else share
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - penalty @ w
        h = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """``weights`` over terms scaled by ``mean`` and ``scale``, each within its range ``low`` to ``high``; without weights every score is ``prior``."""

    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.5
    weights: tuple[float, ...] | None = None
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()

    @staticmethod
    def calibrated(good: bytes, bad: bytes, terms: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> Model:
        """``terms`` and ``y`` of the calibration rows; ``counts`` of all labelled rows by class."""
        total = sum(counts.values())
        share = np.array([counts[k] / total * len(y) / max(1, (y == k).sum()) for k in y.tolist()])
        mean, scale = terms.mean(0), terms.std(0) + 1e-9
        mean[0], scale[0] = 0.0, 1.0
        w = logistic((terms - mean) / scale, y.astype(float), share)
        return Model(good, bad, counts.get(1, 0) / total, tuple(w), tuple(mean), tuple(scale), tuple(terms.min(0)), tuple(terms.max(0)))

    @staticmethod
    def fit(sample: list[tuple[str, int]], counts: dict[int, int] | None = None) -> Model:
        """The same from texts in memory: ``sample`` of (text, 1 good or 0 bad), every third row of a class for the calibration."""
        by = {k: sorted(t for t, y in sample if y == k) for k in (1, 0)}
        counts = counts or {k: len(v) for k, v in by.items()}
        if min(map(len, by.values())) < LEAST:
            return Model(prior=counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5)
        data = {k: [t.encode("utf-8", "replace") for t in v] for k, v in by.items()}
        good, bad = (dictionary([t for i, t in enumerate(data[k]) if i % 3]) for k in (1, 0))
        sizes = Sizes(good, bad)
        rows = [(sizes.terms(t), k) for k, v in data.items() for t in v[::3]]
        return Model.calibrated(good, bad, np.array([x for x, _ in rows]), np.array([k for _, k in rows]), counts)

    def scorer(self):
        if self.weights is None:
            return lambda text: self.prior
        sizes = Sizes(self.good, self.bad)
        w, mean, scale, low, high = map(np.array, (self.weights, self.mean, self.scale, self.low, self.high))

        def score(text: str) -> float:
            z = float((np.clip(sizes.terms(text.encode("utf-8", "replace")), low, high) - mean) / scale @ w)
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def train_class(t: pa.Table) -> pa.Table:
    """All dictionary texts of a class, a bounded number of rows: one row of y, content."""
    texts = sorted(x.encode("utf-8", "replace") for x in t.column("text").to_pylist())
    return pa.table([pa.array([t.column("y")[0].as_py()], pa.int32()), pa.array([dictionary(texts)], pa.binary())], names=["y", "content"])


def training_sample(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """``id``, ``text``, ``y`` of at most ``per_class`` labelled documents of each class, none of them held out. The ids are chosen first, so that what is broadcast is bounded."""
    ids = labelled_ids(labels, 1, per_class, id_col, label).unionAll(labelled_ids(labels, 0, per_class, id_col, label))
    return texts_of(docs, ids, text, id_col)


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from the ``training_sample``."""
    counts = {int(y): n for y, n in known(labels, id_col, label).groupBy("y").count().collect()}
    counts = {k: counts.get(k, 0) for k in (0, 1)}
    total = sum(counts.values())
    if not total:
        return Model()
    sample = training_sample(docs, labels, text, id_col, label, per_class)
    third = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(3)) == 0
    made = sample.filter(~third).select(F.col("y").cast("int").alias("y"), "text").groupBy("y").applyInArrow(train_class, "y int, content binary")
    content = {y: bytes(c) for y, c in made.collect()}
    if len(content) < 2:
        return Model(prior=counts[1] / total)
    sizes = Sizes(content[1], content[0])
    names = [f"x{i}" for i in range(len(sizes.terms(b"")))]
    run = text_udf(lambda: (lambda t, s=Sizes(content[1], content[0]): tuple(s.terms(t.encode("utf-8", "replace")))), ", ".join(f"{n} double" for n in names))
    rows = sample.filter(third).select("id", F.col("y").cast("int").alias("y"), run("text").alias("t")).select("id", "y", "t.*").collect()
    y = np.array([r["y"] for r in rows])
    if min((y == k).sum() for k in (0, 1)) < LEAST // 3:
        return Model(prior=counts[1] / total)
    rows.sort(key=lambda r: (r["y"], *(r[n] for n in names)))  # sums in one order, whatever order the rows came in
    return Model.calibrated(content[1], content[0], np.array([[r[n] for n in names] for r in rows]), np.array([r["y"] for r in rows]), counts)


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: its id, ``held_out``, ``score``, ``predicted``. One pass, no shuffle; the model (0.3 MB) travels with the function."""
    run = text_udf(lambda: (lambda t, s=model.scorer(): (s(t),)), "score double")
    out = docs.select(F.col(id_col), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), run(F.col(text)).alias("r"))
    return out.select(id_col, "held_out", "r.score", F.when(F.col("r.score") >= CUT, 1).otherwise(0).alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, table(spark, sf_dir, "labels")))
