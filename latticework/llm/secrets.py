"""Secret scan: patterns, and character Markov models compared by log-likelihood ratio.

Three patterns find assigned values, access keys and long hexadecimal strings. Beside them two order-2 character
models, one trained from random strings and one from ordinary identifiers (both labelled samples), judge every
other long run of key characters. The sum of the log-likelihood ratios over a run is the evidence that it is random; where it
passes ``Models.odds`` (the log of the odds that such a run is ordinary), it is a secret of kind ``random``. So a short run
needs more a character than a long one, and nothing else is asked of its length or letters. Patterns' spans are cut out of a run first.
What is left is judged between its separators: the stretch of parts with the greatest sum, then what lies before and after
it, so that a name doesn't dilute its value.

Ordinary samples are composed from parts of identifiers, syllables of several languages, numbers, dates and ruled lines
in the usual spellings; random ones from several alphabets: ``SAMPLES`` of each.

Offsets count code points, the end exclusive. Edge cases: a null text counts as empty and has no spans; a very long text is scanned
whole in one worker's memory, a very long run in time in proportion to the square of its separators at worst; null ids,
repeated rows and ties give one row each; an empty table gives an empty result; extra columns are dropped by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, text_udf

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
START = len(ALPHABET)
CODE = {c: i for i, c in enumerate(ALPHABET)}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SEPARATOR = re.compile("[/+_=-]+")
#: Labelled strings of each kind that the models are trained from.
SAMPLES = 20_000
FIELDS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

#: Parts of ordinary identifiers, from which labelled samples are composed.
PARTS = """get set add remove update create delete find load save read write open close start stop init run make build
parse format render handle process check test verify count index value key name type size list map user file path
node item data row column table query request response client server session config option setting error message
event state status result total price order customer product address email phone date time hour minute second
first last next previous current default max min avg sum left right top bottom width height color image text title
page link button form input output buffer stream socket thread worker queue cache lock token model view controller
service manager factory handler helper util common base abstract interface public private static final string
integer boolean number array object function method class module package version release internal external local
remote global unique primary foreign reference description information organization international documentation
communication responsibility configuration authentication implementation environment development""".split()


#: Beginnings, middles and ends of syllables in European languages.
ONSETS = "b bl br c ch cl cr d dr dw f fl fr g gl gn gr gu h j k kl kn kr l ll m n p pf ph pl pr ps qu r rh s sc sch schl schm schn schr schw sh sk sl sm sn sp spr st str sw t th tr tw tz v w wh wr y z zw".split()
NUCLEI = "a a a e e e e i i i o o o u u ai au ay ea ee ei eu ia ie ieu io oa oe oi oo ou ue ui y".split()
CODAS = [*[""] * 24, *"b c ch ck ct d f ff ft g gh ght gn h k l ld lk ll lm ls lt m mb mp mpf n nce nch nd ng ngs nk ns nst nt p ph ps pt r rb rch rd rf rg rk rl rm rn rs rst rt s sch ss st t th tion ts tt tz v w x z".split()]


def ordinary(rng: random.Random) -> str:
    """An identifier, a word, a path, a number, a date or a ruled line."""
    shape = rng.random()
    if shape < 0.08:
        return "".join(rng.choices("0123456789", k=rng.randint(4, 20)))
    if shape < 0.11:
        return f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    if shape < 0.15:
        return rng.choice("-=_+/.") * rng.randint(8, 60) if shape < 0.14 else rng.choice(ALPHABET) * rng.randint(8, 20)
    invented = lambda: "".join(rng.choice(ONSETS) * (rng.random() < 0.8) + rng.choice(NUCLEI) + rng.choice(CODAS) for _ in range(rng.randint(1, 7)))
    words = [rng.choice(PARTS) if rng.random() < 0.5 else invented() for _ in range(rng.randint(1, 6))]
    if rng.random() < 0.15:
        words.append(str(rng.randint(1, 9999)))
    spelled = [
        lambda: "_".join(words), lambda: "-".join(words), lambda: "".join(w.title() for w in words), lambda: words[0] + "".join(w.title() for w in words[1:]),
        lambda: "/".join(words) + "/", lambda: "_".join(words).upper(), lambda: "".join(words), lambda: "=".join(words), lambda: "-".join(w.title() for w in words), lambda: "".join(words).upper(),
    ]
    return rng.choice(spelled)()


def labelled_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """(string, label): 1 for random strings (several alphabets), 0 for ordinary ones."""
    rng = random.Random(seed)
    b64, upper, lower = ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62]
    out = []
    for _ in range(n):
        kind = rng.choice([b64, ALPHABET[:62], ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52], upper, lower, "0123456789abcdef"])
        out += [("".join(rng.choices(kind, k=rng.randint(16, 64))), 1), (ordinary(rng), 0)]
    return out


def train(samples: list[tuple[str, int]], label: int) -> np.ndarray:
    """Log-probabilities of a character after two others, backing off to one and none with fixed weights."""
    k = len(ALPHABET)
    tri, bi, uni = np.zeros((k + 1, k + 1, k)), np.zeros((k + 1, k)), np.zeros(k)
    for text, y in samples:
        if y != label:
            continue
        a = b = START
        for c in text:
            i = CODE.get(c)
            if i is None:
                a = b = START
                continue
            tri[a, b, i] += 1
            bi[b, i] += 1
            uni[i] += 1
            a, b = b, i
    p0 = (uni + 0.5) / (uni.sum() + 0.5 * k)
    p1 = (bi + 8 * p0) / (bi.sum(-1, keepdims=True) + 8)
    return np.log((tri + 8 * p1) / (tri.sum(-1, keepdims=True) + 8))


@dataclass(frozen=True)
class Models:
    """``ratio``: log-likelihood ratio (random over ordinary) of each character after two others. No character adds more than ``most``: what ordinary
    samples lack altogether tells less than its ratio says."""

    ratio: np.ndarray
    most: float = 3.0
    odds: float = 12.0

    @staticmethod
    def fit(samples: list[tuple[str, int]] | None = None, **settings) -> Models:
        return Models(default_ratio() if samples is None else ratio_of(samples), **settings)

    def sums(self, run: str) -> np.ndarray:
        """Sums of the ratios of the first characters, from none to all."""
        codes = np.array([START, START, *(CODE[c] for c in run)])
        return np.concatenate(([0.0], np.cumsum(np.minimum(self.ratio[codes[:-2], codes[1:-1], codes[2:]], self.most), dtype=np.float64)))

    def is_secret(self, run: str) -> bool:
        """Far likelier random than ordinary."""
        return bool(self.windows(run))

    def windows(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of secrets in a run: the stretch between separators with the greatest sum, if that passes ``odds``, then the same before and after it."""
        if not run:
            return []
        sums = self.sums(run)
        edges = sorted({0, len(run), *(i for m in SEPARATOR.finditer(run) for i in m.span())})
        at = sums[edges]
        found, todo = [], [(0, len(edges) - 1)]
        while todo:
            low, high = todo.pop()
            if high <= low:
                continue
            part = at[low : high + 1]
            least = np.minimum.accumulate(part)  # of all starts before an end
            gain = part[1:] - least[:-1]
            j = int(gain.argmax())
            if gain[j] <= self.odds:
                continue
            j += 1
            i = int(part[:j].argmin())
            found.append((edges[low + i], edges[low + j]))
            todo += [(low, low + i), (low + j, high)]
        return sorted(found)


def ratio_of(samples: list[tuple[str, int]]) -> np.ndarray:
    return (train(samples, 1) - train(samples, 0)).astype(np.float32)


@cache
def default_ratio() -> np.ndarray:
    return ratio_of(labelled_samples())


def spans_of(text: str, models: Models) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in ``KINDS``) of all spans, by start, then kind."""
    found = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    base: list[tuple[int, int]] = []
    for s, e, _ in sorted(found):  # without overlaps
        if base and s <= base[-1][1]:
            base[-1] = (base[-1][0], max(e, base[-1][1]))
        else:
            base.append((s, e))
    ends = [e for _, e in base]
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        at = bisect_left(ends, s + 1)
        while at < len(base) and base[at][0] < e:  # what lies before each span of a pattern, then the rest
            found += [(s + a, s + b, 3) for a, b in models.windows(text[s : base[at][0]])]
            s = max(s, base[at][1])
            at += 1
        found += [(s + a, s + b, 3) for a, b in models.windows(text[s:e])]
    return sorted(found, key=lambda x: (x[0], x[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def make_scan(models: Models):
    def scan_one(text: str) -> tuple:
        found = spans_of(text, models)
        n = [sum(k == x for *_, k in found) for x in range(4)]
        base = listed([x for x in found if x[2] < 3])
        return *n, hashlib.sha256(base.encode()).hexdigest(), listed(found)

    return scan_one


def make_redact(models: Models):
    """Each maximal run of overlapping spans becomes one placeholder; texts without spans stay as they are."""

    def redact_one(text: str) -> tuple[str]:
        found = spans_of(text, models)
        if not found:
            return (text,)
        out, end = [], 0
        for s, e, k in found:
            if s >= end:
                out += [text[end:s], f"<{KINDS[k].upper()}_REMOVED>"]
            end = max(end, e)
        return ("".join([*out, text[end:]]),)

    return redact_one


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", models: Models | None = None) -> DataFrame:
    """A row per document: its id and ``FIELDS``. One pass, no shuffle; the models (1.4 MB) travel with the function."""
    models = models or Models.fit()
    run = text_udf(lambda: make_scan(models), FIELDS)
    return docs.select(F.col(id_col), run(F.col(text)).alias("r")).select(id_col, "r.*")


def redact(docs: DataFrame, text: str = "text", models: Models | None = None) -> DataFrame:
    """All documents and columns; secrets in ``text`` are replaced (null stays null)."""
    models = models or Models.fit()
    run = text_udf(lambda: make_redact(models), "text string")
    made = fresh(docs, "redacted")
    out = docs.withColumn(made, run(F.col(text)))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col(f"{made}.text"))).drop(made)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
