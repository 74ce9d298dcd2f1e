"""MinHash over character trigrams of normalised labels, and the match predicate on label keys."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# Number of permutations, seed, shingle size, modulus, threshold.
PERMUTATIONS = 64
SEED = 1
SHINGLE = 3
PRIME = (1 << 61) - 1
THRESHOLD = 0.72
#: 46 of 64 equal slots are below the threshold, 47 are not; so at most 17 slots of a match differ and 18 bands have an equal one.
BANDS = 18
SIZES = [4] * 10 + [3] * 8
STARTS = [sum(SIZES[:i]) for i in range(BANDS)]
#: A label with so long a number is found by its numbers alone.
LONG_NUMBER = "[0-9]{5}"


def permutations(count: int = PERMUTATIONS, seed: int = SEED) -> list[tuple[int, int]]:
    draw = random.Random(seed).randint
    return [(draw(1, PRIME - 1), draw(0, PRIME - 1)) for _ in range(count)]


def mul_mod(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """a * h modulo 2^61 - 1 for a below 2^61 and h below 2^32, within 64 bits."""
    m = np.uint64(PRIME)
    low, high = a & np.uint64(0xFFFFFFF), a >> np.uint64(28)  # 28 and 33 bits
    x = low * h  # below 2^60
    y = high * (h & np.uint64(0xFFFF))  # below 2^49
    z = high * (h >> np.uint64(16))  # below 2^49

    def shifted(v: np.ndarray, by: int) -> np.ndarray:  # v * 2^by mod 2^61 - 1, v below 2^61
        return ((v << np.uint64(by)) & m) + (v >> np.uint64(61 - by))

    return (x + shifted(y, 28) + shifted(z, 44)) % m


def signature_rows(keys: list[str | None]) -> list[list[int] | None]:
    a, b = (np.array(p, np.uint64)[:, None] for p in zip(*permutations(), strict=True))
    out: list[list[int] | None] = []
    for key in keys:
        if key is None:
            out.append(None)
            continue
        grams = {key[i : i + SHINGLE] for i in range(len(key) - SHINGLE + 1)} or ({key} if key else set())
        if not grams:
            out.append([0] * PERMUTATIONS)
            continue
        h = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64)[None, :]
        out.append(((mul_mod(a, h) + b) % np.uint64(PRIME)).min(1).astype(np.int64).tolist())
    return out


def signature(key: Column) -> Column:
    run = F.arrow_udf(lambda keys: pa.array(signature_rows(keys.to_pylist()), pa.list_(pa.int64())), ArrayType(LongType()))
    return run(key)


def shingles(key: Column) -> Column:
    """Distinct trigrams; a shorter key is its own, an empty one has none."""
    n = F.length(key)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(SHINGLE)))
    return F.when(n > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def equal_slots(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def jaccard_estimate(x: Column, y: Column) -> Column:
    return equal_slots(x, y) / F.lit(float(PERMUTATIONS))


def numeric_tokens(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"\d+"), F.lit(0))


def suffix_variant(a: Column, b: Column) -> Column:
    """One key is the other with at most one more character."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return long.startswith(short) & (F.length(long) - F.length(short) <= 1)


def keys_match(a: Column, b: Column, sig_a: Column, sig_b: Column, empty: Column | None = None) -> Column:
    """Equal, or no different numbers and either a suffix variant or similar enough. Cheap tests come first."""
    some = (F.length(a) > 0) & (F.length(b) > 0)
    near = suffix_variant(a, b) | (jaccard_estimate(sig_a, sig_b) >= THRESHOLD)
    return (a == b) | (some & (numeric_tokens(a) == numeric_tokens(b)) & near)


def band_keys(key: Column, sig: Column) -> Column:
    """Keys of which two matching labels share at least one: bands of their signatures, and themselves with and without the last character.
    All carry the numbers of the label, which a match needs alike. A number of five digits or more is rare enough to be the only key."""
    numbers = F.array_join(numeric_tokens(key), ",")
    bands = [F.concat_ws("|", F.lit(f"b{i}"), numbers, F.xxhash64(F.slice(sig, s + 1, n)).cast("string")) for i, (s, n) in enumerate(zip(STARTS, SIZES, strict=True))]
    plain = [F.concat_ws("|", F.lit("s"), numbers, k) for k in (key, F.substring(key, F.lit(1), F.greatest(F.length(key) - 1, F.lit(0))))]
    return F.when(key.rlike(LONG_NUMBER), F.array(F.concat_ws("|", F.lit("n"), numbers))).otherwise(F.array_distinct(F.array(*bands, *plain)))


def band_rows(key: str, sig: list[int]) -> list[tuple]:
    """The same keys for one label."""
    numbers = tuple(re.findall(r"\d+", key))
    if re.search(LONG_NUMBER, key):
        return [("n", numbers)]
    return [(i, numbers, *sig[s : s + n]) for i, (s, n) in enumerate(zip(STARTS, SIZES, strict=True))] + [("s", numbers, k) for k in dict.fromkeys((key, key[:-1]))]
