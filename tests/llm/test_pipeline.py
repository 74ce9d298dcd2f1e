"""The corpus pipeline and its stages: against brute force on the smallest data, and on odd, empty and repeated rows."""

import hashlib
import os
import re

import numpy as np
import pytest
import tokenizers
import zstandard

import corpus_pipeline as P
from latticework.llm import bpe, quality, secrets

DATA = "/root/testdata/sf0.001"
BENCH = [("1", "plain words here"), (None, "漢字 é"), ("3", None)]


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with test items and labels only; stages take their documents as an argument."""
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "bpe_tokens"]


@pytest.mark.parametrize("place", range(5))
def test_each_stage_on_odd_and_empty_tables(spark, odd_docs, no_docs, folder, place):
    name, stage = P.STAGES[place]
    out = stage(spark, odd_docs, folder)
    rows = out.collect()
    if name != "bpe_tokens":
        assert out.columns == odd_docs.columns
    ids = sorted(str(r.doc_id) for r in rows)
    assert ids == {
        "quality_rules": [],  # all are too short, null ones too
        "ngram_jaccard_join": ["1", "2", "3", "4", "5", "6", "None"],  # of two equal rows with one id one stays; empty ones stay
        "benchmark_decontamination": ["2", "3", "4", "5", "6", "None"],  # what is only a test item goes
        "secret_scan": ["1", "1", "2", "3", "4", "5", "6", "None"],
        "bpe_tokens": ["1", "1", "2", "3", "4", "5", "6", "None"],
    }[name]
    empty = stage(spark, no_docs, folder)
    assert empty.count() == 0 and (name == "bpe_tokens" or empty.columns == no_docs.columns)


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_by_rules(text, bands):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return False
    data, z = text.encode(), zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
    ratio = lambda b: len(z.compress(b)) / len(b)
    low, high = bands.band(len(data))
    cuts = [data[i : i + 2048] if i + 2048 <= len(data) else data[-2048:] for i in range(0, len(data), 2048)] if len(data) > 2048 else []
    below, above = sum(ratio(c) < bands.chunk_limits[0] for c in cuts), sum(ratio(c) > bands.chunk_limits[1] for c in cuts)
    return low <= ratio(data) <= high and max(below, above) <= 0.3 * len(cuts)


def cut(text, items):
    """Words in windows of test items, removed again and again; None if over half of them are hit at first, or nothing is left."""
    first = True
    while True:
        words = words10(text)
        windows = {tuple(i[k : k + 10]) for i in items for k in range(len(i) - 9)} | {tuple(i) for i in items if 0 < len(i) < 10}
        hit = [False] * len(words)
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        if not any(hit):
            return text
        if first and sum(hit) > 0.5 * len(words):
            return None
        first = False
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        out, end, k = [], 0, 0
        while k < len(words):
            if hit[k]:
                j = k
                while j + 1 < len(words) and hit[j + 1]:
                    j += 1
                out.append(text[end : spans[k][0]])
                end, k = spans[j][1], j
            k += 1
        text = "".join([*out, text[end:]])
        if not text.strip():
            return None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline_against_brute_force(spark):
    table = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    docs = {r.doc_id: r.text or "" for r in table("documents").collect()}
    bands = quality.fitted(table("documents"), table("labels"))
    docs = {i: t for i, t in docs.items() if kept_by_rules(t, bands)}
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = {i: t for i, t in docs.items() if find(i) == i}
    items = [words10(r.text or "") for r in table("benchmark").collect()]
    docs = {i: c for i, t in docs.items() if (c := cut(t, items)) is not None}
    redact = secrets.make_redact(secrets.Models.fit())
    docs = {i: redact(t)[0] for i, t in docs.items()}
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.run(spark, DATA).collect()}
    assert got == want and 0 < len(got) < 200
