import random
import re

from latticework.llm import decontaminate as d


def brute(items, text, window):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = pattern.findall(lower(text))
    hit, found = [0] * len(words), set()
    for name, body in items:
        x = pattern.findall(lower(body))
        k = min(window, len(x))
        if not k:
            continue
        wins = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                found.add(name)
                hit[i : i + k] = [1] * k
    return len(words), sum(hit), len(found), d.digest_items(found), sum(hit) > 0


def test_hits_against_brute_force_in_one_and_two_blocks():
    rng = random.Random(1)
    for trial in range(1500):
        window = rng.choice([2, 3, 4, 10])
        text = lambda m: " ".join(rng.choice(["a", "b", "C", "é"]) for _ in range(rng.randint(0, m)))
        items = [(str(i), text(rng.choice([3, 12, 25]))) for i in range(rng.randint(0, 6))]
        doc = text(60)
        built = [d.Automaton.build(items[:3], window), d.Automaton.build(items[3:], window)] if trial % 2 else [d.Automaton.build(items, window)]
        assert d.make_find(built)(doc)[:5] == brute(items, doc, window)


def test_clean_leaves_no_hit():
    rng = random.Random(2)
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(12))) for i in range(4)]
    built = [d.Automaton.build(items, 4)]
    for _ in range(300):
        doc = " ".join(rng.choice("abcxyz") for _ in range(80))
        out = d.make_clean(built, 0.9)(doc)[0]
        if out is not None:
            assert brute(items, out, 4)[1] == 0
            assert (out == doc) == (brute(items, doc, 4)[1] == 0)


def test_frames(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "plain words here"), (1, "plain words here"), (None, "漢字 é"), (3, None), (4, "..")], "item_id long, text string")
    rows = d.find(odd_docs, items).collect()
    assert len(rows) == 8
    assert [(r.n_hit, r.n_items, r.items_sha256) for r in rows if r.doc_id == 1] == [(3, 1, d.digest_items(["1"]))] * 2
    assert [r.n_words for r in rows if r.doc_id in (2, 3, 4)] == [0, 0, 0]
    kept = d.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6", "None"]
    assert d.find(no_docs, items).count() == 0 and d.find(odd_docs, items.limit(0)).filter("contaminated").count() == 0
    blocks = list(d.automata(items, block_words=2))
    assert len(blocks) > 1


def test_passes_over_several_blocks_give_what_one_gives(spark, odd_docs):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "d", "é"])
    items = spark.createDataFrame([(str(i), " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(30)] + [("x", "plain words here")], "item_id string, text string")
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), "kept") for i in range(60)] + [(60, None, "n"), (1, "plain words here", "twice"), (None, "beta " * 40, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for given in (docs, odd_docs):
        one, many = (sorted(map(tuple, d.find(given, items, window=6, block_words=n).collect()), key=str) for n in (10**6, 40))
        assert one == many
        for coverage in (0.5, 1.0):
            one, many = (d.clean(given, items, window=6, coverage=coverage, block_words=n) for n in (10**6, 40))
            assert one.columns == many.columns == given.columns
            # the order of cuts may differ where spans of several blocks touch; what is left has no hit and is the same
            assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
