"""Conversation repair, periodic runs and token counts against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from latticework.llm import periodic, repair, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- conversation repair ----
def cheapest_edits(rows):
    """Least (cost, audit) by search over all outputs."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        at = heapq.heappop(heap)
        cost, audit, i, out = at
        if at in seen:
            continue
        seen.add(at)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", out):
            return cost, audit
        if not re.fullmatch(r"s?(ua)*u?", out):
            continue
        if i < len(rows):
            initial, gone, short = rows[i]
            extra = 3 if short else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if not gone:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, out + (initial or "?")))
                for x in "ua":
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, out + x))
        for x in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + x))


def repaired_plainly(turns):
    """Conversation id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of (conv, turn, role, text)."""
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, coded = set(), [0, 0, 0], []
        for _, role, text in rows:
            said = "".join(WORDS.findall(text))
            blank, dup = not said, bool(said) and (role, text) in seen
            short = bool(said) and not dup and said[-1] not in ".!?"
            seen.add((role, text))
            for i, x in enumerate((blank, dup, short)):
                faults[i] += x
            coded.append((role[:1], blank or dup, short))
        wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit = cheapest_edits(coded) if len(coded) < 9 else repair.cheapest(coded)
        lines, i, want = [], 0, "user"
        for letter in audit:
            _, role, text = rows[i] if letter != "I" else (None, want, "")
            i += letter != "I"
            if letter == "D":
                continue
            role = role if letter == "K" else want
            lines.append(f"{role}:{text}")
            want = "assistant" if role[:1] == "u" else "user"
        numbers = {t for t, _, _ in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *faults, wrong, cost, audit, "\n".join(lines))
    return out


def made_turns(seed, convs, most):
    r, rows = random.Random(seed), []
    for conv in range(convs):
        for i in range(r.randint(1, most)):
            role = r.choice(["user", "assistant"][i % 2 : i % 2 + 1] * 3 + ["user", "assistant", "system", "tool", "", None])
            text = r.choice([f"said {i}.", f"said {i}!", "again.", "cut", "", "\t \n", None, "wait? \n"])
            turn = r.choice([i, i, i, i + 3, None])
            rows += [(conv if conv else None, turn, role, text)] * r.choice([1, 1, 1, 2])
    return rows


def as_rows(df):
    return {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), "\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"])) for r in df.collect()}


def test_layers_find_the_least_edits():
    r = random.Random(1)
    for _ in range(400):
        rows = [(r.choice(["s", "s", "u", "u", "a", "a", "t", ""]), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 6))]
        assert repair.cheapest(rows) == cheapest_edits(rows)


def test_repair_equals_search(spark):
    turns = made_turns(2, 60, 5)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("id", "n", "conv", "blank", "cost", "digest")})
    assert as_rows(repair.repaired(df)) == repaired_plainly(turns)


def test_long_conversations_are_cut_and_folded(spark, monkeypatch):
    """Segments of a hot conversation give the same as the conversation at once; one holds a third of all rows, one is a single row many times."""
    turns = made_turns(3, 25, 40) + [(77, i % 200, ["user", "assistant", "system"][i % 3], f"{i % 90}" + ".!,"[i % 3]) for i in range(700)] + [(78, None, "user", "same.")] * 150
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    assert as_rows(repair.repaired(df)) == repaired_plainly(turns)


def test_repair_without_rows(spark):
    assert repair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repair_of_a_text_of_megabytes(spark):
    long = "word " * 800_000 + "end."
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "short.")], "conv_id long, turn long, role string, text string")
    (row,) = repair.repaired(df).collect()
    assert (row["cost"], row["audit"], len(row["repaired"][0]["text"])) == (0, "KK", len(long))


def test_query_damages_by_checksum(spark, tmp_path):
    turns = [(c, t, ["user", "assistant"][t % 2], f"one. two {c} {t}!") for c in range(40) for t in range(4)] + [(None, None, None, None), (50, None, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, role, text in turns:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if d == 4 else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        hurt += [(c, t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    want = repaired_plainly(hurt)
    got = {r["conv_id"]: r for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, row in got.items():
        gaps, *rest, text = want.get(conv, (0, 0, 0, 0, 0, 0, "", ""))
        assert [row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")] == [gaps, *rest, hashlib.sha256(text.encode()).hexdigest()]


# ---- periodic runs ----
def runs_plainly(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k - p] for k in range(start + p, j)) for p in range(1, q)):
                found.append((start, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r, n = random.Random(4), 0
    for _ in range(1500):
        words = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randint(0, 50))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = words[at : at + r.randint(1, 7)] * r.randint(2, 7)
        assert periodic.runs_of(words) == runs_plainly(words)
        n += len(periodic.runs_of(words))
    assert n > 500


def test_blocks_of_end_positions():
    r = random.Random(5)
    numbers = r.sample(range(100_000), 5000)
    ends, known = periodic.Ends(numbers[0]), {numbers[0]}
    for x in numbers[1:]:
        before, after = ends.add(x)
        if len(known) % 500 == 1:
            assert before == max((y for y in known if y < x), default=None) and after == min((y for y in known if y > x), default=None)
        known.add(x)
    assert list(ends) == sorted(numbers) and len(ends.blocks) > 1


@pytest.mark.parametrize("words", [["a"] * 30_000, ["a", "b", "a"] * 10_000])
def test_runs_of_very_long_texts(words):
    ((start, length, period),) = [r for r in periodic.runs_of(words) if r[1] == len(words)]
    assert (start, length, period) == (0, 30_000, 1 if len(set(words)) == 1 else 3)


def test_periodic_query(spark, tmp_path):
    docs = [(i, " ".join(random.Random(i).choice("ab cd ef gh ij kl".split()) for _ in range(i % 70))) for i in range(400)]
    docs += [(900, None), (None, "a a a a a a\ta"), (901, ""), (902, " \n\t"), (903, "x " * 8 + "  " + "y z " * 7), (903, "dup")]
    spark.createDataFrame([(*d, 7, "mine") for d in docs], "doc_id long, text string, runs int, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want, planted = [], 0
    for i, text in docs:
        words = WORDS.findall(text or "")
        n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = runs_plainly(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert planted > 20 and sum(w[1] > 0 for w in want) > 30
    assert got == sorted(want, key=repr)


def test_periodic_runs_of_odd_and_no_documents(spark, odd_docs, no_docs):
    rows = periodic.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["periodic"]["collapsed"] for r in rows if not (r["text"] or "").strip()} == {""}
    assert periodic.periodic_runs(no_docs).count() == 0


# ---- token counts ----
def library_counts(texts, path):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


ODD_TEXTS = [
    "", "  ", "Plain words, and more.", "plain  WORDS, and\tmore.", "A <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|startoftext|><|endoftext|>", "J̌ ǰ ǰ", "İstanbul İ", "ΟΔΟΣ Σ", "漢字 かな 🎉 é é",
    "x\x1cy \x85 z w v", "don't can't 's''s '", "\x00 a\x00b", "1234 5 ٣", "á̧ ́b", "x" * 5000, "K Å ﬁ ½", "​‍ zero", "ÀÉÎ àéî À", "word\x0bword\x0cword\rword", "Ǆ ǅ ǆ ͅ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, tmp_path, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS * 2)) + [(None, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "digest", "n_tokens", "tokenizer")})
    got = {r["doc_id"]: r for r in token_counts.counts(docs, f"{tmp_path}/cache", path, limit=20).collect()}
    want = library_counts(ODD_TEXTS, path) * 2
    assert {i: got[i]["n_tokens"] for i in range(len(want))} == dict(enumerate(want))
    assert got[None]["n_tokens"] == 0 and got[None]["n_bytes"] == 0
    assert all(got[i]["over_limit"] == (n > 20) and got[i]["n_bytes"] == len(t.encode()) for i, (n, t) in enumerate(zip(want, ODD_TEXTS * 2, strict=True)))


def test_the_cache_is_used_and_grows_by_misses(spark, tmp_path):
    import public_tokenizers

    cache, path = f"{tmp_path}/cache", public_tokenizers.path("word_bpe_49k.json")
    first = [(i, f"text number {i % 30}") for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    token_counts.counts(frame(first), cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 30 and stored.select("tokenizer").distinct().count() == 1
    # a poisoned cache shows that hits aren't encoded again, that normalised forms hit, and that other tokenizers don't
    spark.createDataFrame([(token_counts.tokenizer_digest(path), hashlib.sha256(b"never seen").digest(), 777)], token_counts.KIND).write.mode("append").partitionBy("tokenizer").parquet(cache)
    second = [(1, "never   SEEN\n"), (2, "text number 5"), (3, "something new"), (4, "Something\tnew")]
    for few in (0, token_counts.FEW):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counts(frame(second), cache, few=few).collect()}
        assert got[1] == 777 and [got[2], got[3], got[4]] == library_counts([t for _, t in second[1:]], path)
    assert spark.read.parquet(cache).count() == 32
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert {r["n_tokens"] for r in token_counts.counts(frame(second[:1]), cache, other).collect()} == set(library_counts([second[0][1]], other))


def test_counts_by_broadcast_and_by_shuffle_agree(spark, tmp_path, odd_docs):
    rows = [sorted((repr(r) for r in token_counts.counts(odd_docs, f"{tmp_path}/c{few}", few=few).collect())) for few in (0, 1000)]
    assert rows[0] == rows[1] and len(rows[0]) == odd_docs.count()


def test_counts_of_no_documents(spark, tmp_path, no_docs):
    assert token_counts.counts(no_docs, f"{tmp_path}/cache").count() == 0
