r"""Conversation structure repair: Wu-Manber cost layers over a grammar of turns.

Role initials must read ``(s?(ua)+)?``. Four states tell how far a prefix has come: nothing yet, after s, after u, after a (first and last accept). A conversation is repaired by edits of its rows in order: Keep (0), Rerole to user or
assistant (3), Delete (4; the only one for blank rows and repetitions), Insert an empty user or assistant row anywhere (3); a truncated row that stays costs 3 more. For each cost, from 0 up, a layer holds for each
place between rows the bit set of states from which the rest can be completed at exactly that cost; it follows from the layers below by shifts and masks. The first layer with the start state at place 0 gives the cost, and a walk
along the bits, trying D, I, K, R in turn, gives the audit: of all cheapest edits the ASCII-least string of initials. From a state the letters decide the roles, so the audit decides the repaired rows.

Long conversations: rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any size spreads over tasks. What is cut, by a range or after ``SEGMENT`` rows, becomes segments. A segment's layers are kept
for each state it may end in (four groups of four bits in one word, shifted at once), which gives cost and least audit from each state to each. Costs add up and audits are strung together: equal rows at equal cost make no audit a
proper prefix of another, so the least whole is made of least parts, and a fold over the segments (16 bytes a row) picks the parts; the texts follow by a join. Ends that cost over ``SLACK`` more than the cheapest of "after u" and "after a" can't be
on a cheapest path (any of the two is 3 from the other, and gives up 4 at most to the states before them), so layers stop there.

Edge cases: null roles and texts count as one space; null turns come first; equal turns go by role, then text; equal rows are copies, and copies count as repetitions; other roles than system, user, assistant (by initial) can't be
kept; rows with a null conversation form one conversation; an empty table gives an empty result; extra columns are dropped; the repaired rows of a conversation are one array, so they must fit into one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidied

#: States: nothing, after s, after u, after a; a nibble for each state that a segment may end in.
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
M0, M1, M2, M3 = 0x1111, 0x2222, 0x4444, 0x8888
ACCEPT, EACH = 0b1001, 0x8421
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SEGMENT, SLACK = 64, 8

Row = tuple[str, bool, bool]  # initial, must go, truncated


def before(sets: int, initial: str) -> int:
    """States that the initial leads from into the sets."""
    if initial == "u":
        u = sets & M2
        return u >> 2 | u >> 1 | u << 1
    if initial == "a":
        return (sets & M3) >> 1
    return (sets & M1) >> 1 if initial == "s" else 0


def after(state: int, initial: str) -> int | None:
    """Where the initial leads from a state, if anywhere."""
    if initial == "u":
        return None if state == AFTER_U else AFTER_U
    if initial == "a":
        return AFTER_A if state == AFTER_U else None
    return AFTER_S if initial == "s" and state == NONE else None


def wanted(state: int) -> str:
    """The role, of those that a row can be given, that a state goes on with."""
    return "a" if state == AFTER_U else "u"


class Layers:
    """Bit sets of states by cost and place. ``ends`` are the sets behind the last row."""

    def __init__(self, rows: list[Row], ends: int):
        self.rows, self.ends = rows, ends
        self.none = [0] * (len(rows) + 1)
        self.at: list[list[int]] = []

    def layer(self, cost: int) -> list[int]:
        return self.at[cost] if cost >= 0 else self.none

    def add(self) -> list[int]:
        """The layer of the next cost."""
        c, n = len(self.at), len(self.rows)
        new = [0] * (n + 1)
        insert, delete, rerole, cut = self.layer(c - INSERT), self.layer(c - DELETE), self.layer(c - REROLE), self.layer(c - REROLE - TRUNCATED)
        kept_cut = self.layer(c - TRUNCATED)
        for i in range(n, -1, -1):
            sets = self.ends if i == n and c == 0 else 0
            x = insert[i]  # an inserted u or a leads into them
            if x:
                u = x & M2
                sets |= u >> 2 | u >> 1 | u << 1 | (x & M3) >> 1
            if i < n:
                initial, gone, short = self.rows[i]
                sets |= delete[i + 1]
                if not gone:
                    x = cut[i + 1] if short else rerole[i + 1]
                    u = x & M2
                    sets |= u >> 2 | u >> 1 | u << 1 | (x & M3) >> 1
                    x = kept_cut[i + 1] if short else new[i + 1]
                    if x:
                        sets |= before(x, initial)
            new[i] = sets
        self.at.append(new)
        return new

    def trace(self, state: int, cost: int, group: int = 0) -> str:
        """The least audit from a state at place 0, of a cost at which its bit is set in a group."""
        i, n, out, shift = 0, len(self.rows), [], 4 * group
        while i < n or cost:
            row = self.rows[i] if i < n else None
            extra = TRUNCATED if row and row[2] else 0
            moves = [("I", i, cost - INSERT, after(state, wanted(state)))]
            if row:
                moves.insert(0, ("D", i + 1, cost - DELETE, state))
                if not row[1]:
                    moves.append(("K", i + 1, cost - KEEP - extra, after(state, row[0])))
                    moves.append(("R", i + 1, cost - REROLE - extra, after(state, wanted(state))))
            for letter, place, left, to in moves:
                if left >= 0 and to is not None and self.at[left][place] >> shift >> to & 1:
                    out.append(letter)
                    i, cost, state = place, left, to
                    break
            else:
                raise AssertionError("no way on")
        return "".join(out)


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """Cost and least audit of a whole conversation."""
    layers, c = Layers(rows, ACCEPT), 0
    while not layers.add()[0] & 1:
        c += 1
    return c, layers.trace(NONE, c)


def ways(rows: list[Row]) -> list[dict]:
    """Cost and least audit of a segment from each state to each that can be on a cheapest path."""
    layers, first, done = Layers(rows, EACH), {}, {}
    while len(done) < 4 or len(layers.at) <= max(done.values()) + SLACK:
        c, sets = len(layers.at), layers.add()[0]
        for state in range(4):
            for end in range(4):
                if sets >> 4 * end + state & 1 and (state, end) not in first:
                    first[state, end] = c
                    if end >= AFTER_U:
                        done.setdefault(state, c)
    return [{"from": s, "to": e, "cost": c, "audit": layers.trace(s, c, e)} for (s, e), c in sorted(first.items())]


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that the edits leave."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        initial = roles[i][:1] if letter == "K" else wanted(state)
        out.append({"role": roles[i] if letter == "K" else NAMES[initial], "text": "" if letter == "I" else texts[i]})
        state = after(state, initial)
        i += letter != "I"
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


TURN = "struct<role:string,text:string>"
COUNTS = "blank long, duplicate long, truncated long, illegal long"
SEGMENTS = (
    f"conv long, turn long, seq long, whole boolean, cost long, audit string, repaired array<{TURN}>, {COUNTS}, first string, last string, "
    f"ways array<struct<from:int,to:int,cost:int,audit:string>>, roles array<string>, texts array<string>"
)
PIECES = f"conv long, id long, state int, piece string, total long, {COUNTS}"

_S, _L, _I = pa.string(), pa.int64(), pa.int32()
TURNS = pa.list_(pa.struct([("role", _S), ("text", _S)]))
_COUNTS = [(c, _L) for c in ("blank", "duplicate", "truncated", "illegal")]
SEGMENT_ROWS = pa.schema(
    [("conv", _L), ("turn", _L), ("seq", _L), ("whole", pa.bool_()), ("cost", _L), ("audit", _S), ("repaired", TURNS), *_COUNTS, ("first", _S), ("last", _S)]
    + [("ways", pa.list_(pa.struct([("from", _I), ("to", _I), ("cost", _I), ("audit", _S)]))), ("roles", pa.list_(_S)), ("texts", pa.list_(_S))]
)
PIECE_ROWS = pa.schema([("conv", _L), ("id", _L), ("state", _I), ("piece", _S), ("total", _L), *_COUNTS])


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, role, text, n, blank, repeated, short) as finished conversations, and as segments of those that may go on in another task or are long."""
    schema, out, held, seq = SEGMENT_ROWS, [], [], 0
    conv, split, some = None, True, False

    def finish(whole: bool) -> None:
        nonlocal held, seq
        rows = [(r["role"][:1], r["blank"] or again, r["short"]) for r, again in held]
        initials, roles, texts = [x[0] for x in rows], [r["role"] for r, _ in held], [r["text"] for r, _ in held]
        row = dict.fromkeys(schema.names) | {
            "conv": conv, "turn": held[0][0]["turn"], "seq": seq, "whole": whole, "first": initials[0], "last": initials[-1], "illegal": illegal(initials),
            "blank": sum(r["blank"] for r, _ in held), "duplicate": sum(again and not r["blank"] for r, again in held),
            "truncated": sum(r["short"] and not again and not r["blank"] for r, again in held),
        }
        if whole:
            cost, audit = cheapest(rows)
            row |= {"cost": cost, "audit": audit, "repaired": applied(audit, NONE, roles, texts)}
        else:
            row |= {"ways": ways(rows), "roles": roles, "texts": texts}
        out.append(row)
        held, seq = [], seq + 1

    for batch in batches:
        for r in batch.to_pylist():
            if not some or r["conv"] != conv:
                if held:
                    finish(not split)
                # the first conversation of a task may have begun in another
                conv, split, some = r["conv"], not some, True
            for copy in range(r["n"]):
                if len(held) == SEGMENT:
                    split = True
                    finish(False)
                held.append((r, r["repeated"] or copy > 0))
        if len(out) >= 200:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        finish(False)  # it may go on in the next task
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments without texts, by conversation and place, as the pieces of the cheapest audit. The conversation's totals stand in its first piece's row."""
    schema = PIECE_ROWS

    def finish(segs: list[dict]) -> pa.RecordBatch:
        best: dict[int, tuple[int, str]] = {NONE: (0, "")}
        back = []
        for s in segs:
            new: dict[int, tuple[int, str, dict]] = {}
            for way in s["ways"]:
                if way["from"] in best:
                    cost, audit = best[way["from"]]
                    this = cost + way["cost"], audit + way["audit"], way
                    if way["to"] not in new or this[:2] < new[way["to"]][:2]:
                        new[way["to"]] = this
            best = {to: x[:2] for to, x in new.items()}
            back.append({to: x[2] for to, x in new.items()})
        # two inserts at most lead from any state to an accepting one
        ends = [(c, a, e, "") for e, (c, a) in best.items()]
        ends = [(c, a, e, t) if e in (NONE, AFTER_A) else (c + INSERT, a + "I", e, "I") if e == AFTER_U else (c + 2 * INSERT, a + "II", e, "II") for c, a, e, t in ends]
        cost, _, state, tail = min(ends)
        rows = []
        for s, ways_back in zip(reversed(segs), reversed(back), strict=True):
            way = ways_back[state]
            rows.append({"conv": s["conv"], "id": s["id"], "state": way["from"], "piece": way["audit"] + tail} | dict.fromkeys(("total", "blank", "duplicate", "truncated", "illegal")))
            state, tail = way["from"], ""
        rows[-1] |= {"total": cost, **{c: sum(s[c] for s in segs) for c in ("blank", "duplicate", "truncated")},
                     "illegal": sum(s["illegal"] for s in segs) + illegal_between(segs)}
        return pa.RecordBatch.from_pylist(rows, schema)

    held: list[dict] = []
    for batch in batches:
        for s in batch.to_pylist():
            if held and held[0]["conv"] != s["conv"]:
                yield finish(held)
                held = []
            held.append(s)
    if held:
        yield finish(held)


def illegal_between(segs: list[dict]) -> int:
    return sum(a["last"] + b["first"] not in LEGAL for a, b in zip(segs, segs[1:], strict=False))


def flagged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows (conv, turn, role, text) with n, blank, repeated (an earlier row says the same), short."""
    one = F.lit(" ")
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), one).alias("role"), F.coalesce(F.col(text).cast("string"), one).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = F.expr(r"rtrim(' \u0009\u000A\u000B\u000C\u000D', text)")
    rows = stored(rows.withColumns({"blank": said == "", "short": ~F.right(said, F.lit(1)).isin(".", "!", "?"), "digest": F.sha2(F.concat("role", F.lit("\n"), "text"), 256)}), "turns")
    # blank rows are blank before anything else, so only others look for an earlier one
    spoken = rows.filter("not blank")
    once = spoken.groupBy("conv", "digest").agg(F.bool_or(F.col("turn").isNull()).alias("unset"), F.min("turn").alias("least"))
    once = stored(once, "firsts")
    same = spoken["conv"].eqNullSafe(once["conv"]) & (spoken["digest"] == once["digest"])
    first = F.when(F.col("unset"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    spoken = spoken.join(once, same).select(spoken["conv"], "turn", "role", "text", "n", "blank", "short", (~first).alias("repeated"))
    return spoken.unionByName(rows.filter("blank").drop("digest").withColumn("repeated", F.lit(False)))


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: its id, ``gaps`` (turn numbers left out), ``blank``, ``duplicate``, ``truncated`` (rows, by their first fault), ``illegal`` (neighbours out of order), ``cost``, ``audit``, ``repaired`` (array of role, text)."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    rows = flagged(turns, conv, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(rows.mapInArrow(tidied(segments), SEGMENTS).withColumn("id", F.monotonically_increasing_id()), "segments")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = found.filter("whole").select("conv", *counts, "cost", "audit", "repaired")
    # the texts of a segment stay behind while its ways are folded
    parts = found.filter("not whole")
    head = parts.select("conv", "turn", F.col("roles")[0].alias("role"), F.col("texts")[0].alias("text"), "seq", "id", "ways", "first", "last", *counts)
    place = [F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text", "seq"]
    pieces = stored(head.repartition("conv").sortWithinPartitions(*place).drop("role", "text").mapInArrow(folded, PIECES), "pieces")
    edit = text_rows_udf()
    done = parts.select("id", "turn", "seq", "roles", "texts").join(pieces, "id")
    done = done.select("conv", F.struct("turn", F.col("roles")[0].alias("role"), F.col("texts")[0].alias("text"), "seq").alias("place"), "piece", "total", *counts, edit("piece", "state", "roles", "texts").alias("rows"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("place"), "piece", "rows")))
    long = done.groupBy("conv").agg(ordered.alias("all"), F.max("total").alias("cost"), *[F.max(c).alias(c) for c in counts])
    long = long.select("conv", *counts, "cost", F.array_join("all.piece", "").alias("audit"), F.flatten("all.rows").alias("repaired"))
    t = F.col(turn).cast("long")
    gaps = turns.groupBy(F.col(conv).cast("long").alias("id")).agg(F.coalesce(F.max(t) - F.min(t) + 1 - F.count_distinct(t), F.lit(0)).alias("gaps"))
    both = whole.unionByName(long)
    return gaps.join(both, gaps["id"].eqNullSafe(both["conv"])).select(F.col("id").alias(conv), "gaps", *counts, "cost", "audit", "repaired")


def text_rows_udf():
    """The repaired rows of a segment, by its piece of the audit and the state that it begins in."""

    @F.arrow_udf(f"array<{TURN}>")
    def run(audits: pa.Array, states: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(audits.to_pylist(), states.to_pylist(), roles.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([applied(*row) for row in rows], TURNS)

    return run


def damaged(turns: DataFrame) -> DataFrame:
    """The query's test case: rows of ``conversations`` dropped, emptied, without stops, repeated or given to the user, by a checksum of their place."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    d = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", one)
    rows = turns.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.coalesce("role", one)).alias("role"), F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), d.alias("d"))
    return rows.filter("d <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = repaired(damaged(given)).withColumnRenamed("conv_id", "c")
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    found = found.select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
    ids = given.select("conv_id").distinct()
    rows = ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left").drop("c")
    return rows.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"]).fillna({"repaired_sha256": EMPTY})


#: SHA-256 of the empty string, a fixed value.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

SQL = r"""
with recursive tab as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, tab,
  list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::bigint)) as bytes from conversations, tab),
checked as (select conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as d from keyed),
hurt as (select conv_id, turn, if(d = 4, 'user', role) as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, d from checked where d <> 0),
given as (select conv_id, turn, role, text from hurt union all select conv_id, turn, role, text from hurt where d = 3),
said as (select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said, left(role, 1) as x,
  row_number() over (partition by conv_id order by turn nulls first, role, text) as i from given),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) as k from said),
w as (select *, said = '' as blank, said <> '' and k > 1 as dup, said <> '' and k = 1 and right(said, 1) not in ('.', '!', '?') as short,
  i > 1 and lag(x) over (partition by conv_id order by i) || x not in ('su', 'ua', 'au') as wrong from seen),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate,
  count(*) filter (short) as truncated, count(*) filter (wrong) as illegal, count(*) as n from w group by conv_id),
ins(f, g, letters, price, lines) as (values (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'), (3, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'),
  (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (3, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'II', 6, chr(10) || 'assistant:' || chr(10) || 'user:')),
edits(letter, f, g, x, role) as (values ('D', 0, 0, null, null), ('D', 1, 1, null, null), ('D', 2, 2, null, null), ('D', 3, 3, null, null),
  ('K', 0, 1, 's', null), ('K', 0, 2, 'u', null), ('K', 1, 2, 'u', null), ('K', 3, 2, 'u', null), ('K', 2, 3, 'a', null),
  ('R', 0, 2, 'u', 'user'), ('R', 1, 2, 'u', 'user'), ('R', 3, 2, 'u', 'user'), ('R', 2, 3, 'a', 'assistant')),
r as (select conv_id, 0::bigint as i, 0 as state, {'c': 0::bigint, 'a': '', 'o': ''} as b from counted
  union all
  select r.conv_id, w.i, edits.g, min({'c': (r.b.c + ins.price + case letter when 'D' then 4 when 'R' then 3 else 0 end + if(w.short and letter <> 'D', 3, 0))::bigint, 'a': r.b.a || ins.letters || letter,
    'o': r.b.o || ins.lines || if(letter = 'D', '', chr(10) || coalesce(edits.role, w.role) || ':' || w.text)})
  from r join w on w.conv_id is not distinct from r.conv_id and w.i = r.i + 1 join ins on ins.f = r.state
  join edits on edits.f = ins.g and (letter = 'D' or (not (w.blank or w.dup) and (letter = 'R' or edits.x = w.x)))
  group by r.conv_id, w.i, edits.g),
best as (select r.conv_id, min({'c': r.b.c + ins.price, 'a': r.b.a || ins.letters, 'o': r.b.o || ins.lines}) as b
  from r join counted c on c.conv_id is not distinct from r.conv_id and c.n = r.i join ins on ins.f = r.state where ins.g in (0, 3) group by r.conv_id)
select o.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate, coalesce(c.truncated, 0)::bigint as truncated,
  coalesce(c.illegal, 0)::bigint as illegal, coalesce(best.b.c, 0)::bigint as cost, coalesce(best.b.a, '') as audit, sha256(substr(coalesce(best.b.o, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id left join best on best.conv_id is not distinct from o.conv_id
"""
