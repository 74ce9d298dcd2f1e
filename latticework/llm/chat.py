r"""Chat formatting: event-sourced reconstruction, in DataFrame operations only.

A log of events (``seq``, ``kind``, ``msg``, ``role``, ``text``) is partitioned by conversation and sorted by sequence.
Events fold into final messages: ``message`` starts a message, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` clears it for the
deltas that follow, ``delete`` removes it for good: whatever comes after it is ignored. A message stands where its first event stands. An
event without ``msg`` gets an id of its own and folds like the others; nothing but the uniqueness of these ids matters. Messages are rendered one by one, then joined in runs of ``RUN`` and only then per conversation, so that no task gathers
the rows of a long conversation one by one.

The template writes a turn as ``<s>role\ntext</s>``. Control strings within a role or text are broken by a backslash and a dot
after their first character, and a backslash is doubled; a line end in a role is a backslash and an n. All that can be undone.
The loss mask lists, for each turn, the code points to skip and those to learn (an assistant's text as it is written).

Edge cases: the result is a row per conversation, so a whole conversation must fit into one row (2 GB), and one text of any length into it; events
before a message's start count as part of it only where it has no start; a null text, role or kind counts as "", "" and ``message``; a null sequence comes first; ties go by role, then text, then by msg;
equal rows without ``msg`` are messages of their own; rows with a null conversation id form one conversation; an empty log gives
no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPENING = r"<(?=/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"
RUN = 512
LEARNED = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"({OPENING})", r"$1\\.")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A doubled backslash before an n isn't a line end, so doubled ones are set aside meanwhile."""
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\."), F.lit(""))), "\\")


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", msg: str = "msg", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: ``conv``, ``seq`` (of the first event), ``role``, ``text``, ``msg``."""
    e = events.select(
        F.col(conv).alias("conv"),
        F.col(seq).cast("long").alias("seq"),
        F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
        F.col(msg).cast("string").alias("msg"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    e = e.withColumn("own", F.when(F.col("msg").isNull(), F.monotonically_increasing_id()))
    at = F.struct("seq", "role", "text", "kind")
    parts = e.groupBy("conv", "msg", "own").agg(
        F.min(F.struct("seq", "role")).alias("first"),
        F.bool_or(F.col("kind") == "delete").alias("gone"),
        F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), at)).alias("start"),
        F.array_sort(F.collect_list(at)).alias("log"),
    )
    live = F.filter("log", lambda x: F.col("start").isNull() | (x >= F.col("start")))
    body = F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    return parts.filter(~F.col("gone")).select("conv", F.col("first.seq").alias("seq"), F.col("first.role").alias("role"), body.alias("text"), "msg")


def render(messages: DataFrame) -> DataFrame:
    """A row per conversation: ``conv``, ``formatted``, ``mask`` (array of skip, learn)."""
    head = F.concat(F.lit("<s>"), escape_role(F.col("role")), F.lit("\n"))
    turn = F.concat(head, escape(F.col("text")), F.lit("</s>"))
    learn = F.when(F.col("role") == LEARNED, F.length(escape(F.col("text")))).otherwise(0)
    rows = messages.select("conv", F.struct("seq", "role", "text", "msg").alias("key"), turn.alias("turn"), F.struct(F.length(head).alias("skip"), learn.alias("learn")).alias("mask"))
    run = F.floor(F.coalesce(F.col("key.seq"), F.lit(-(1 << 62))) / RUN)
    ordered = lambda c: F.array_sort(F.collect_list(c))
    runs = rows.groupBy("conv", run.alias("run")).agg(ordered(F.struct("key", "turn", "mask")).alias("rows"))
    runs = runs.select("conv", "run", F.array_join("rows.turn", "").alias("formatted"), F.col("rows.mask").alias("mask"))
    whole = runs.groupBy("conv").agg(ordered(F.struct("run", "formatted", "mask")).alias("runs"))
    return whole.select("conv", F.array_join("runs.formatted", "").alias("formatted"), F.flatten("runs.mask").alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Back from the rendered text and its mask: ``turns`` (role, text) and ``learned`` (texts under the mask), unescaped."""
    segments = F.slice(F.split("formatted", "</s>"), 1, F.size("mask"))
    body = F.transform(segments, lambda s: F.substring(s, 4, 2147483647))
    cut = lambda b: F.instr(b, "\n")
    turn = lambda b: F.struct(unescape_role(F.substring(b, F.lit(1), cut(b) - 1)).alias("role"), unescape(F.substring(b, cut(b) + 1, F.length(b))).alias("text"))
    learned = F.filter(F.zip_with(segments, "mask", lambda s, m: F.when(m["learn"] > 0, unescape(F.substring(s, m["skip"] + 1, m["learn"])))), lambda x: x.isNotNull())
    return formatted.select("conv", "formatted", F.transform(body, turn).alias("turns"), learned.alias("learned"))


#: Sequence numbers of a turn in the query's log, and the turns that it can number; others count as the nearest of these.
STEPS, FURTHEST = 8, 1 << 58


def logged(turns: DataFrame) -> DataFrame:
    """The query's test case: ``turns`` (conv_id, seq, role, text) as a log of events, last ones first. By a checksum of its place a turn is started and streamed in two deltas, written wrongly and edited, streamed wrongly,
    regenerated and streamed again, or written at once; beside one in four stands a message that is deleted. Null turns come before all others."""
    at = F.when(F.col("seq").isNull(), F.lit(-STEPS * FURTHEST - STEPS)).otherwise(F.greatest(F.least(F.col("seq"), F.lit(FURTHEST)), F.lit(-FURTHEST)) * STEPS)
    given = turns.select("conv_id", at.alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().cast("string").alias("id"))
    half = F.floor(F.length("text") / 2).cast("int")
    one, two = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda step, kind, text, msg=F.col("id"): F.struct((F.col("at") + step).alias("seq"), F.lit(kind).alias("kind"), msg.alias("msg"), text.alias("text"))
    none, wrong = F.lit(""), F.lit("not what was meant")
    streamed = F.array(event(2, "delta", two), event(1, "delta", one), event(0, "message", none))
    edited = F.array(event(3, "edit", F.col("text")), event(0, "message", wrong))
    again = F.array(event(4, "delta", two), event(3, "delta", one), event(2, "regenerate", none), event(1, "delta", wrong), event(0, "message", none))
    gone = F.concat("id", F.lit("-"))
    beside = F.array(event(6, "delta", wrong, gone), event(5, "delete", none, gone), event(0, "message", wrong, gone))
    way = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("at").cast("string")).cast("binary")) % 4
    events = F.when(way == 0, F.concat(streamed, beside)).when(way == 1, edited).when(way == 2, again).otherwise(F.array(event(0, "message", F.col("text"))))
    return given.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "role", "e.*")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select cast(-7 as bigint) conv_id, seq, role, '{probe}' text from values (0L, 'user'), (1L, 'assistant') as t(seq, role)")
    log = logged(given.unionByName(more))
    back = parse(render(fold(log)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\.\2\4', 'g') as escaped from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(escaped) + length(role) + 8)::bigint as formatted_chars
from e group by conv_id
"""
