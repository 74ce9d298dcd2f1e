import hashlib
import json
import random
import re

import pytest

from latticework.llm import chat, html, warc
from latticework.llm.common import scratch


# ---- WARC ----
def test_records_come_back_byte_for_byte(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nX: 1", "é" * 1000), (None, "http://d/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as payload", "1 as count")
    a = warc.write(pages, scratch(spark, "test"))
    index = sorted(map(tuple, warc.index(spark, a).collect()), key=str)
    import base64

    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    x = digest("<p>x</p>")
    assert index == sorted([(1, 8, x, "revisit", 2), (2, 8, x, "response", None), (2, 8, x, "revisit", 2), (3, 0, digest(""), "response", None), (None, 0, digest(""), "revisit", 3), (4, 2000, digest("é" * 1000), "response", None)], key=str)
    records = [bytes(r.record) for r in warc.reconstruct(spark, a).collect()]
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        block = rest[: int(fields["Content-Length"])]
        assert len(rest) == len(block) + 4
        body = block.partition(b"\r\n\r\n")[2]
        assert (body == b"") if fields["WARC-Type"] == "revisit" else (digest(body.decode()) == fields["WARC-Payload-Digest"][5:])
    assert len({re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in records}) == 6
    assert spark.read.parquet(a.payloads).count() == 3


def test_small_payloads_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    out = warc.index(spark, warc.write(pages, scratch(spark, "test"), min_bytes=4)).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert warc.index(spark, warc.write(pages.limit(0), scratch(spark, "test"))).count() == 0


def test_damage_is_noticed(spark):
    a = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), scratch(spark, "test"))
    p = spark.read.parquet(a.payloads).selectExpr("address", "cast('abd' as binary) as payload").collect()
    spark.createDataFrame(p, "address string, payload binary").write.mode("overwrite").parquet(a.payloads)
    with pytest.raises(Exception, match="damaged payload"):
        warc.index(spark, a).collect()


# ---- chat ----
def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg string, role string, text string")


def turns(frame):
    return {r.conv: ([(t.role, t.text) for t in r.turns], list(r.learned), r.formatted) for r in chat.parse(chat.render(chat.fold(frame))).collect()}


def test_fold_of_deltas_edits_regenerations(spark):
    rows = [
        (1, 0, "message", "u", "user", "hi"), (1, 1, "message", "a", "assistant", ""), (1, 2, "delta", "a", "assistant", "he"), (1, 3, "delta", "a", "assistant", "llo"),
        (1, 4, "edit", "u", "user", "hi there"), (1, 5, "regenerate", "a", "assistant", None), (1, 6, "delta", "a", "assistant", "good "), (1, 7, "delta", "a", "assistant", "day"),
        (1, 8, "message", "x", "user", "gone"), (1, 9, "delete", "x", "user", None), (1, 10, None, None, None, None),
    ]
    random.Random(1).shuffle(rows)
    got = turns(events(spark, rows))[1]
    assert got[0] == [("user", "hi there"), ("assistant", "good day"), ("", "")] and got[1] == ["good day"]


def test_late_events_and_events_without_an_id(spark):
    rows = [
        (1, 0, "message", "a", "user", "one"), (1, 1, "delete", "a", "user", None), (1, 2, "delta", "a", "user", "late"), (1, 3, "message", "a", "user", "again"),  # a delete is final
        (1, 4, "delta", "b", "assistant", "no "), (1, 5, "delta", "b", "assistant", "start"), (1, 6, "edit", "c", "user", "edited first"),
        (1, 7, "message", None, "user", "same"), (1, 7, "message", None, "user", "same"), (1, 8, "delete", None, "user", "x"),  # events without an id are messages of their own
        (2, 0, "regenerate", "d", "assistant", "x"), (2, 1, "delta", "d", "assistant", "new"), (3, 0, "delete", "e", "user", None),
    ]
    random.Random(2).shuffle(rows)
    got = turns(events(spark, rows))
    assert got[1][0] == [("assistant", "no start"), ("user", "edited first"), ("user", "same"), ("user", "same")]
    assert got[2][0] == [("assistant", "new")] and 3 not in got


def test_every_row_of_the_query_folds(spark, tmp_path):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", None), (None, 2, None, "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.n_turns for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    assert got == {1: 3, None: 1, -7: 2}
    plan = chat.op6_chat_format(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan and "Union" not in plan.split("Aggregate")[0]


def test_the_query_folds_a_log_of_all_kinds(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c} {t} é🎉 end") for c in range(30) for t in range(6)] + [(1, None, "user", "first"), (None, 3, None, None), (2, 1 << 62, "user", "far"), (2, -(1 << 62), "user", "near")]
    log = chat.logged(spark.createDataFrame(rows, "conv_id long, seq long, role string, text string"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate", "delete"} and min(kinds.values()) > 15
    assert log.groupBy("conv_id", "msg").count().filter("count > 1").count() > 100  # most groups fold several events
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.fold(log))).collect()}
    for c in [*range(30), None]:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        assert got[c] == [(r[2] or "", r[3] or "") for r in mine]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\.", ".", "<", "[", "\n", "n", "é🎉", "a", "s>", "/", "$1"]
    rows = [(c, i, "message", None, rng.choice(["user", "assistant", "a\nb", "x\\n</s>"]), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for c in range(150) for i in range(rng.randint(1, 5))]
    got = turns(events(spark, rows))
    for c in range(150):
        mine = [(r[4], r[5]) for r in rows if r[0] == c]
        assert got[c][0] == mine
        assert got[c][1] == [t for r, t in mine if r == "assistant" and t]
        inner = got[c][2][3:].removesuffix("</s>")
        assert inner.count("</s>") == len(mine) - 1 and "[INST]" not in inner


def test_long_conversation_order_and_ties(spark):
    rows = [(1, i, "message", None, "user", str(i)) for i in range(500)] + [(1, 3, "message", None, "user", "3")] + [(None, 0, "message", None, "user", "n"), (2, None, "message", None, "user", "late?"), (2, 0, "message", None, "user", "b"), (2, 0, "message", None, "user", "a")]
    got = turns(events(spark, rows[::-1]))
    assert [t for _, t in got[1][0]] == [str(i) for i in sorted([*range(500), 3])]
    assert got[None][0] == [("user", "n")] and [t for _, t in got[2][0]] == ["late?", "a", "b"]
    assert turns(events(spark, rows).limit(0)) == {}


def test_no_python_on_the_main_path(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat.op6_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- HTML ----
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><h1>Site</h1></header>
<div class="cookie-notice">cookies</div><nav><ul><li><a href=x>menu</a></ul></nav><!-- c --><div id="content" class="col-8 with-sidebar"><div class="post-body">
<h1>Title &amp; more</h1><p>First   para<b>bold</b>&nbsp;x.<p>Second<br>line<ul><li>one<li>two</ul><form><input><p>form</p></form><script>if(a<b)"</p>"</script>
<div class="ad">buy</div></div></div><div class="sidebar"><p>side bar</p></div><section id="comments"><div class=comment><p>a reader says much, much more than the
article itself says, and it is longer by far than all of it</p></div></section><footer>foot</footer></body></html>"""


def test_main_text():
    want = "Title & more\nFirst parabold x.\nSecond line\none\ntwo"
    path, score = html.vote(PAGE)
    assert path == ">html>body>div.col-0.with-sidebar>div.post-body" and score > 0
    assert html.extract(PAGE, None) == html.extract(PAGE, path) == want


@pytest.mark.parametrize("page, want", [("", ""), ("<", "<"), ("a<b c>d", "ad"), ("<!-- x", ""), ("<p>x</article>y", "x\ny"), ('<div class="x', ""), ("&lt;b&gt; <3 &am", "<b> <3 &am"), ("<p>" * 4000 + "x", "x"), ("<div>" * 4000 + "x", "x")])
def test_broken_pages(page, want):
    assert html.extract(page, None) == want


def page_of(host, i, rng, body="post"):
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta omega kappa sigma".split()) + str(rng.randint(0, 99)) for _ in range(n))
    article = [words(rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
    promo = f"<div class='offer'><p>Buy the {host} magazine now and read more every week</p></div>"
    side = "".join(f"<p>{words(60)}</p>" for _ in range(3 * (rng.random() < 0.3)))  # longer than the article on some pages
    html_text = f"<html><body><div class='top'><a href=/>{host}</a></div><div class='{body} n{i}'>{promo}{''.join(f'<p>{a}</p>' for a in article)}</div><div class='extra'>{side}</div></body></html>"
    return html_text, "\n".join(article)


def test_votes_change_pages_and_templates_go(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for host in ("one", "two"):
        for i in range(30):
            page, want[len(rows)] = page_of(host, i, rng, "post" if host == "one" else "entry")
            rows.append((len(rows), f"https://{host}.example/{i}", page))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == want
    alone = {i: html.extract(page, None) for i, _, page in rows}
    assert sum(alone[i] != want[i] for i in want) > 10  # by itself a page often elects its longer side


def test_extraction_against_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        """Blocks of the article element, by the library's parser."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks, self.now = 0, [], ""

        def flush(self):
            if t := " ".join(self.now.split()):
                self.blocks.append(t)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            elif tag == "br":
                self.now += " "
            elif tag not in ("b", "i", "a"):
                self.flush()

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a"):
                self.flush()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.now += data

    rng = random.Random(7)
    rows = []
    for i in range(60):
        words = lambda n: " ".join(rng.choice(["a&amp;b", "x", "<b>bold</b>", "y<i>z</i>", "&eacute;", "w<br>v", "1 &lt; 2", "\n  q"]) for _ in range(n))  # noqa: E731, B023
        blocks = "".join(rng.choice([f"<p>{words(rng.randint(0, 9))}</p>", f"<h2>{words(2)}</h2>", f"<ul><li>{words(3)}</li><li>{words(2)}</li></ul>", f"<div>{words(4)}</div>"]) for _ in range(rng.randint(1, 6)))
        rows.append((i, "http://h.example/", f"<html><head><title>t</title></head><body><nav><a href=/>menu</a></nav><article>{blocks}</article><footer>{words(3)}</footer></body></html>"))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        plain = Plain()
        plain.feed(page)
        plain.flush()
        assert got[i] == "\n".join(plain.blocks), page


def test_deep_pages_cost_no_more_than_their_length():
    page = "<div class='a b c d e f'>" * 20_000 + "text"
    votes, _ = html.votes_of(page)
    assert len({v[0] for v in votes}) == 20_001 and html.extract(page, votes[0][0]) == "text"


def test_consensus_in_spark(spark):
    odd = "<html><body><div class=x><p>" + "promotion " * 30 + "</p></div><div class=post-body><p>short</p></div></body></html>"
    good = "<html><body><div class=post-body><p>" + "long text " * 20 + "</p></div></body></html>"
    rows = [(i, "http://h.example/a", good) for i in range(5)] + [(9, "http://H.example/b", odd), (10, None, odd), (None, "::", None), (11, "http://h.example/c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as text")
    for limit in (10, 0):  # winners broadcast, and joined by a shuffle
        got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages, broadcast_hosts=limit).collect()}
        assert got[9] == ("short", 5) and got[10][0].startswith("promotion") and got[None] == got[11] == ("", 0)
    assert html.main_text(pages.limit(0)).count() == 0
    assert json.dumps(got[0][1])
