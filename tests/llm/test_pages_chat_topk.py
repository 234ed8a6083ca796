"""HTML extraction, chat formatting and exact top-k against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sunder.llm import chat, html_text, topk
from tests.conftest import DATA
from tests.llm.helpers import same

ARTICLE = "First paragraph of the story with enough words to count & more. Second one with a link inside. Short."
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
{open}<p>First   paragraph of the <b>story</b> with enough
words to count &amp; more.<p>Second one with a <a href="/x">link</a> inside.<p>Short.{close}
<aside class="sidebar"><p>Related things to read on this site today and tomorrow.</p></aside><form><p>Subscribe here</p><input></form>
<div id="comments"><p>A reader says that this is a very long comment about the story.</p></div><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<article><header>", "</header></article>")])
def test_main_text(open_, close):
    assert html_text.extract(PAGE.format(open=open_, close=close)) == ARTICLE


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<nav>only menu</nav>", ""),
        ("plain text", "plain text"),
        ("<article>broken off <p>in the mid", "broken off in the mid"),
        ("<article><p>a&nbsp;b &eacute; &#233;</p></article>", "a b é é"),
        ("<p>x</p>" * 3000, " ".join(["x"] * 3000)),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_edges(html, text):
    assert html_text.extract(html) == text


LONG = "A sentence of the article that goes on for quite a while, so that nobody takes it for a menu or a label. "
HEAD = "<!DOCTYPE html><html><head><title>T</title><script>var x = '<p>no</p>';</script><style>p{}</style></head><body>"
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">About us</a></li></ul></nav>'
FOOT = "<footer><p>All rights reserved by the owner of this site, 2024, everywhere and for ever.</p></footer></body></html>"
P = lambda *names: "".join(f"<p>{LONG}{n}.</p>" for n in names)
T = lambda *names: " ".join(f"{LONG}{n}." for n in names)

#: Pages of many makes, and their main text.
GOLD = [
    (HEAD + MENU + f"<article><h1>Title</h1>{P('a', 'b')}</article>" + FOOT, "Title " + T("a", "b")),
    (HEAD + MENU + f"<main><h1>Title</h1>{P('a', 'b')}</main>" + FOOT, "Title " + T("a", "b")),
    (HEAD + MENU + f"<div id=wrapper><div class=entry><h1>Title</h1>{P('a', 'b', 'c')}</div></div>" + FOOT, "Title " + T("a", "b", "c")),
    (HEAD + f"<div>My site, news for all</div>{MENU}<div><h1>Title</h1>{P('a', 'b', 'c')}</div><div>Powered by a tool</div>" + FOOT, "Title " + T("a", "b", "c")),
    (HEAD + f'<div class="content has-sidebar">{P("a", "b")}</div><div class="sidebar"><p>Things to see</p></div>' + FOOT, T("a", "b")),
    (HEAD + f'<main><div class="post-with-ads">{P("a", "b")}</div></main>' + FOOT, T("a", "b")),
    (HEAD + f'<article><p class="notice">Mind the gap, says a notice<h2>Part</h2><div>{LONG}</div>{P("a")}</article>' + FOOT, f"Part {LONG}{T('a')}"),
    (HEAD + MENU + f"<article>{P('a', 'b')}</article><article>{P('c')}</article>" + FOOT, T("a", "b", "c")),
    (HEAD + MENU + f"<article><p>Short one.</p></article><article>{P('c')}</article><article><h2>Last</h2>{P('d')}</article>" + FOOT, "Short one. " + T("c") + " Last " + T("d")),
    (HEAD + f'<article><p>{LONG}<span style="display: none">hidden words</span> end</p>{P("a")}</article>', f"{LONG}end {T('a')}"),
    (HEAD + f"<article><p>{LONG}<svg><text>axis label</text></svg> end</p>{P('a')}</article>", f"{LONG}end {T('a')}"),
    (HEAD + f'<article><p>{LONG}<span class="share">Share on a site</span> end</p>{P("a")}</article>', f"{LONG}end {T('a')}"),
    (HEAD + f"<article><p>{LONG}<p>two<p>three<ul><li>one<li>two</ul>{P('a')}</article>", f"{LONG}two three one two {T('a')}"),
    (HEAD + MENU + f"<article>{P('a')}<table><tr><th>Year<th>Sum<tr><td>2020<td>12</table>{P('b')}</article>" + FOOT, T("a") + " Year Sum 2020 12 " + T("b")),
    (HEAD + f"<article>{P('a')}<blockquote>Short quote</blockquote><pre>x  =\n 1</pre>{P('b')}</article>", T("a") + " Short quote x = 1 " + T("b")),
    (HEAD + f'<article>{P("a")}<ul><li><a href="/1">Another story of the site to read</a></li><li><a href="/2">One more story of it</a></li></ul>{P("b")}</article>', T("a", "b")),
    (HEAD + f'<article>{P("a")}<div class="advertisement">Buy this thing today, it is as good as new and costs nothing at all for you, dear reader of articles</div>{P("b")}</article>', T("a", "b")),
    (HEAD + f'<article>{P("a")}</article><section id="comments"><div class="comment">{P("x", "y", "z")}</div></section>' + FOOT, T("a")),
    (HEAD + f'<form id="aspnet">{MENU}<article>{P("a", "b")}</article></form>' + FOOT, T("a", "b")),
    (HEAD + f'<form id="all">{MENU}<div>{P("a", "b")}</div></form>' + FOOT, T("a", "b")),
    (HEAD + "<nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a>" + f"<article>{P('a', 'b')}</article>", T("a", "b")),
    (HEAD + f"<header><h1>Site name</h1></header><article><header><h1>Title</h1></header>{P('a')}<footer>By someone</footer></article>", "Title " + T("a")),
    (HEAD + f'<div role="banner">Site name and motto</div><div role="main">{P("a", "b")}</div><div role="contentinfo">Owner</div>', T("a", "b")),
    (HEAD + f'<div class="cookie-notice"><p>We use cookies for many good reasons, all of which are told in our policy, please agree.</p></div><div>{P("a", "b")}</div>', T("a", "b")),
    (HEAD + f"<article>{P('a')}<aside>Related matter aside</aside>{P('b')}<details><summary>More</summary>{P('c')}</details></article>", T("a", "b") + " More " + T("c")),
    (HEAD + f"<article><p>{LONG}</div></section></b> still here{P('a')}", f"{LONG}still here {T('a')}"),
    (HEAD + f"<table><tr><td>{MENU}</td><td>{P('a', 'b')}</td></tr></table>" + FOOT, T("a", "b")),
    (HEAD + f"{LONG}<br>{LONG}<br><br>{LONG}" + FOOT, (LONG * 3).strip()),
    (HEAD + f"<div><section>{P('a')}</section><section><h2>Sub</h2>{P('b')}</section></div>" + FOOT, T("a") + " Sub " + T("b")),
    (HEAD + f"<article><p>{LONG}<b>bold<p>next</b> part</p>{P('a')}</article>", f"{LONG}bold next part {T('a')}"),
    (HEAD + f"<article><p>{LONG}&amp;&nbsp;&eacute;&#x41;&lt;p&gt;</p>{P('a')}</article>", f"{LONG}& éA<p> {T('a')}"),
    (HEAD + f"<article>{P('a')}<figure><img src=x><figcaption>A caption</figcaption></figure>{P('b')}</article>", T("a") + " A caption " + T("b")),
    (HEAD + f'<div hidden><p>{LONG}</p></div><div>{P("a", "b")}</div><template><p>{LONG}</p></template><noscript>Turn it on</noscript>', T("a", "b")),
    (HEAD + f'<aside><article class="teaser"><p>A teaser of another story that can be read elsewhere</p></article></aside><article>{P("a", "b")}</article>', T("a", "b")),
    (HEAD + '<div class="sidebar"><p>Only a sidebar is here to read.</p></div>', "Only a sidebar is here to read."),
]


def word_f1(got, want):
    got, want = Counter(got.split()), Counter(want.split())
    both = sum((got & want).values())
    return 2 * both / max(1, sum(got.values()) + sum(want.values()))


def test_gold_pages():
    scores = [word_f1(html_text.extract(page), " ".join(text.split())) for page, text in GOLD]
    wrong = {k: (round(s, 3), html_text.extract(GOLD[k][0])) for k, s in enumerate(scores) if s < 1}
    assert len(GOLD) >= 30 and not wrong


def test_ratios_decide(monkeypatch):
    """Without the clusters, boxes of little text that no tag or class tells apart would stay."""
    page, text = GOLD[3]
    assert html_text.extract(page) == " ".join(text.split())
    monkeypatch.setattr(html_text, "threshold", lambda values: 0.0)
    assert "My site" in html_text.extract(page) and "Powered by" in html_text.extract(page)
    assert sum(html_text.extract(p) != " ".join(t.split()) for p, t in GOLD) >= 2


def test_very_long_page():
    page = HEAD + MENU + "<article>" + P("a") * 20_000 + "</article>" + FOOT
    assert html_text.extract(page) == " ".join([T("a")] * 20_000)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").selectExpr("*", "1 text", "2 n_chars")
    out = html_text.extract_pages(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        assert r.n_chars == len(r.text) and "<" not in r.text and "\n" not in r.text and r.n_chars > 0
    rows = [(None, None, None), (1, "u", "<p>a</p>"), (1, "u", "<p>a</p>")]
    same([tuple(r) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()], [(None, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1)])
    assert html_text.extract_pages(pages.limit(0)).collect() == []


def test_smoothing_and_threshold():
    assert html_text.smooth([1.0] * 7) == pytest.approx([1.0] * 7)
    assert html_text.threshold([1, 2, 1, 50, 60]) == pytest.approx((4 / 3 + 55) / 2)


CHAT = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    seqs = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: -1 if y[0] is None else y[0])] for c, x in convs.items()}
    out = []
    for c, s in seqs.items():
        if any(d != c and t[: len(s)] == s and (len(t) > len(s) or d < c) for d, t in seqs.items()):
            continue
        said = "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in s)
        out.append((c, len(s), said))
    return out


def test_chat(spark):
    r = random.Random(3)
    rows = []
    for c in range(60):
        n = r.randint(1, 6)
        seed = r.randint(0, 6)
        g = random.Random(seed)
        rows += [(c, k, ["user", "assistant"][k % 2], f"t{g.randint(0, 1)}-{k}" if g.random() < 0.8 else None) for k in range(n)]
    rows += rows[:20] + [(None, 0, "user", "x"), (900, None, None, ""), (901, 5, "unknown", "")]
    turns = spark.createDataFrame(rows, CHAT).selectExpr("*", "1 pos", "2 h", "3 p1").repartition(5)
    same([tuple(x) for x in chat.format_chats(turns).collect()], brute_chat(rows))
    plan = chat.format_chats(turns)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_chat_long_texts(spark):
    rows = [(1, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000), (2, 1, "assistant", "y " * 100_000), (3, 0, "user", "x" * 299_999 + "z")]
    same([tuple(x) for x in chat.format_chats(spark.createDataFrame(rows, CHAT)).collect()], brute_chat(rows))


VEC = "vec_id long, embedding array<float>"


def brute_top(rows, k=10):
    """Rows are rows of their own, whatever their ids."""
    rows = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    z = [[math.floor(x) * 1024 + math.floor((x - math.floor(x)) * 1024) for x in v] for _, v in rows]
    out = []
    for n, (q, _) in enumerate(rows):
        if q % 100 == 0:
            held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
            s = sorted((-held(sum(a * b for a, b in zip(z[n], c, strict=True))), i) for j, ((i, _), c) in enumerate(zip(rows, z, strict=True)) if j != n and len(c) == len(z[n]))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


def test_top_k_repeated_ids(spark, monkeypatch):
    """Rows that share an id, equal ones too, are candidates and queries of their own."""
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    r = random.Random(8)
    rows = [(r.choice([0, 1, 2, 3, 100, 200]), [float(r.randint(-2, 2)) for _ in range(4)]) for _ in range(150)]
    rows += rows[:5] * 14
    for n in (1, 5):
        vectors = spark.createDataFrame(rows, VEC).repartition(n)
        same([tuple(x) for x in topk.exact_top_k(vectors).collect()], brute_top(rows))


def test_top_k_saves_work(monkeypatch):
    """Of clustered rows, most tiles are skipped; of others, most entries never see their last slice."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    for spread, share in ((0.05, 0.3), (10.0, 0.99)):
        centre = r.normal(size=(16, 32))
        rows = (centre[r.integers(0, 16, 4000)] + spread * r.normal(size=(4000, 32))) / max(1, spread)
        table = pa.table({"r_vec_id": np.arange(4000), "r_vh": np.arange(4000), "r_times": np.ones(4000, np.int64), "r_embedding": pa.array(rows.tolist())})
        scores = np.floor(rows[:20] * 1024) @ np.floor(rows * 1024).T
        cutoff = np.sort(scores, axis=1)[:, -11]
        queries = pa.table({"vec_id": np.arange(20), "vh": np.arange(20), "embedding": pa.array(rows[:20].tolist()), "cutoff": pa.array(cutoff.astype(np.int64))})
        done = [0]
        part = topk._Meet.part
        monkeypatch.setattr(topk._Meet, "part", lambda self, who, tile, s: done.__setitem__(0, done[0] + len(who) * (tile.stop - tile.start) * (s.stop - s.start)) or part(self, who, tile, s))  # noqa: B023
        out = topk._resolve(10, 4)(queries, table)
        monkeypatch.undo()
        assert out.num_rows == 200 and done[0] < share * 20 * 4000 * 32
        want = sorted((q, int(s[c])) for q, s in enumerate(scores) for c in [x for x in np.argsort(-s, kind="stable") if x != q][:10])
        assert sorted(zip(out["query_id"].to_pylist(), out["score"].to_pylist(), strict=True)) == want


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e18])
def test_top_k(spark, scale, monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("ROW_BLOCK", 100), ("TILE", 2)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(1)
    base = [[float(np.float32(r.randint(-3, 3) * scale)) for _ in range(5)] for _ in range(40)]
    rows = [(k, r.choice(base)) for k in range(600)]
    rows += [(601, None), (602, [1.0, None, 1.0, 1.0, 1.0]), (700, [float("nan")] * 5), (603, [float("inf")] * 5), (None, base[0]), (5, base[3]), (800, [1.0, 2.0]), (801, [2.0, 2.0]), (900, [])]
    vectors = spark.createDataFrame(rows, VEC).selectExpr("*", "1 dim", "2 score").repartition(4)
    same([tuple(x) for x in topk.exact_top_k(vectors).collect()], brute_top(rows))


def test_top_k_few_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], VEC)
    same([tuple(x) for x in topk.exact_top_k(vectors).collect()], [(0, 1, 1, 2048 * 1024), (0, 2, 2, 2048 * 1024)])
    assert topk.exact_top_k(vectors.limit(0)).collect() == []
