import itertools
import random

import pytest

from codeatlas.llm import chat_format, html_mincut
from codeatlas.llm.html_mincut import CLIP, PRIOR, Page, block_odds, main_text, min_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a><li><a>News</a></ul></nav><!-- note <p>no</p> -->
<div id="cookie-banner">We use cookies. <button>OK</button></div><div class="ad">Buy now!</div>
<article><header><h2>Head&shy;line &amp; more</h2></header><p>First   para&nbsp;graph with <b>bo</b>ld,<br>and a <a href=x>link</a>.<p>Second &lt;one&gt;.
<ul><li>Item one</li><li>Item two</li></ul><aside>Related: x</aside><blockquote>Quote.</blockquote><div class="comments"><p>Great post!</p></div></article>
<aside class="sidebar"><p>Side text.</p></aside><form><label>Mail</label><input></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head\xadline & more First para graph with bold, and a link. Second <one>. Item one Item two Quote."


@pytest.mark.parametrize("html", [None, "", "   ", "<nav><a>x</a></nav>", "<script>only", "<!-- open"])
def test_no_text(html):
    assert main_text(html) == ""


def test_cut_off_pages():
    for k in range(len(PAGE)):
        main_text(PAGE[:k])
    assert main_text("<article><p>One &am") == "One &am"
    assert main_text("<article><p>One <b") == "One"
    assert len(main_text("<article>" + "<p>word word word.</p>" * 5000)) == 5000 * 16 - 1


LONG = "The river rose for three days, and on the fourth the bridge, which nobody had mended, gave way under a cart."


@pytest.mark.parametrize("html, want", [
    (f"<body><form action=x><nav><a href=a>Home</a></nav><article><h1>Title</h1><p>One.</p></article><footer>f</footer></form>", "Title One."),
    (f"<body><form id=aspnetForm><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title of it</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><p>{LONG}</p></form>", f"Title of it {LONG} Short one. {LONG} {LONG}"),
    (f"<form><main><p>One.</p></main></form>", "One."),
    (f"<article><p>{LONG}</p><form><label>Your mail</label><input><button>Send</button></form><p>End.</p></article>", f"{LONG} End."),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be. Press <button>OK</button> now.</p><address>Elm Street 5, Hull.</address></article>", "Let x=2 be. Press OK now. Elm Street 5, Hull."),
    (f"<article><p>{LONG}</p><section class=related-work><h2>Related work</h2><p>{LONG}</p></section><div id=share-price><p>It fell, by ten.</p></div><section id=alerts><p>Sirens, at noon.</p></section><section class='ad-hoc-queries'><p>{LONG}</p></section></article>", f"{LONG} Related work {LONG} It fell, by ten. Sirens, at noon. {LONG}"),
    (f"<article><p>{LONG}</p><div class=related><a href=a>One thing</a><br><a href=b>Another</a></div><div class='share-buttons'><a href=x>Post</a></div><div class='ad-slot'>{LONG}</div><div id=comments><p>{LONG}</p><article class=comment><p>{LONG}</p></article></div></article>", LONG),
    (f"<html><head><title>t</title><body><main><p>One.</p></main>", "One."),
    (f"<body><header><h1>The Daily</h1><p>News since 1901.</p></header><div class=post><header><h2>Title here</h2></header><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", f"Title here {LONG} {LONG}"),
    (f"<body><div hidden><p>{LONG}</p></div><div class=cookie-notice>{LONG}</div><p>{LONG}</p><p>{LONG}</p>", f"{LONG} {LONG}"),
])
def test_parts_of_pages(html, want):
    assert main_text(html) == want


SOUP = f"""<body><div class=c1><div><a href=/>Start</a></div><div><a href=/n>News</a></div><div><a href=/s>Sport</a></div></div>
<div class=x9><div>{LONG}</div><div>Not yet</div><div>{LONG}</div><div>So it went</div><div>{LONG}</div></div>
<div class=z><div><a href=/i>Imprint</a> | <a href=/p>Privacy</a></div><div>&copy; 2020 | all | that</div></div>"""


def test_cut_rights_the_classifier():
    """Without one telling name: short paragraphs look like frame by themselves, and are content among content."""
    page = Page(SOUP)
    odds = block_odds(page, PRIOR)
    side = min_cut(odds, page.edges(1.5))
    wrong = [b.text for b, o, s in zip(page.blocks, odds, side) if (o > 0) != s]
    assert wrong and set(wrong) <= {"Not yet", "So it went"}
    assert main_text(SOUP) == f"{LONG} Not yet {LONG} So it went {LONG}"


def test_whole_text_is_the_cheapest_of_all_labellings():
    """Brute force over pages of few blocks and regions; the cheapest labelling's blocks, decoded and joined, are the text."""
    r = random.Random(5)
    inner = [f"<p>{LONG}</p>", "<p>Not yet</p>", "<p>It, is so.</p>", "<li><a href=x>Go on</a>", "<h2>A heading</h2>", "<p>a | b | c</p>", "<div class=related><p>More, of it.</p></div>", "<form><p>Name</p></form>", "<nav>x</nav>", "<div class=notice>Mind &amp; go.</div>"]
    for _ in range(150):
        parts = [r.choice(inner) for _ in range(r.randrange(1, 6))]
        html = "<body>" + "".join(parts[:2]) + r.choice(("<article>", "<div class=post>", "<div>")) + "".join(parts[2:])
        page = Page(html)
        nodes, edges, one_way = [*block_odds(page, PRIOR), *(x for x, _ in page.regions)], page.edges(1.5), page.one_way()
        cost = lambda s: sum(-o if x and o < 0 else o if o > 0 and not x else 0 for o, x in zip(nodes, s)) + sum(c for i, j, c in edges if s[i] != s[j]) + sum(c for i, j, c in one_way if s[i] and not s[j])  # noqa: E731, B023
        every = {s: cost(s) for s in itertools.product((False, True), repeat=len(nodes))}
        least = min(every.values())
        best = {" ".join(b.text for b, kept in zip(page.blocks, s) if kept) for s, c in every.items() if c < least + 1e-9}
        assert main_text(html) in best, html
        assert all(abs(o) <= CLIP or b.frame for b, o in zip(page.blocks, nodes))


def test_deep_nesting_takes_linear_time():
    import time

    def seconds(html):
        began = time.perf_counter()
        main_text(html)
        return time.perf_counter() - began

    for piece in ("<div>x ", "<b><p>x ", "<ul><li>x", "<article><p>One, two. ", "<div class=related><p>x</p>", "</p></div>", "<p>w. "):
        seconds(piece * 500)
        assert seconds(piece * 32_000) < 20, piece


def test_weights_come_from_markup_and_hold_elsewhere(spark):
    """Fitted on pages with telling markup, right on pages without any."""
    r = random.Random(3)
    text = lambda n: (" ".join(r.choice("sol mar vent, luz, rio alto casa".split()) for _ in range(n)) + ".").capitalize()
    made = []
    for k in range(60):
        body = "".join(f"<p>{text(r.randrange(3, 40))}</p>" for _ in range(r.randrange(3, 8)))
        links = "".join(f"<li><a href=x>{text(2)}</a></li>" for _ in range(5))
        made.append((k, f"<nav><ul>{links}</ul></nav><article>{body}</article><footer>&copy; {text(2)}</footer>"))
    df = spark.createDataFrame([(k, "u", h) for k, h in made] * 2, "page_id long, url string, html string")
    w = html_mincut.sample_weights(df, 40)
    assert (w != PRIOR).any() and (w == html_mincut.sample_weights(df, 40)).all()
    assert main_text(SOUP, w) == f"{LONG} Not yet {LONG} So it went {LONG}"
    for _, h in made:
        assert main_text(h.replace("article>", "div>").replace("nav>", "div>").replace("footer>", "div>"), w) == main_text(h, w)
    assert (html_mincut.sample_weights(df.limit(0), 40) == PRIOR).all()


def test_cut_is_minimal():
    r = random.Random(8)
    for _ in range(200):
        n = r.randrange(1, 8)
        odds = [r.choice((-1, 1)) * r.random() * 3 for _ in range(n)]
        edges = [(i, j, r.random() * 2) for i in range(n) for j in range(i) if r.random() < 0.5]
        one_way = [(i, j, r.random() * 2) for i in range(n) for j in range(n) if i != j and r.random() < 0.2]
        cost = lambda s: sum(-o if o < 0 and x else o if o > 0 and not x else 0 for o, x in zip(odds, s)) + sum(c for i, j, c in edges if s[i] != s[j]) + sum(c for i, j, c in one_way if s[i] and not s[j])  # noqa: E731, B023
        assert abs(cost(min_cut(odds, edges, one_way)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-9


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "<article><p>A b c.</p></article>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_mincut.extract(pages).collect()}
    assert out[1, "u"][0] == main_text(PAGE) and out[1, "u"][1] == len(main_text(PAGE))
    assert out[2, None] == ("", 0) and out[None, "v"] == ("A b c.", 6)
    assert html_mincut.extract(pages.limit(0)).count() == 0
    assert (html_mincut.fit([]) == PRIOR).all()


def test_chats_match_brute_force(spark):
    r = random.Random(6)
    threads = {}
    for k in range(60):
        base = list(threads[r.choice(list(threads))]) if threads and r.random() < 0.7 else []
        base = base[: r.randrange(len(base) + 1)] + [(r.choice(("user", "assistant", None)), r.choice(("hi", "", None, "ok\nthen", "1:a|"))) for _ in range(r.randrange(3))]
        if base:
            threads[k] = base
    rows = [(k, i, role, text, 0) for k, t in threads.items() for i, (role, text) in enumerate(t)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last int")
    want = {}
    for k, t in threads.items():
        if not any(len(u) > len(t) and u[: len(t)] == t for u in threads.values()) and k == min(j for j, u in threads.items() if u == t):
            want[k] = (len(t), sum(u == t for u in threads.values()), "".join(f"<|im_start|>{a or ''}\n{b or ''}<|im_end|>\n" for a, b in t))
    got = {x["conv_id"]: (x["n_turns"], x["n_copies"], x["chat"]) for x in chat_format.maximal(df).collect()}
    assert got == want
    assert chat_format.maximal(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, None, "user", "x"), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    assert [(x["conv_id"], x["n_turns"]) for x in chat_format.maximal(nameless).collect()] == [(None, 2)]


def test_long_conversations_take_linear_time(spark):
    import time

    n = 50_000
    df = spark.range(n).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", "concat('t', id div 2) AS text").unionByName(spark.sql("SELECT 2L AS conv_id, 0L AS turn, 'user' AS role, 't0' AS text"))
    began = time.perf_counter()
    got = chat_format.maximal(df).collect()
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got] == [(0, n // 2, 2)] and time.perf_counter() - began < 60


def test_repeated_turns_and_swapped_nulls(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, 0, "u", "x"), (3, 0, None, "u"), (4, 0, "u", None), (5, 0, "", "u"), (5, 1, "a", "b"), (6, 0, "a", "b"), (6, 1, "", "u")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat_format.maximal(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (2, 1), 3: (1, 1), 4: (1, 1), 5: (2, 1), 6: (2, 1)}


PAIR = ["The committee met on Tuesday to discuss the budget for the coming year, and after several hours of debate it agreed on a plan that nobody had expected.", "Residents who had gathered outside the hall said that they were pleased, although some of them wondered how the town would pay for it in the end."]
TEXT, SAID = "".join(f"<p>{x}</p>" for x in PAIR), " ".join(PAIR)


@pytest.mark.parametrize("inner", ["<article>%s</article>", '<div class="entry">%s</div>'])
@pytest.mark.parametrize("name", "has-sidebar no-sidebar content-sidebar with-nav nav-fixed modal-open ad-free cookies-accepted layout-nav-left".split())
def test_wrappers_named_after_a_frame_are_heard(name, inner):
    html = f'<html><body><nav><a href="/">Home</a></nav><div class="{name}">{inner % TEXT}</div><footer>Copyright 2020</footer></body></html>'
    assert main_text(html) == SAID


@pytest.mark.parametrize(("html", "want"), [
    (f'<article>{TEXT}<div class="notice">Please accept our new terms of service.</div>{TEXT}</article>', f"{SAID} {SAID}"),
    (f'<article>{TEXT}<div aria-label="Advertisement"><p>Buy the new phone today, with a discount for readers.</p></div></article>', SAID),
    (f"<main hidden>{TEXT}</main><p>{PAIR[0]}</p>", PAIR[0]),
    (f'<main><article>{TEXT}</article><section class="related"><h2>Related</h2><article><h3><a href="x">Another story</a></h3><p>A short teaser.</p></article></section></main>', SAID),
    (f"<main><article>{TEXT}</article><aside><article>{TEXT}</article></aside></main>", SAID),
    (f'<main><div class="story">{TEXT}</div><div class="related-posts"><article><a href="x">Ten ways to see the sea</a></article></div></main>', SAID),
    (f'<article>{TEXT}</article><div class="comments"><article><p>{PAIR[0]}</p></article></div>', SAID),
    (f'<div class="cookies"><h1>Best cookies</h1>{TEXT}{TEXT}</div>', f"Best cookies {SAID} {SAID}"),
    (f'<div class="cookie-notice"><p>We use cookies to make this site better. By using it you accept them, as our policy says.</p><button>OK</button></div><article>{TEXT}</article>', SAID),
    ("<html><body><p>It rained.</p><p>We stayed in.</p><p>Then it stopped.</p></body></html>", "It rained. We stayed in. Then it stopped."),
    ('<html><body><ul><li><a href="1">Home</a></li><li><a href="2">About us</a></li></ul></body></html>', ""),
    (f'<div class="sidebar"><p>{PAIR[0]}</p></div><div class="content">{TEXT}</div>', SAID),
])
def test_frames_notices_and_teasers(html, want):
    assert main_text(html) == want
