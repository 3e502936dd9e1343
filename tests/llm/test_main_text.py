"""op6: driver pages against their markup, pages of other makes, decoding, broken markup."""

import itertools
import random
import re
from html import unescape

import numpy as np
import pytest

from terralog.llm import main_text
from terralog.llm.common import table

SCHEMA = "page_id long, url string, html string, text string"


def plain(html):
    """What stands in the article of a driver page; these have no other marks inside."""
    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def learned(spark):
    return main_text.learned(table(spark, "/root/testdata/sf0.01", "pages"))


def test_driver_pages(spark, learned):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extracted(pages, learned).collect()}
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {k: t for k, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())


PARAGRAPHS = [
    "The council met on Tuesday, and after two hours it agreed to repair the old bridge across the river.",
    "Work will begin in spring; until then, the road stays closed to anything heavier than a bicycle.",
    "Nobody was hurt when the railing gave way, but the noise woke half of the village, people said.",
]
MAIN = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
OTHER = {
    "menu": '<div class="menu"><a href="/">Home</a> <a href="/n">News</a></div>',
    "header": '<header><a href="/">The Paper</a><p>Daily since 1901</p></header>',
    "sidebar": '<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Cat found</a></li><li><a href="/2">Dog lost</a></li></ul></div>',
    "notice": '<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div>',
    "advert": '<div class="ad-banner">Buy two, get one free, only this week!</div>',
    "form": '<form><p>Leave your address and get a letter every week.</p><input name="e"><button>Go</button></form>',
    "comments": '<section class="comments"><p>I have seen this bridge, it was high time they did it.</p><p>So true, and well said.</p></section>',
    "aside": "<aside><p>The bridge was built in 1911 by the brothers who also built the mill.</p></aside>",
    "footer": "<footer><p>Copyright The Paper. All rights reserved.</p></footer>",
}


@pytest.mark.parametrize("name", sorted(OTHER))
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_pages_of_other_makes(learned, name, around):
    page = f"<html><head><title>x</title></head><body>{OTHER['menu']}{{}}{OTHER['footer']}</body></html>"
    main, other = around.format(MAIN), OTHER[name]
    want = "\n\n".join(PARAGRAPHS)
    for html in (page.format(other + main), page.format(main + other)):
        assert main_text.texts_of([html], learned) == [want]


def test_blocks_and_references():
    page = main_text.Page(
        "<div>a&amp;b &eacute;&#x41;&#66;  \n c<p>one<br>two <b>bo</b>ld<p>next<ul><li>x<li>y</ul>tail</div>"
        "<script>if (a < b) '</p>'</script><!-- <p>no</p> --><table><tr><td>1<td>2<tr><td>3</table>3 < 4 &lt; 5"
    )
    assert [t for _, t in page.blocks] == ["a&b éAB c", "one two bold", "next", "x", "y", "tail", "1", "2", "3", "3 < 4 < 5"]


@pytest.mark.parametrize("html", ["", "<", "<p", "<p class='", "<!--", "<script>x", "</p></div>", "<a><a><a>", "&", "&#xFFFFFFF;", "<p>" * 3000])
def test_broken_markup_is_read(learned, html):
    assert isinstance(main_text.texts_of([html], learned)[0], str)


def test_decoding_is_the_best_consistent_choice():
    """Against all labellings of small trees."""
    rng = random.Random(3)
    for _ in range(60):
        page = main_text.Page("")
        for k in range(1, rng.randrange(2, 7)):
            node = main_text.Node(rng.randrange(k), "div", 1, frozenset())
            node.chars = rng.choice([0, 10, 100])
            page.nodes.append(node)
        odds = np.array([rng.uniform(-3, 3) for _ in page.nodes])
        n = len(page.nodes)
        own = [float(o) * (1 + main_text.log1p(x.chars) / 2 if x.chars else 1) for o, x in zip(odds, page.nodes, strict=True)]
        own[0] = 0.0

        def value(states, page=page, own=own, n=n):
            total = 0.0
            for k in range(n):
                above = states[page.nodes[k].parent] if k else "m"
                if above != "m" and states[k] != above:
                    return -np.inf
                chars = page.nodes[k].chars
                total += {"k": own[k], "d": -own[k], "m": (abs(own[k]) if chars else 0) - main_text.MIXED_COST}[states[k]]
            return total

        best = max(itertools.product("kdm", repeat=n), key=value)
        kept = [s == "k" or (s == "m" and own[k] > 0) for k, s in enumerate(best)]
        got = main_text.settled(page, odds)
        text = [k for k in range(n) if page.nodes[k].chars]
        assert [got[k] for k in text] == [kept[k] for k in text]


def test_long_page_stays_linear(learned):
    html = "<article>" + "<p>Some words, and others; they go on.</p>" * 20_000 + "</article>"
    assert main_text.texts_of([html], learned)[0].count("\n\n") == 19_999


def test_table(spark, learned):
    page = f"<nav><a href='/'>x</a></nav><article>{MAIN}</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in main_text.extracted(pages, learned).collect()), key=str)
    text = "\n\n".join(PARAGRAPHS)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert main_text.extracted(pages.filter("page_id > 5"), main_text.learned(pages.filter("page_id > 5"))).collect() == []


def test_training_pages_do_not_thin_out(spark):
    """Few marked pages among many, null and repeated ids, equal rows: as many are learned from as asked for."""
    rows = [(k, "u", f"<article><p>page {k}</p></article>" if k % 20 == 0 else f"<p>{k}</p>", "x") for k in range(2000)]
    got = main_text.training_pages(spark.createDataFrame(rows, SCHEMA), most=20)
    assert len(set(got)) == 20 and all("<article>" in h for h in got)
    rows = [(None if k % 2 else 7, "u", f"<main>page {k}</main>", "x") for k in range(400)]
    got = main_text.training_pages(spark.createDataFrame(rows, SCHEMA), most=20)
    assert len(set(got)) == 20
    rows = [(1, "u", "<main>copy</main>", "x")] * 1000 + [(k, "u", f"<main>page {k}</main>", "x") for k in range(30)]
    got = main_text.training_pages(spark.createDataFrame(rows, SCHEMA), most=20)
    assert len(set(got)) == 20
    assert len(main_text.training_pages(spark.createDataFrame(rows[:1010], SCHEMA), most=20)) == 11


ICONS = ['<svg class="icon"/>', "<svg/>", "<math/>", '<svg class="icon">', "<svg><path d='M0 0'>", "<math>", "<svg><title>x</title><g><path/></g></svg>"]


@pytest.mark.parametrize("icon", ICONS)
@pytest.mark.parametrize("later", ["", "<svg><text>drawn</text></svg>"])
def test_drawings_end_where_they_end(learned, icon, later):
    html = f"<body><header>{icon}<a href='/'>The Paper</a></header><article>{MAIN}</article>{later}{OTHER['footer']}</body>"
    assert main_text.texts_of([html], learned) == ["\n\n".join(PARAGRAPHS)]


def test_formulas_and_drawings_within_text(learned):
    formula = "<math display='block'><mrow><msup><mi>a</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></mrow></math>"
    html = f"<article>{MAIN}<p>It holds that {formula}, <svg><text>no</text></svg>as was said, and so on.</p></article>"
    want = "\n\n".join([*PARAGRAPHS, "It holds that a2=4, as was said, and so on."])
    assert main_text.texts_of([html], learned) == [want]


def test_many_open_drawings_stay_linear(learned):
    html = "<article>" + "<p>Some words, and others; they go on.<svg><g></p>" * 5_000 + "<svg>" * 100_000
    assert main_text.texts_of([html], learned)[0].count("\n\n") == 4_999


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p>See <a title="5" tall">this link</a>', ["See this link"]),
        ("<p data-x=it's>One here.</p>", ["One here."]),
        ('<p class="a>One here.', ["One here."]),
        ("<p a='b\"c' d=\"e'f>g\" h=i\"j>One <b x='>'>here</b>.", ["One here."]),
        ("<p =x ==y a=>One<p a = 'b>c' / d>two", ["One", "two"]),
        ("<textarea a=it's>no</textarea><title x=\"y>z\">no</title><scripted>yes", ["yes"]),
    ],
)
def test_attributes_by_the_standard(html, want):
    assert [t for _, t in main_text.Page(html).blocks] == want


def test_stray_quotes_change_no_text():
    """Tags with odd attributes against the same page without any."""
    rng = random.Random(8)
    pieces = ["a", "b=c", "d='e f'", 'g="h>i"', "j=k'l", 'm=n"o', "p'q", 'r"s', "=t", "u = 'v'", "w=", "/", "x='y\"'", 'title="don\'t"', "z=it's"]
    for _ in range(300):
        words, bare, odd = 0, "", ""
        for _ in range(rng.randrange(1, 12)):
            tag = rng.choice(["p", "b", "a", "div", "span", "/p", "/div", "/a", "br", "li"])
            chosen = [x for x in rng.choices(pieces, k=rng.randrange(4)) if not x.endswith("=")]
            words += 1
            bare += f"<{tag}>w{words} "
            odd += f"<{tag} {' '.join(chosen)}>w{words} "
        assert main_text.Page(odd).blocks == main_text.Page(bare).blocks, odd


def test_names_are_read_from_their_attributes_only():
    assert main_text.marks_of(' title="class=ad" class="post Body-2" data-id=x hidden style="color:red"') == {"post", "body", "hidden"}
    assert main_text.marks_of(" style='display : none' id=nav") == {"hidden", "nav"}
    assert main_text.marks_of(" style='none' alt=\"id='x'\"") == set()


@pytest.mark.parametrize("name", ["noscript", "template"])
def test_unclosed_asides_keep_the_page(learned, name):
    html = f"<body><{name}><p>x</p><article>{MAIN}</article>{OTHER['footer']}"
    assert main_text.texts_of([html], learned) == ["\n\n".join(PARAGRAPHS)]
    closed = f"<body><article>{MAIN}<{name}><p>x</p><{name}>y</{name}><p>z</p></{name}></article>{OTHER['footer']}"
    assert main_text.texts_of([closed], learned) == ["\n\n".join(PARAGRAPHS)]
    many = f"<article>{MAIN}" + f"<{name}>" * 50_000 + "</article>"
    assert main_text.texts_of([many], learned) == ["\n\n".join(PARAGRAPHS)]


def test_foreign_text_belongs_to_the_drawing(learned):
    foreign = "<svg><foreignObject width='5'><div><p>drawn</p></div></foreignObject><text>x</text></svg>"
    assert main_text.texts_of([f"<article>{MAIN}{foreign}</article>"], learned) == ["\n\n".join(PARAGRAPHS)]
    unclosed = f"<body><svg><foreignObject><article>{MAIN}</article>{OTHER['footer']}"
    assert main_text.texts_of([unclosed], learned) == ["\n\n".join(PARAGRAPHS)]
    many = f"<article>{MAIN}" + "<svg><foreignObject>" * 20_000
    assert isinstance(main_text.texts_of([many], learned)[0], str)
