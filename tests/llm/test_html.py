"""Main text: hand-made pages, a second plain implementation on whole tables, and time on deep pages."""

import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from varspan.llm import html_text
from varspan.llm import queries as Q

LONG = "Real words here. " * 9

PAGES = [
    # class words count as whole names
    (f"<body><div class='layout with-sidebar'><p>{LONG}</p></div></body>", LONG.strip()),
    ("<body><article><div class='post-share-free'><p>kept</p></div></article>", "kept"),
    (f"<body><div class='sidebar'><p>{LONG}</p></div></body>", LONG.strip()),
    (f"<body><div class='sidebar'><p>x y</p></div><p>{LONG}</p></body>", LONG.strip()),
    (f"<body><div class='cookie-notice'>{LONG}</div><p>End.</p></body>", "End."),
    (f"<body><div id='siteFooter'>about us</div><div class='main-nav'>menu here</div><p>{LONG}</p><div class='ad-300x250'>Buy!</div></body>", LONG.strip()),
    # titles in an article's header stay
    ("<article><div class='entry-header'><h1>Title</h1></div><header><p>By</p></header><p>a</p></article>", "Title By a"),
    ("<article><div class='header'><h1>Title</h1></div><p>a</p></article>", "Title a"),
    # quotes open values after '=' alone
    ("<article><p title=it's>It's a fine day</p><p>isn't it</p></article>", "It's a fine day isn't it"),
    ("<article><p it's x=\"a>b\" y='<nav>'>fine</p></article>", "fine"),
    ("<article><a href=/x/>one</a> <p data-x=\"open>two</p></article>", "one two"),
    # short paragraphs and table rows of an unmarked page
    (f"<body><nav>n</nav><p>Short intro.</p><br><br><br><br><p>{LONG}</p><table><tr><td>a</td></tr><tr><td>b</td></tr></table><div><div><p>End.</p></div></div></body>", f"Short intro. {LONG}a b End."),
    (f"<body><p>Intro.</p><div class='advert'>Buy</div><p>{LONG}</p></body>", f"Intro. {LONG.strip()}"),
    # menus without a mark, rights
    (f"<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a>About</a></li></ul><p>{LONG}</p><div><a>x</a> | <a>y</a></div><p>&copy; 2020 Us</p></body>", LONG.strip()),
    (f"<body><p>{LONG}</p><p><a href=1>a whole line of link</a></p><p>{LONG}</p></body>", f"{LONG}a whole line of link {LONG.strip()}"),
    # cards of other articles beside the text
    (f"<body><div><p>{LONG}</p></div><article>card one</article><article>card two</article></body>", f"{LONG}card one card two"),
    ("<article><p>cut of", "cut of"),
    ("<article><p>a</p><section id='comments'><p>First!</p></section><div class='comment-list'>me</div></article>", "a"),
    ("<script>a</script ><main><p>x</p><script>var t='</p>'</script><p>y</p></main>", "x y"),
    ("<nav><ul><li>x<article><p>a</p></article>", "a"),
    ("<div hidden>no</div><p>Short one.</p>", "Short one."),
    ("<div></div>", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html_text.main_text(page) == text


class Plain(HTMLParser):
    """What stands in an article outside menus, scripts and the like, a block a line: enough for the pages of the tables."""

    BLOCK = {"p", "div", "h1", "h2", "h3", "ul", "ol", "li", "article", "section", "br", "table", "tr", "td", "blockquote", "pre"}
    GONE = {"nav", "footer", "aside", "form", "script", "style", "title", "head", "button"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article, self.gone, self.blocks, self.now = 0, [], [], ""

    def cut(self):
        self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.cut()
        self.article += tag == "article"
        if tag in self.GONE:
            self.gone.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
        self.article -= tag == "article"
        if self.gone and self.gone[-1] == tag:
            self.gone.pop()

    def handle_data(self, x):
        if self.article > 0 and not self.gone:
            self.now += x


def plain_text(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    parser.cut()
    return " ".join(b for b in parser.blocks if b)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_tables_against_a_plain_parser(spark, folder):
    pages = pd.read_parquet(f"/root/testdata/{folder}/pages.parquet").set_index("page_id").html
    got = Q.op3_html(spark, f"/root/testdata/{folder}").toPandas()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got.itertuples() if "<article" in (pages[r.page_id] or "") and r.text != plain_text(pages[r.page_id])]
    assert not wrong and (got.n_chars == got.text.str.len()).all()


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "</p>" * 100_000,
        "<p><span>" * 50_000 + "<div>" * 50_000,
        "<span>" * 100_000 + "<div></div>" * 50_000,
        "<nav><article></article>" * 50_000,
        "<div class='related'>x" * 50_000,
        "<a href='x" * 50_000,
        "<" * 200_000,
    ],
)
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 3


def test_repeats_nulls_and_extra_columns(spark):
    rows = [(1, "u", "<p>a</p>", "t", 1), (1, "u", "<p>a</p>", "t", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.op3_html(pages).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.op3_html(pages.limit(0)).count() == 0
