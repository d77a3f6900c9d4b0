import time
from html.parser import HTMLParser

from lumenquarry.llm.html_text import extracted, main_text
from lumenquarry.llm.queries import op4_html_extraction

LAYOUT = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site name, motto.</p></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, you know. Agree?</p></div>
<div id="wrap"><div class="story"><h2>Head &amp; line</h2><p>First   paragraph, with a <b>bold</b> word &lt;and&gt; more.<p>Second one,
 goes on. It has a <a href="x>y">link</a>.</p><ul><li>An item, of note.<li>Another</ul><div class="ad">Buy, buy, buy. Now!</div><blockquote><p>A quote, said.</p></blockquote></div>
<div class="sidebar"><p>Related stories, here. And there.</p></div></div>
<form><p>Your name, please.</p><input name="a"></form><section id="comments"><p>I disagree, strongly. With all. Of it. And more, more.</p></section><footer>&copy; all, rights.</footer></body></html>"""


def test_layout_with_boilerplate():
    assert main_text(LAYOUT) == "Head & line\nFirst paragraph, with a bold word <and> more.\nSecond one, goes on. It has a link.\nAn item, of note.\nAnother\nA quote, said."


class Article(HTMLParser):
    """The blocks of the tables' articles, read by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("article", "h1", "p", "div", "ul", "li"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p", "div", "ul", "li"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_tables_pages(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        rows = {r.page_id: r for r in op4_html_extraction(spark, folder).collect()}
        for p in spark.read.parquet(f"{folder}/pages.parquet").collect():
            r, wanted = rows[p.page_id], Article()
            wanted.feed(p.html)
            assert r.url == p.url and r.n_chars == len(r.text)
            assert r.text == "\n".join(" ".join(x.split()) for x in wanted.blocks if x.split())


def test_long_and_broken_markup_takes_linear_time():
    began = time.time()
    for page in ("<a " * 350_000, "<p>x</p><img " + 'a="v" ' * 200_000, '<p>x</p><i "' + "\"'" * 500_000, "<p>x</p><b " + "=\"'" * 300_000, "<p>x</p>" + "<script>" * 100_000, "<p>x</p>" + "<button>" * 100_000, "<p>x</p>" + "</div>" * 150_000, "<!--" * 200_000, "<p>x</p>" + "<" * 300_000, "<p>x</p>" + "<select><option>" * 60_000):
        assert main_text(page)[:2] in ("", "x", "x\n")
        assert time.time() - began < 10
        began = time.time()


def test_cut_and_quoted_tags():
    assert main_text('<p>one, two.</p><img alt="x" ' + " ".join('a="v"' for _ in range(24))) == "one, two."
    assert main_text('<p>one, <a title="a > b" href=\'c"d\'>two</a>.</p>') == "one, two."
    assert main_text('<p>one, <a title="open>two</a>.</p><p class="x">three, four.</p>') == "one, two.\nthree, four."
    assert main_text("<p>a < b, it's <b>so</b>.</p>") == "a < b, it's so."


def test_nothing_of_forms_leaks():
    assert main_text("<article><p>One, two.</p><button>Go<div>leak</div></button><p>Three, four.</p></article>") == "One, two.\nThree, four."
    assert main_text("<article><p>One, two.</p><select><option>a<option>b<p>leak</p></select><p>Three, four.</p></article>") == "One, two.\nThree, four."
    assert main_text("<article><p>One, two.</p><div><button>never closed</div><p>Three, four.</p></article>") == "One, two.\nThree, four."


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain text, only.", "<p>", "<script>x", "<!-- never closed", "<a <b> c", "<p>one<br>two</p>", "<div>" * 3000 + "deep, text.", "<p>x.</p>" * 20_000, "<article><p>é &eacute; &#233; &nbsp; &bogus; &am</article>", "<nav>only a menu</nav>"]
    d = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate(pages)] + [(None, "u", "<p>a</p>", 2)], "page_id bigint, url string, html string, text int")
    out = {r.page_id: r.text for r in extracted(d).collect()}
    assert [out[i] for i in (0, 1, 2, 3, 4, 5, 6)] == ["", "", "", "plain text, only.", "", "", ""]
    assert out[8] == "one two" and out[9] == "deep, text." and out[10] == "\n".join(["x."] * 20_000) and out[11] == "é é é &bogus; &am" and out[12] == "" and out[None] == "a"
    assert extracted(d.limit(0)).count() == 0


def _prose(n, seed=0):
    return " ".join(f"Sentence {seed} {i} goes on, and on." for i in range(n))


def test_the_whole_article_whatever_its_sections():
    a, b, c = _prose(20, 1), _prose(6, 2), _prose(3, 3)
    ided = f"<body><nav>x</nav><article><h1>Head</h1><section id=a><p>{a}</p></section><section id=b><p>{b}</p></section><section id=c class=k><p>{c}</p></section></article></body>"
    assert main_text(ided) == f"Head\n{a}\n{b}\n{c}"
    assert main_text(ided.replace("article>", "div>").replace("section", "div")) == f"Head\n{a}\n{b}\n{c}"
    one = f"<body><article><h1>Head</h1><section id=a><p>{a}</p><p>{b}</p></section></article></body>"
    assert main_text(one) == f"Head\n{a}\n{b}"
    lead = f"<body><div class=story><h1>Head</h1><p>A short lead, as usual.</p><div class=body><p>{a}</p><p>{a}</p></div></div></body>"
    assert main_text(lead) == f"Head\nA short lead, as usual.\n{a}\n{a}"
    items = [_prose(5, i) for i in range(8)]
    assert main_text("<body><div><p>An intro, first.</p><ul>" + "".join(f"<li>{x}" for x in items) + "</ul></div></body>") == "\n".join(["An intro, first.", *items])
    rows = "".join(f"<tr><td>{x}</td></tr>" for x in items)
    assert main_text(f"<body><div><p>An intro, first.</p><table><tbody>{rows}</tbody></table></div></body>") == "\n".join(["An intro, first.", *items])


def test_text_outside_the_article_stays_outside():
    a = _prose(20)
    assert main_text(f"<body><div class=links><ul><li>Home<li>News</ul></div><article><p>{a}</p></article><div><p>Imprint, terms.</p></div></body>") == a


def test_names_that_only_hold_a_word_do_not_drop_the_article():
    a = _prose(20)
    page = f"<html><body class='has-sidebar'><nav>x</nav><article class='post comments-open'><header class=entry-header><h1>Head</h1></header><p>{a}</p></article><div class='sidebar'><p>Beside, it.</p></div></body></html>"
    want = f"Head\n{a}"
    assert main_text(page) == want
    assert main_text(page.replace("has-sidebar", "single no-sidebar")) == want and main_text(page.replace("has-sidebar", "sidebar").replace("post comments-open", "widget")) == want
    assert main_text(f"<body><form id=f>{page}</form></body>") == want and main_text(page.replace("<article", "<form><article").replace("</article>", "</article></form>")) == want
    built = f"<body><div class='elementor-widget elementor-widget-theme-post-content'><p>{a}</p></div><div class='widget'><p>Ask us, now.</p></div></body>"
    assert main_text(built) == a and main_text(built.replace("elementor-widget ", "widget ")) == a
    assert main_text(f"<body><div data-id='menu' data-role=search title='class=ad'><p>{a}</p></div><p>More, of it.</p></body>") == f"{a}\nMore, of it."
    comments = f"<body><div><h1>Head</h1><p>{_prose(3)}</p></div><div class=comments><p>{_prose(40)}</p></div></body>"
    assert main_text(comments) == f"Head\n{_prose(3)}"


def test_pages_without_semantic_elements_and_names(spark, sf_dir):
    """The tables' articles are found with article renamed to div, and with all names removed besides."""
    import re

    def wrong(change):
        return sum(main_text(change(p)) != w for p, w in zip(pages, wanted, strict=True)) / len(pages)

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    wanted = [main_text(p) for p in pages]
    renamed = lambda p: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p)
    bare = lambda p: re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", renamed(p))
    assert wrong(renamed) == 0 and wrong(bare) == 0


def test_what_is_not_shown_stays_out():
    a = _prose(8)
    page = f"<body><article><h1>Head</h1><div hidden><p>Secret, one.</p></div><p style='color:red; display: none'>Secret, two.</p><p>{a} <span hidden>three <span>four</span></span>end</p><label>Mail, please</label><div class=author-box><p>She writes, a lot.</p></div></article></body>"
    assert main_text(page) == f"Head\n{a} end"
    assert main_text(page.replace("article>", "div>")) == f"Head\n{a} end"
    assert main_text(f"<body style='visibility:hidden'><p>{a}</p><p data-x=hidden title='hidden'>More, of it.</p></body>") == f"{a}\nMore, of it."


def test_ratios_end_an_article_that_has_no_element(monkeypatch):
    from lumenquarry.llm import html_text

    a = [_prose(6, i) for i in range(5)]
    page = f"<body><div>Buy now, cheap.</div><h1>Head</h1>{''.join(f'<p>{x}</p>' for x in a)}<div><h2>Contact</h2><section><p>Mail us, now.</p></section></div></body>"
    assert main_text(page).split("\n") == ["Head", *a]
    monkeypatch.setattr(html_text, "_smooth", lambda values, radius=1: [1.0] * len(values))
    assert main_text(page).split("\n") == ["Head", *a, "Contact", "Mail us, now."]
