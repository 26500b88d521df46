import numpy as np
import pytest

from parlance.llm import html

LONG = "This paragraph of the article is long enough to be told from the menu, and it goes on for a while."
CASES = {
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=\"ad\">Buy now</div><article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; me</footer></body></html>": f"Head & line\n\n{LONG}\n\nShort.",
    "<article><h1>Only</h1><p><b>Broken<br></article><footer>x</footer>": "Only\n\nBroken",
    f"<body><header>Site</header><main><p>{LONG}<br>second\n  line</p><aside>Side</aside><ul><li>one<li>two</ul><form><input>q<button>go</button></form></main></body>": f"{LONG} second line\n\none\n\ntwo",
    f"<article><header><h1>Title</h1><span>by someone</span></header><p>{LONG}</p><section class='comments'><h2>Comments</h2><p>first! {LONG}</p></section><div id=cookie-notice>We use cookies</div></article>": f"Title\n\n{LONG}",
    f"<div><div class=menu>A B C</div><p>{LONG}</p><p>{LONG}</p><p><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></p></div>": f"{LONG}\n\n{LONG}",
    f"<article><p>{LONG} &#233;&eacute;&nbsp;&lt;b&gt; &amp</p><table><tr><td>a</td><td>b</td></tr></table></article>": f"{LONG} éé <b> &\n\na b",
    f"<nav><ul><li>unclosed<article><p>{LONG}</p></article>": LONG,
    "": "",
    "<nav>only a menu</nav>": "",
    "plain text": "plain text",
    "<![broken <p>x": None,
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    got = html.main_text(page)
    if CASES[page] is not None:
        assert got == CASES[page]


def test_smoothing_and_threshold():
    flat = html.smooth(np.full(9, 3.0), 1.0)
    assert np.allclose(flat, 3.0)
    peak = html.smooth(np.array([0, 0, 9.0, 0, 0]), 1.0)
    assert peak.argmax() == 2 and peak[1] > peak[0] > 0
    at = html.threshold(np.array([1.0, 2, 1, 50, 60, 55]))
    assert 2 < at < 50
    assert html.threshold(np.array([4.0])) == 4.0


def test_rows_nulls_repeats_and_columns(spark):
    big = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None), (2, "v", big, "x"), (3, "w", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.extract(df).collect()), key=str)
    whole = "\n\n".join([LONG] * 3000)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", whole, len(whole)), (3, "w", "", 0)], key=str)
    assert html.extract(df.limit(0)).count() == 0


def words(n):
    return ("river stone mill " * n)[:n].strip()


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_pages_without_an_article_keep_short_first_and_last_blocks(wrap):
    body = [words(n) for n in (30, 90, 110, 700, 800, 750, 650, 100, 60, 45)]
    blocks = f"<h1>{body[0]}</h1>" + "".join(wrap.format(f"<p>{t}</p>") for t in body[1:])
    page = f"<html><body><nav><a href=1>menu</a></nav><div class=x><ul><li>outside</ul></div><div id=content>{blocks}<p><a href=1>back</a> | <a href=2>on</a></p></div><footer>foot</footer></body></html>"
    assert html.main_text(page) == "\n\n".join(body)


def test_a_wrapper_of_one_line_is_no_container():
    assert html.main_text(f"<body><div><p>Short first.</p></div><div><p>{LONG * 5}</p></div><div><p>Short last.</p></div></body>") == f"Short first.\n\n{LONG * 5}\n\nShort last."


@pytest.mark.parametrize("stray", ["<![foo bar]>", "<![ x]>", "<![if !IE]>", "<![]]>", "<![foo[x]]>"])
def test_text_after_a_stray_marked_section_is_kept(stray):
    assert html.main_text(f"<p>{LONG}</p>{stray}<p>{LONG} world</p>") == f"{LONG}\n\n{LONG} world"
    assert html.main_text("<![broken <p>x") == "x"
    assert html.main_text(f"<article><p>a</p>{stray}<p>world</p></article>") == "a\n\nworld"


def test_no_page_stops_the_parser():
    rng = np.random.default_rng(1)
    bits = ["<!", "[", "]", ">", "<", "x", " ", "CDATA", "if", "--", "&", "#", "<p>", "</", "DOCTYPE", "1", "\"", "?", "]]>"]
    for _ in range(20_000):
        html.main_text("".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(1, 14))))


ARTICLE = f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article>"
BODY = f"Title\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("layout", ["layout has-sidebar", "page with-comments", "page-header", "site-header wrapper", "nav-layout", "content sidebar-left", "no-comments", "banner"])
def test_classes_of_the_layout_drop_no_article(layout):
    rest = '<div class="sidebar"><p>Popular now</p></div><div id="comments"><p>First comment, quite short.</p></div>'
    assert html.main_text(f'<body><div class="{layout}">{ARTICLE}{rest}</div></body>') == BODY
    assert html.main_text(f'<body><div id="{layout}"><div>{ARTICLE}</div>{rest}</div><div class="cookie-notice">We use cookies</div></body>') == BODY
    plain = ARTICLE.replace("article>", "div>")
    if "comments" not in layout or "with" in layout or "no-" in layout:
        assert html.main_text(f'<body><div class="{layout}">{plain}{rest}</div></body>') == BODY


def test_reader_comments_go_however_long():
    comments = "<div class='comments'>" + f"<p>I disagree. {LONG * 3}</p>" * 5 + "</div>"
    assert html.main_text(f"<body>{ARTICLE}{comments}</body>") == BODY
    assert html.main_text(f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{comments}</article></body>") == BODY
    assert html.main_text(f"<body><div id=post><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{comments}</body>") == BODY


def test_hints_inside_an_article_and_inside_lines():
    page = f"<article><p>{LONG} and <span class=ad>Buy</span> more</p><div class=promo><p>Offer of the day</p></div><section><p>{LONG}</p></section></article>"
    assert html.main_text(page) == f"{LONG} and more\n\n{LONG}"


def test_ratios_decide(monkeypatch):
    """Constant or reversed ratios give other texts: of articles, containers, and lists of links."""
    links = "".join(f"<li><a href={i}>Topic {i}</a></li>" for i in range(5))
    pages = {
        f"<article><p><b>a</b><i>b</i><u>c</u></p></article>{ARTICLE}": BODY,
        f"<main><h1>Title</h1><ul>{links}</ul><p>{LONG}</p><p>{LONG}</p></main>": BODY,
        f"<body><div><ul><li>one<li>two<li>three</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>": f"{LONG}\n\n{LONG}",
        f"<body><div class=widget><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><p>x</p><p>y</p></div></body>": f"{LONG}\n\n{LONG}\n\n{LONG}",
    }
    for page, text in pages.items():
        assert html.main_text(page) == text
    true = html.ratios
    for other in (lambda lines, sigma: np.ones(len(lines)), lambda lines, sigma: -true(lines, sigma)):
        monkeypatch.setattr(html, "ratios", other)
        changed = [html.main_text(page) != text for page, text in pages.items()]
        assert sum(changed) >= 3


def test_two_links_in_an_article_stay():
    page = f"<article><p>{LONG}</p><p><a href=1>Source one</a></p><p><a href=2>Source two</a></p><p>{LONG}</p></article>"
    assert html.main_text(page) == f"{LONG}\n\nSource one\n\nSource two\n\n{LONG}"


def test_smoothing_and_threshold_against_plain_loops():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for sigma in (0.5, 1.0, 2.5):
            v = rng.uniform(0, 300, n)
            want = []
            reach = int(np.ceil(3 * sigma))
            for i in range(n):
                near = [(np.exp(-0.5 * ((j - i) / sigma) ** 2), v[j]) for j in range(max(0, i - reach), min(n, i + reach + 1))]
                want.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            assert np.allclose(html.smooth(v, sigma), want)
        at = html.threshold(v)
        low, high = v[v <= at], v[v > at]
        if len(low) and len(high):
            assert abs(at - (low.mean() + high.mean()) / 2) < 1e-6


def test_time_is_linear_in_depth():
    import time

    def took(n):
        page = "<div><b><a>" * n + "".join(f"<p>{LONG}</p></i>" for _ in range(n)) + "</div>" * n
        began = time.perf_counter()
        assert html.main_text(page).count("This paragraph") == n
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 24 * max(took(1000), 0.02)
