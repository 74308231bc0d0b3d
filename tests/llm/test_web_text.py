import pytest

from scriptorium.llm import web_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="page"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav>
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Head&amp;line</h1></header><p><b>One  two
three<br><p>Four &eacute;&#8217;s <i>fi</i>ve&nbsp;six</p><ul><li>item 1<li>item 2</ul>
<aside>Related</aside><form><input name="q">Search</form><div class="share">Share me</div><blockquote>Said</blockquote>a &lt; b
<section class="comments"><p>First!</p></section></article>
<div class="sidebar">Side</div><!-- c --><footer>&copy; host</footer></body></html>"""


def test_article():
    assert web_text.main_text(PAGE) == "Head&line\n\nOne two three\n\nFour é’s five six\n\nitem 1\n\nitem 2\n\nSaid\n\na < b"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a <span>b</span></div>c", "a b\n\nc"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut &amp", "cut &"),
        ("<article><p>a</p><scr", "a"),
        ("<main><p>a</p></main><div>b</div>", "a"),
        ("<article>a</article><article class='comment'>b</article><article>c</article>", "a\n\nc"),
        ("<article><p>2 < 3 and 4 > 1</p></article>", "2 < 3 and 4 > 1"),
        ("<article><table><tr><td>x<td>y</table></article>", "x\n\ny"),
        ("<article><script>if (a</b) {}</script><p hidden>h</p><p>t</p></article>", "t"),
        ("<body><form><p>f</p></form><p>t</p></body>", "t"),
        ("<article><p title='a > b'>q</p></article>", "q"),
        ("<article><header class='entry-header'><h1>h</h1></header><p>t</p></article>", "h\n\nt"),
        ("<div class='content has-sidebar'><article>t</article><div class='widget-area'>w</div></div>", "t"),
        ("<div class='sidebar-right'><article>t</article></div>", "t"),
        ("<article>t</article><div class='related'><article>teaser</article></div><section id='comments'><article>c</article></section>", "t"),
        ("<div class='site-header'>s</div><div><p>t</p></div><div class='page-footer'>f</div>", "t"),
        ("<article><p class='leadership'>loaded</p></article>", "loaded"),
        ("<article><p class='social-sciences-side note'>a</p><p class='search-results'>b</p><section class='related-work'><p>c</p></section></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p><div class='related-links'>b</div><div class='share_buttons-2'>c</div><div id='ad-top-right'>d</div></article>", "a"),
        ("<main><h1>Headline</h1><p>Lead…</p><article><p>Body</p></article><p>After</p></main>", "Headline\n\nLead…\n\nBody"),
        ("<main><div><header><h1>Head</h1></header></div><div><p><a href=x>Home</a></p><article>Body</article></div></main>", "Head\n\nBody"),
        ("<h1>Site</h1><article>Body</article>", "Body"),
        ("<main><h1>List</h1><article>one</article><article>two</article></main>", "one\n\ntwo"),
        ("<main><nav><p>menu</p></nav><form><p>f</p></form><div class=ad><p>buy</p></div><p>Lead</p><article>Body</article></main>", "Lead\n\nBody"),
    ],
)
def test_pages(html, text):
    assert web_text.main_text(html) == text


def test_deep_and_long():
    assert web_text.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(web_text.main_text("<p>" + "word " * 200_000)) == 999_999


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int, text string")


def test_site_template_is_deleted(spark):
    """What a site repeats goes where no article is marked; what an article repeats stays."""
    def page(i):
        return f"<body><div class=x><p>Welcome to our site</p></div><div><p>Story {i}</p><p>Shared licence</p></div></body>" if i % 2 else f"<body><div class=x><p>Welcome to our site</p></div><article><p>Welcome to our site</p><p>Tale {i}</p></article></body>"

    rows = [(i, "https://Big.example.com/p", page(i), 1, "t") for i in range(20)] + [(50 + i, f"https://h{i}.example.com/", "<body><p>Welcome to our site</p></body>", 1, "t") for i in range(8)]
    got = {r.page_id: r.text for r in web_text.extract(pages_of(spark, rows)).collect()}
    assert got[0] == "Welcome to our site\n\nTale 0"
    assert got[1] == "Story 1"
    assert all(got[50 + i] == "Welcome to our site" for i in range(8))
    loose = {r.page_id: r.text for r in web_text.extract(pages_of(spark, rows), share=0.9).collect()}
    assert loose[1] == "Story 1\n\nShared licence"


def test_counts_against_brute_force(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<body><div><p>note {i % 4}</p></div><p>own {i}</p></body>", 1, "t") for i in range(60)] + [(None, None, None, None, None)] * 2
    seen = {}
    for _, url, html, _, _ in rows:
        host = url.split("/")[2] if url else ""
        seen.setdefault(host, []).append(web_text.template_candidates(html))
    want = {h: {x for s in sets for x in s if sum(x in t for t in sets) >= max(5, 0.2 * len(sets))} for h, sets in seen.items()}
    got = {r.host: set(r.template) for r in web_text.templates(pages_of(spark, rows), 0.2, 5).collect()}
    assert got == {h: t for h, t in want.items() if t}


def test_odd_rows(spark):
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (2, None, "<p>y"), (None, "nonsense", None), (3, "http://a/", "")]
    got = web_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "y", 1), (3, "", 0)]
    assert web_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_recurring_chrome_inside_articles(spark):
    """Blocks of links, controls and edges that recur go from articles; repeated prose and copies of whole articles stay."""
    def page(i):
        return (
            "<body><article><div><p>Please read our notice</p></div>"
            f"<h1>Tale {i}</h1><p>Tale {i} told</p><p>Shared licence</p><ul><li><a href=x>Send</a><li><a href=y>Post it</a></ul><p>And {i} so on at some length</p>"
            "<div>Get our letter <input name=mail></div></article></body>"
        )

    copy = "<body><article><div><p>First half</p></div><div><p>Other half</p></div></article></body>"
    rows = [(i, "https://a.example.com/p", page(i), 1, "t") for i in range(20)] + [(50 + i, "https://b.example.com/p", copy, 1, "t") for i in range(8)]
    got = {r.page_id: r.text for r in web_text.extract(pages_of(spark, rows)).collect()}
    assert got[3] == "Tale 3\n\nTale 3 told\n\nShared licence\n\nAnd 3 so on at some length"
    assert got[50] == "First half\n\nOther half"


def test_a_lead_that_the_site_repeats_is_template(spark):
    rows = [(i, "https://a.example.com/p", f"<main><h1>Our site</h1><p>Lead {i}</p><article>Story {i}</article></main>", 1, "t") for i in range(20)]
    got = {r.page_id: r.text for r in web_text.extract(pages_of(spark, rows)).collect()}
    assert got == {i: f"Lead {i}\n\nStory {i}" for i in range(20)}


def test_a_site_without_names(spark):
    """Menus, notices and footers of plain elements: the method alone changes every page, and leaves what is the page's own."""

    def page(i):
        menu = "".join(f"<li><a href=/{k}>Part {k}</a>" for k in range(6))
        return f"<body><div><ul>{menu}</ul></div><div><p>Read our notice</p></div><div><h2>Title {i}</h2><p>Story {i} is told</p><p>And {i} ends</p></div><div><p>Made by us</p></div></body>"

    rows = [(i, "https://a.example.com/p", page(i), 1, "t") for i in range(40)] + [(100 + i, f"https://h{i}.example.com/", page(i), 1, "t") for i in range(4)]
    got = {r.page_id: r.text for r in web_text.extract(pages_of(spark, rows)).collect()}
    assert all(got[i] == f"Title {i}\n\nStory {i} is told\n\nAnd {i} ends" for i in range(40))
    assert all(got[100 + i].startswith("Part 0") and "Made by us" in got[100 + i] for i in range(4))  # too few pages to be a site


def test_template_of_a_section(spark):
    rows = [(i, f"https://a.example.com/{'news' if i < 6 else f's{i}'}/p", f"<body>{'<div>News desk</div>' if i < 6 else ''}<div><p>Story {i}</p></div></body>", 1, "t") for i in range(60)]
    got = {r.page_id: r.text for r in web_text.extract(pages_of(spark, rows)).collect()}
    assert got == {i: f"Story {i}" for i in range(60)}


def test_cards_are_not_the_content():
    cards = "".join(f"<article><h2><a href=/{i}>Title {i}</a></h2><p>More</p></article>" for i in range(3))
    assert web_text.main_text(f"<body><div><p>{'The body of this page. ' * 5}</p></div><div>{cards}</div></body>") == ("The body of this page. " * 5).strip()
    assert web_text.main_text(f"<body>{cards}</body>") == "\n\n".join(f"Title {i}\n\nMore" for i in range(3))


def test_deep_elements_keep_their_places():
    deep = "<div>" * 300 + "{}" + "</div>" * 300
    assert web_text.main_text("<body><div><article>" + deep.format("x") + "<p>tail</p></article></div></body>") == "x\n\ntail"
    assert web_text.main_text("<article>" + deep.format("<nav><div>menu</div></nav><aside>side</aside>text") + "</article>") == "text"
    assert web_text.main_text("<b>" * 50_000 + "x" + "</i>" * 50_000 + "<p>y") == "x\n\ny"
