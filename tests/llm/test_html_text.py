import random
from html.parser import HTMLParser

from sparklore.llm.html_text import best_path, extract, main_text
from sparklore.llm.queries import op3_html_text

BLOCKS = {"p", "h1", "div", "article", "footer"}


class Plain(HTMLParser):
    """Text blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.held = False, [], ""

    def flush(self):
        if t := " ".join(self.held.split()):
            self.out.append(t)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.held += data


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op3_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id].html)
        plain.close()
        plain.flush()
        assert r.text == "\n".join(plain.out) and r.n_chars == len(r.text) > 0 and r.url == pages[r.page_id].url


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><article>no";</script></head>
<body class="page-12"><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a>More</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="wrap"><div class="post post-77">
<h1>Head &lt;one&gt;</h1><p>First <b>bold<i> text</b>, with&nbsp;a <a href="x">link</a>
 &#233;&eacute;&#x1F600; &am &amp no.<p>Second<br>line.<ul><li>Item one<li>Item two</ul><table><tr><td>Cell<td>Other</table>
<form><input value="x">Subscribe <button>Go</button></form><script>document.write("<p>evil</p>")</script>
<!-- <p>comment</p> --><div class="advert">Buy now!</div><blockquote>Quoted, at some length, from elsewhere.</blockquote></div>
<aside>About us, at length, with many words that no reader wants.</aside><div class="comments"><p>Nice post!</p></div></div>
<footer>&copy; all</footer></body></html>"""
TEXT = "Head <one>\nFirst bold text, with a link éé😀 &am & no.\nSecond line.\nItem one\nItem two\nCell\nOther\nQuoted, at some length, from elsewhere."


def test_one_page():
    assert best_path(PAGE)[0] == "/html/body.page-#/div/div.post.post-#"
    assert main_text(PAGE, None) == TEXT and main_text(PAGE, "/html/body.page-#/div/div.post.post-#") == TEXT
    assert main_text(PAGE, "/html/body/none") == TEXT


def test_odd_pages():
    assert main_text(None, None) == main_text("", "x") == main_text("<p>", None) == main_text("<!-- open <p>x", None) == ""
    assert main_text("just text", None) == "just text" and main_text("a < b <3 &lt;p&gt;", None) == "a < b <3 <p>"
    assert main_text("<nav>menu<article><p>Cut off te", None) == "Cut off te"
    assert main_text("<p>a</div></p>b</section><p title='>'>c", None) == "a\nb\nc"
    assert main_text("<div " * 5000, None) == "" and main_text("<a b='" * 3000 + "x", None) is not None
    assert main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000, None) == "deep"
    assert main_text("<article>" + "<p>word</p>" * 50_000, None).count("word") == 50_000


def test_hosts_agree_and_edges(spark):
    short = '<body><div class="entry n{i}"><p>Short {i}.</p></div><div class="blurb"><p>{x}</p></div>'
    rows = [(i, "http://H.example/%d" % i, short.format(i=i, x="A blurb that is longer than any text here." if i == 3 else "."), "k", 1) for i in range(8)]
    rows = [(*r[:2], r[2].replace("Short", "Quite a long stretch of text") if r[0] != 3 else r[2], *r[3:]) for r in rows]
    rows += [(20, None, "<p>x</p>", "k", 1), (21, "no host", None, None, 1), (None, "http://e.example/", "", "k", None), (20, None, "<p>x</p>", "k", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = {}
    for r in extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Short 3.\nA blurb that is longer than any text here."] and got[5] == ["Quite a long stretch of text 5."]
    assert got[20] == ["x", "x"] and got[21] == [""] and got[None] == [""]
    assert extract(pages.limit(0)).count() == 0


def test_all_that_is_no_boilerplate_is_kept(spark):
    lead, rest = "A lead that says what follows. " * 5, "The body of the article goes on. " * 20
    split = f"<body><nav>Menu here</nav><div class=content><p>{lead}</p><div class=wrap><div class=body><p>{rest}</p></div></div></div><footer>Foot</footer></body>"
    marked = f"<body><nav>Menu here</nav><main><article><p>{lead}</p></article><section><p>{rest}</p></section></main><div class=advert>Buy</div><div>.</div></body>"
    want = f"{lead.strip()}\n{rest.strip()}"
    assert best_path(split)[0] == "/body/div.content" and best_path(marked)[0] == "/body/main"
    assert main_text(split, None) == main_text(marked, None) == want
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", (split, marked)[i % 2]) for i in range(6)], "page_id long, url string, html string")
    assert [r.text for r in extract(pages).collect()] == [want] * 6


def test_long_attributes_and_quotes():
    long = "<p class='x'>a > b</p>" * 1000
    for quote, value in (('"', long), ("'", long.replace("'", '"'))):
        page = f"<body><p>Before.</p><div data-x={quote}{value}{quote} class=advert>Buy</div><img src={quote}{value}{quote}><p>After.</p></body>"
        assert main_text(page, None) == "Before.\nAfter."
    assert main_text("<p title=it's>one</p><p class=\"a\"\">two</p><p don't>three</p>", None) == "one\ntwo\nthree"
    assert main_text('<p>one</p><p title="never closed>two</p>', None) == "one\ntwo"
    assert main_text("<p>x</p>" + "<p a=\"b' >y</p>" * 50_001, None).startswith("x\ny")
    assert main_text("<p>x</p>" + "<a b=" * 100_000 + "<a b=' c" * 100_001, None).startswith("x")
    assert main_text("<i " + "= " * 500_000 + "\t" * 500_000 + ">x", None) == "x"


def test_text_around_and_boilerplate_within_deep_nests():
    nest = "<div>" * 600 + "{}" + "</div>" * 600
    page = "<body><div class=post><p>Before.</p>" + nest.format("<p>In the nest.") + "<p>After.</p></div><div class=advert>Buy</div></body>"
    assert best_path(page)[0] == "/body/div.post" and main_text(page, "/body/div.post") == "Before.\nIn the nest.\nAfter."
    hidden = nest.format("<nav><div>Menu</div></nav><ul><li>One<li>Two</ul><div class=advert><div>Buy</div>now</div><p>Kept")
    assert main_text("<body><ul><li>First" + hidden + "<li>Last</ul><p>After.", None) == "First\nOne\nTwo\nKept\nLast\nAfter."
    assert main_text("<body>" + nest.format("<nav>Menu<article>Text</article>"), None) == "Text"
    assert main_text("<body>" + "<div>" * 600 + "<nav><ul><li>" * 30_000 + "<article>Text" + "</b></i></section>" * 30_000, None) == "Text"


LAYOUTS = ("wrapper right-sidebar", "container sidebar-right", "layout-sidebar-right", "page-hidden", "nav-fixed", "banner-top", "toolbar-fixed", "main-content widget-area", "post social", "top-menu", "search-results")
BODY = "<h1>Head</h1><p>First paragraph of the article, rather long.</p><section id='skip-content'><p>Second one.</p></section><div class='social-section'><p>Third one.</p></div>"
WHOLE = "Head\nFirst paragraph of the article, rather long.\nSecond one.\nThird one."


def around(name, body, tag="div"):
    return f"<html><body><header>Site</header><nav>Menu</nav><div class='cookie-banner'>We use cookies.</div><{tag} {name}>{body}<div class='sidebar'><p>About us.</p></div><aside>Aside</aside></{tag}><footer>foot</footer></body></html>"


def test_layout_around_the_page_empties_nothing():
    for body in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div class='text'>{BODY}</div>", BODY):
        for name in LAYOUTS:
            page = around(f"class='{name}'", body)
            for path in (None, best_path(page)[0], "/elsewhere"):
                assert main_text(page, path) == WHOLE, (name, body, path)
        form = around("id='aspnetForm'", "<input type=hidden name=state><div><input name=q><button>Go</button></div>" + body, "form")
        assert main_text(form, None) == WHOLE
        assert main_text(around("class='wrapper right-sidebar'", "<form>" + body + "</form>"), None) == WHOLE
    log_in = "<body><h1>Site</h1><form class='box'>Log in <p>Name <input><p>Password <input type=password><p><input type=checkbox> Remember me <button>Go</button></form></body>"
    assert main_text(log_in, None) == "Site"
    assert main_text("<body><div class=comments><p>Only comments here, many of them.</p></div><div class=cookie-notice>Cookies</div></body>", None) == ""
    assert main_text(f"<body><div class='comments'><article>{BODY}</article></div></body>", None) == WHOLE


def test_layout_names_are_judged_by_where_the_host_has_its_text(spark):
    """A page whose side bar is longer than its text, and pages of a host with all of their text in such an element."""
    side = lambda i: "Words of the side bar. " * (30 if i == 3 else 1)
    beside = [f"<body><div class='entry'><p>Text of page {i}.</p></div><div class='sidebar'><p>{side(i)}</p></div></body>" for i in range(6)]
    within = [f"<body><p>{'A title, set apart and long. ' * (9 if i == 2 else 0)}</p><div class='container sidebar-right'><div><p>{'Text of the page. ' * 9}</p></div></div></body>" for i in range(6)]
    rows = [(i, f"http://{host}.example/{i}", page) for host, all_ in (("a", beside), ("b", within)) for i, page in enumerate(all_)]
    got = {r.url: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[f"http://a.example/{i}"] == f"Text of page {i}."
        title = ("A title, set apart and long. " * 9).strip() + "\n" if i == 2 else ""
        assert got[f"http://b.example/{i}"] == title + ("Text of the page. " * 9).strip()


def test_names_that_only_hold_such_a_word():
    page = (
        '<body><article><p class="share-price">Shares rose.</p><p id="notice-period">A month.</p><div class="search-results-study"><p>Found in a study.</p></div>'
        '<p class="notice">Closed today.</p><div id="comment-list"><p>Great read!</p></div><div class="adSlot_300x250">Buy</div><div class="related-posts box">More</div>'
        '<div class="promo-kitchen"><ul><li><a href=1>Pans</a></li><li><a href=2>Pots</a></li></ul><div><p>See <a href=3>all of our offers</a></p></div></div>'
        '<div class="widget-maker"><p>The maker of widgets <a href=4>spoke</a>.</p><div class="menu-planner"><a href=5>Plan</a></div></div><p>The end.</p></article></body>'
    )
    assert main_text(page, None).split("\n") == ["Shares rose.", "A month.", "Found in a study.", "The maker of widgets spoke.", "The end."]


class Kept(Plain):
    """Text blocks outside the elements named, of pages whose elements are all closed."""

    def __init__(self, gone):
        super().__init__()
        self.inside, self.gone, self.depth = True, gone, 0

    def handle_starttag(self, tag, attrs):
        self.flush()
        if self.depth or tag in ("nav", "footer", "script") or dict(attrs).get("class") in self.gone:
            self.depth += 1

    def handle_endtag(self, tag):
        self.flush()
        self.depth -= self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.held += data


def test_hosts_without_article_elements(spark):
    """Pages of four hosts, each with its own layout and no article element, against the standard library's parser."""
    rng, gone = random.Random(4), ("advert", "sidebar", "comments", "cookie-banner")
    words = lambda: " ".join(rng.choices("alpha beta gamma delta of the price menu".split(), k=rng.randint(3, 30)))
    layouts = [
        lambda b: f"<div class='page'><div class='entry'>{b}</div><div class='sidebar'><p>{words()}</p></div></div>",
        lambda b: f"<table><tr><td class='text'>{b}</td></tr></table>",
        lambda b: f"<main>{b}</main><div class='comments'><p>{words()}</p></div>",
        lambda b: f"<section><div class='share-price'>{b}</div></section>",
    ]
    rows = []
    for i in range(60):
        body = "".join(f"<p>{words()}</p>" if rng.random() < 0.8 else f"<div class='{rng.choice(gone)}'><p>{words()}</p></div>" for _ in range(rng.randint(1, 9))) + f"<p>{words()}</p>"
        head = f"<html><body><nav><p>{words()}</p></nav><div class='cookie-banner'><p>{words()}</p></div>"
        rows.append((i, f"https://h{i % 4}.example/{i}", head + layouts[i % 4](body) + f"<script>x</script><footer><p>{words()}</p></footer></body></html>"))
    for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        plain = Kept(gone)
        plain.feed(rows[r.page_id][2])
        plain.close()
        plain.flush()
        assert r.text == "\n".join(plain.out), rows[r.page_id]
