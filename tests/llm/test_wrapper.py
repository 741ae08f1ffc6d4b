import re
from html import unescape

import pytest

from momentrank.llm import wrapper


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, shape int")
    return {r.id: r.text for r in wrapper.extracted(df.repartition(3), **options).collect()}


def plain(html):
    """The article of a test page, by patterns that know its form."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def test_query_matches_patterns(spark, sf):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = wrapper.op11_wrapper(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == {k: plain(v) for k, v in html.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_template_of_a_host_without_names(spark):
    """No element says what it is: constant texts go, varying ones stay, however the pages differ in form."""
    page = "<div><div>My site</div><div><span>Welcome to all</span></div>{extra}<div><p>Story {i} begins</p><p>and {i} ends.</p></div><div>All rights kept</div></div>"
    rows = [(i, f"http://a.org/{i}", page.format(i=i, extra="<div><img src=x></div>" if i % 3 else "")) for i in range(20)]
    rows.append((100, "http://b.org/1", page.format(i=1, extra="")))
    got = run(spark, rows)
    assert got == run(spark, rows, small=0)
    for i in range(20):
        assert got[i] == f"Story {i} begins\n\nand {i} ends."
    assert got[100] == "My site\n\nWelcome to all\n\nStory 1 begins\n\nand 1 ends.\n\nAll rights kept"  # one page can't tell


def test_names_decide_what_varies_and_is_no_article(spark):
    html = """<body><header><p>Site {i}</p></header><div class="cookie-notice">We use {i}</div><nav><ul><li><a href=/>Home {i}</a></li></ul></nav>
    <main><article><header><h1>Title &amp;amp; {i}</h1></header><p>One<b> bold</b>{i}&nbsp;x<br>y</p><aside>See also {i}</aside><form><input>Mail {i}</form>
    <div id="comments"><p>Reader {i}</p></div><div class="shareButtons"><p>Share {i}</p></div><p class="lead-advice">Last {i}</article></main>
    <div class="sidebar"><p>Side {i}</p></div><div class=ad><p>Buy {i}</p></div><footer>Foot {i}</footer><script>"<p>no</p>"</script></body>"""
    got = run(spark, [(i, "https://x.net/", html.replace("{i}", str(i))) for i in range(3)])
    for i in range(3):
        assert got[i] == f"Title &amp; {i}\n\nOne bold{i} x y\n\nLast {i}"


def test_copies_of_one_article_stay(spark):
    rows = [(i, f"http://c.org/{i}", "<article><p>The same</p><p>on all.</p></article><footer>f</footer>") for i in range(12)]
    assert set(run(spark, rows).values()) == {"The same\n\non all."}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    wide = "".join(f"<h2>h{i}</h2><p class=c{i}x>p{i}</p>" for i in range(3000))
    rows = [
        (1, "http://o.org/", None), (2, "http://o.org/", ""), (3, None, "<p>no url"), (4, "http://o.org/", "text only"), (5, "http://o.org/", "<script>never closed <p>x</p>"),
        (6, "http://o.org/", deep), (7, "http://o.org/", wide), (8, "http://o.org/", "<p>a<p>b<li>c<li>d<td>e"), (9, "http://o.org/", "a < b <p>c > d</p><!-- <p>x</p>"),
        (10, "http://o.org/", "<ul><li><a href=/>only links</a></li><li>text <a href=/>and link</a></li></ul>"), (4, "http://o.org/", "text only"), (None, "u", "<p>null id</p>"),
        (11, "http://o.org/", "<style>p{}</style><title>t</title><noscript><p>no</p></noscript><textarea>form</textarea><p>yes</p>"), (12, "http://o.org/", "<p>" + "long " * 400_000),
    ]
    got = run(spark, rows)
    assert got[1] == got[2] == got[5] == "" and got[3] == "no url" and got[4] == "text only" and got[6] == "deep" and got[None] == "null id"
    assert got[7] == "\n\n".join(f"h{i}\n\np{i}" for i in range(3000))
    assert got[8] == "a\n\nb\n\nc\n\nd\n\ne" and got[9] == "a < b\n\nc > d" and got[10] == "text and link" and got[11] == "yes"
    assert got[12] == ("long " * 400_000).strip()
    assert run(spark, []) == {}


def test_matching_is_the_largest_common_tree():
    """Against all order-keeping pairings of children."""

    def plain_match(a, b):
        if a.name != b.name:
            return 0

        def best(xs, ys):
            if not xs or not ys:
                return 0
            return max(best(xs[1:], ys), best(xs, ys[1:]), plain_match(xs[0], ys[0]) + best(xs[1:], ys[1:]))

        return 1 + best(a.children, b.children)

    shapes = ["r(a()b(c()d())e())", "r(b(d())a()e())", "r(a(x())b(c()))", "r()", "q(a())", "r(e()b(d()c())a(x()))"]
    for x in shapes:
        for y in shapes:
            a, b = wrapper.read(x)[0], wrapper.read(y)[0]
            assert wrapper.matched(a, b, {}) == plain_match(a, b)
    whole, places = wrapper.slots(shapes[0], [shapes[2], shapes[0]])
    assert whole == "r(a(x())b(c()d())e())"
    assert places == [[0, 1, 2, 3, 4], [0, 1, 3, 4, 5, 6]]


@pytest.mark.parametrize("group", [2, 64])
def test_rounds_of_uniting_give_one_wrapper(spark, monkeypatch, group):
    monkeypatch.setattr(wrapper, "HOST", group)
    page = "<div>Site</div>{extra}<div><p>Story {i}</p></div>"
    rows = [(i, "http://a.org/", page.format(i=i, extra="".join(f"<h{k}>h {i} {k}</h{k}>" for k in range(1, 6) if i >> k & 1))) for i in range(64)]
    got = run(spark, rows)
    assert all("Site" not in t and f"Story {i}" in t for i, t in got.items())
