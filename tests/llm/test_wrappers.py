import json
import random
import re

import pytest

from tracelake.llm import wrappers as W


def alone(page):
    return W.main_text(page, W.shape(W.read(page)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("<p", ""), ("a<b>c</b>d", "acd"), ("<p>1<p>2</b></p>3", "1\n2\n3"), ('<div title="a>b">t</div>', "t"), ("&amp;lt; &#65;&eacute;&nbsp;x", "&lt; Aé x"),
        ("<!-- x -->y<!-- z", "y"), ("one\n  two<br>three", "one two three"), ("<script>if(a<b){'</p>'}</script>x", "x"), ("<ul><li>a<li>b</ul>", "a\nb"),
        ("<header>h</header><main><p>m</p><form>f</form></main><footer>z</footer>", "m"), ('<div class="sidebar">s</div><p>m</p><div id=cookie-notice>c</div>', "m"),
        ('<article>a<section class="comments"><p>c</p></section><aside>s</aside>b</article><p>out</p>', "a\nb"), ("1 < 2 <3", "1 < 2 <3"), ("<p hidden>x</p>y", "y"),
    ],
)
def test_single_pages(page, text):
    assert alone(page) == text


def test_wrappers_fold_repeats_and_mark_optionals():
    shapes = [W.shape(W.read(p)) for p in ("<ul><li>a</li><li><b>b</b></li></ul>", "<h2>x</h2><p>y</p><h2>z</h2><p>w</p><ul><li>c</li></ul>")]
    whole = W.align_all(shapes)
    assert [(p[0], p[2], p[3]) for p in whole] == [("h2", True, True), ("p", True, True), ("ul", False, False)]
    item = whole[2][1][0]
    assert item[0] == "li" and item[3] and {(p[0], p[2]) for p in item[1]} == {("#", True), ("b", True)}


def test_any_order_of_alignment_keeps_all_labels():
    rng = random.Random(0)
    pages = ["".join(rng.choice(["<p>x</p>", "<h2>y</h2>", "<div><p>z</p></div>", "<ul><li>a</li></ul>"]) for _ in range(rng.randrange(1, 6))) for _ in range(30)]
    shapes = [W.shape(W.read(p)) for p in pages]
    for _ in range(5):
        rng.shuffle(shapes)
        assert {p[0] for p in W.align_all(shapes)} == {"p", "h2", "div", "ul"}


def test_deep_and_broken_pages_are_read_whole():
    deep = "<div>" * 5000 + "inner" + "</div>" * 5000 + "<p>after</p>"
    assert alone(deep) == "inner\nafter"
    assert json.loads(json.dumps(W.shape(W.read(deep))))
    assert alone("<a href=\"x>t</a>" * 2000) == "t" * 1000  # a quote runs to the next one
    assert alone("<" * 50_000 + "x") == "<" * 49_999  # the last one starts a tag that is cut off


def test_given_pages_give_their_documents(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = W.extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        doc = int(re.search(r"://[^/]*[^?#]*?/(\d+)", r.url)[1])
        lines = [x for x in (" ".join(line.split()) for line in texts[doc].split("\n")) if x]
        assert r.text.split("\n")[1:] == lines and r.n_chars == len(r.text)


def test_rounds_merge_all_wrappers_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(W, "GROUP", 2)
    pages = spark.createDataFrame([("h", "<p>a</p>" * (k % 3) + f"<h{k % 6 + 1}>b</h{k % 6 + 1}><i>c</i>" + "<table></table>" * (k % 2)) for k in range(40)], "host string, html string")
    rows = W.infer(pages).collect()
    assert len(rows) == 1 and {p[0] for p in json.loads(rows[0].wrapper)} >= {"h1", "h6", "p", "table", "i"}


def test_edges(spark):
    rows = [(1, None, None), (2, "http://a.b/1", ""), (2, "http://a.b/1", ""), (None, "x", "<p>t</p>"), (3, "http://a.b/2", "<article><p>in</p></article>out"), (4, "http://a.b/3", "<p>no article</p>"), (5, "http://a.b/4", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.extract(pages.selectExpr("*", "1 AS host", "'w' AS wrapper", "0 AS text")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 2), (4, 10), (5, 999_999)]
    assert W.extract(pages.limit(0)).count() == 0


def test_templates_without_a_known_class_are_dropped_by_their_place(spark):
    words = [f"w{k}" for k in range(200)]
    story = lambda k: " ".join(words[(k * 7 + j * (k + 1)) % 200] for j in range(30))
    page = "<body><div>Follow us everywhere</div><div><p>{}</p><p>{}</p></div>{}<div>Copyright <b>us</b></div></body>"
    tied = "<section>Read our rules</section>"
    rows = [(k, f"http://a.b/{k}", page.format(story(k), story(k + 50), tied if k % 2 else "")) for k in range(30)]
    rows += [(100 + k, f"http://few.b/{k}", page.format(story(k), story(k + 50), "")) for k in range(4)]  # too few to tell
    rows += [(200 + k, f"http://copy.b/{k}", page.format(story(3), story(4), f"<p>{k}</p>")) for k in range(30)]  # copies
    rows += [(300 + k, f"http://art.b/{k}", f"<article><div>Support us</div><p>{story(k)}</p><p>Shared line</p></article>") for k in range(30)]
    rows += [(400 + k, f"http://some.b/{k}", f"<p>{story(k)}</p>" + "<p>Shared by many</p>" * (k % 4 > 0)) for k in range(28)]
    got = {r.page_id: r.text.split("\n") for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in range(30):
        assert got[k] == [story(k), story(k + 50)]
        assert got[200 + k] == ["Follow us everywhere", story(3), story(4), str(k), "Copyright us"]
        assert got[300 + k][0] == story(k)
    assert all(got[100 + k] == ["Follow us everywhere", story(k), story(k + 50), "Copyright us"] for k in range(4))
    assert all(got[400 + k] == [story(k)] + ["Shared by many"] * (k % 4 > 0) for k in range(28))


def test_long_attributes_and_deep_blocks():
    long = "x>" * 5000
    assert alone(f'<p title="{long}">a</p>b') == "a\nb" and alone(f"<p title='{long}>a</p>") == "x>" * 4999 + ">a"
    deep = "<div>" * 300 + "<p>a</p><p>b</p>" + "</div>" * 300
    assert alone(deep) == "a\nb" and alone("<body>" + "<div>" * 300 + "<article>in</article></div>out") == "in"
    assert alone('<a t="' * 20_000) == "" and alone("<a t='>" + '<b u="' * 20_000 + "x") != None  # noqa: E711


def test_groups_fold_up_to_the_longest(monkeypatch):
    page = W.read("<h1>a</h1><h2>b</h2><h3>c</h3><h4>d</h4><h5>e</h5>" * 3)
    assert len(W.shape(page)) == 15
    monkeypatch.setattr(W, "LONGEST_GROUP", 5)
    assert [(p[0], p[3]) for p in W.shape(page)] == [(f"h{k}", True) for k in range(1, 6)]
