from collections import defaultdict

from pyspark.sql import functions as F

from corpusql.llm.html_extract import (
    digest, displaced, extracted, host_of, main_text, page_digests, page_sequence, page_tokens, slots, templates,
)

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style>
<script>var t="</p>";</script></head><body class="nav"><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">Home</a><li>Away</ul></nav><div class="ad">Buy</div>
<article><header><h1>Head {0} &lt;x&gt;</h1></header><p><b>One {0}.<br><p>Two   {0}&nbsp;&#233;<i>t</i>e</p>
<div class="share">Share me</div><p>Read more stories like this</p><form>Mail <input></form>
<section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_one_page():
    assert main_text(PAGE.format(7), frozenset()) == "Head 7 <x>\nOne 7.\nTwo 7 éte\nRead more stories like this"
    assert main_text("", frozenset()) == "" and main_text("plain &amp; text", frozenset()) == "plain & text"
    assert main_text("<p>a<p>b<br>c</div>d<", frozenset()) == "a\nb c\nd<"
    assert main_text("<article><p>cut off <b>here", frozenset()) == "cut off here"
    assert main_text("<script>never ends <p>x", frozenset()) == ""
    assert main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", frozenset()) == "a\nb\nc\nd"
    page = "<div class='with-sidebar'><p>no</p><article><div class='entry-header'>T</div>x</article></div>"
    assert main_text(page, frozenset()) == "T\nx"
    assert main_text("<aside><article>no</article></aside><div class='page-header'>no</div>y", frozenset()) == "y"
    assert main_text("<p>a<!-- <p>no --> b</p><!-- open", frozenset()) == "a b"


def test_hosts():
    assert host_of("HTTP://User@WWW.Example.org:80/x?y#z") == "www.example.org"
    assert host_of(None) == host_of("nonsense") == "" and host_of("//a.b/c") == "a.b"


def rows():
    out = [(i, f"http://a.org/{i}", PAGE.format(i)) for i in range(30)]
    out += [(100 + i, f"http://b.org/{i}", PAGE.format(i)) for i in range(3)]
    return out + [(200, None, None), (201, "http://a.org/z", ""), (None, "http://a.org/n", PAGE.format("n")), out[0]]


def test_template_texts_go(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = defaultdict(list)
    for r in page_digests(df).collect():
        out[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert len(out[0]) == 2 and out[0][0] == out[0][1]
    assert out[5][0].text == "Head 5 <x>\nOne 5.\nTwo 5 éte"
    assert out[None][0].text == "Head n <x>\nOne n.\nTwo n éte"
    # Too few pages to tell what is template.
    assert out[101][0].text.endswith("Read more stories like this")
    assert out[200][0].text == out[201][0].text == ""
    assert extracted(df.limit(0)).count() == 0


def test_classes_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    by_host = defaultdict(list)
    for page_id, url, page in data:
        by_host[digest(host_of(url))].append(page_tokens(page or ""))
    want = {}
    for host, pages in by_host.items():
        if len(pages) < 10:
            continue
        classes = defaultdict(list)
        for token in set().union(*pages):
            vector = tuple(p[token] for p in pages)
            if sum(v > 0 for v in vector) >= 0.9 * len(pages):
                classes[vector].append(token)
        want[host] = {t for c in classes.values() if len(c) > 1 for t in c}
    got = {r.host: set(r.template) for r in templates(df).collect()}
    assert got == {h: t for h, t in want.items() if t} and got


def test_repeated_rows_change_no_text(spark):
    once = spark.createDataFrame(rows()[:30], "page_id long, url string, html string")
    texts = lambda df: {(r.page_id, r.text) for r in page_digests(df).collect()}
    assert texts(once) == texts(once.union(once)) == texts(once.union(once).union(once))


def test_articles_in_side_parts_are_none():
    teasers = "<article><h3>Teaser</h3></article><article><h3>Other</h3></article>"
    for side in ("<aside>{}</aside>", "<nav>{}</nav>", "<footer>{}</footer>", "<div class='sidebar'>{}</div>", "<div class=sidebar-wrapper>{}</div>", "<div id=related>{}</div>"):
        assert main_text(f"<div><p>post</p></div>{side.format(teasers)}", frozenset()) == "post"
    comments = "<div id=comments><article class=comment-body><p>First!</p></article></div>"
    assert main_text(f"<div class=post><p>post</p></div>{comments}", frozenset()) == "post"
    assert main_text(f"<article><p>post</p>{comments}</article>", frozenset()) == "post"
    for layout in ("with-sidebar", "content-sidebar-wrap", "sidebar-layout", "page has-footer", "no-sidebar"):
        assert main_text(f"<div class='{layout}'><p>no</p><article>post</article></div>", frozenset()) == "post"
    assert main_text("<article></article><div>post</div>", frozenset()) == "post"


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in page_digests(df).collect()}


def test_a_class_keeps_only_tokens_in_one_order(spark):
    pair = ["<p class=x>Alpha</p>", "<p class=y>Beta</p>"]
    page = lambda i: f"<article><h1>T{i}</h1>{''.join(pair[:: 1 if i % 2 else -1])}<div>Always here</div></article>"
    out = texts_of(spark, [page(i) for i in range(20)])
    for i in range(20):
        lines = out[i].split("\n")
        # One of the two stands in order with the rest of the class; the other moves and is no template.
        assert lines[0] == f"T{i}" and len(lines) == 2 and lines[1] in ("Alpha", "Beta")
    assert len({text.split("\n")[1] for text in out.values()}) == 1


def test_classes_that_cross_are_not_both_template(spark):
    # The two are on all pages but one: another vector than the rest.
    four, five = "<p class=d>Four</p>", "<p class=e>Five</p>"

    def page(i, nested):
        first, second = ("", "") if i == 7 else (four + five, "") if nested else (four, five)
        return (f"<article><h1>T{i}</h1><p class=a>One</p>{first}<p class=b>Two</p>{second}"
                f"<p class=c>Three</p>Words {i}</article>")

    nested = texts_of(spark, [page(i, True) for i in range(20)])
    assert nested[3] == "T3\nWords 3" and nested[7] == "T7\nWords 7"
    crossed = texts_of(spark, [page(i, False) for i in range(20)])
    assert crossed[3] == "T3\nFour\nFive\nWords 3" and crossed[7] == "T7\nWords 7"
    later = lambda i: page(i, True).replace(four + five, "").replace("Two</p>", f"Two</p>{four}{five}" if i != 7 else "Two</p>")
    moving = texts_of(spark, [page(i, True) if i % 2 else later(i) for i in range(20)])
    assert moving[3] == "T3\nFour\nFive\nWords 3"


def test_a_page_that_leaves_the_order_keeps_its_blocks():
    page = "<article><h1>T</h1><p class=x>Alpha</p><p>text</p><p class=y>Beta</p></article>"
    kinds = [digest("/article/p.x", "Alpha"), digest("/article/p.y", "Beta")]
    assert set(kinds) <= set(page_sequence(page))
    assert slots(page, [kinds]) == [(None, True, ["T"]), ((0, 1), True, ["text"])]
    assert main_text(page, [kinds]) == "T\ntext"
    assert main_text(page, [kinds[::-1]]) == "T\nAlpha\ntext\nBeta"


def test_displaced():
    assert displaced([1, 2, 3, 1, 2, 3], [1, 2, 3]) == set()
    assert displaced([3, 1, 2, 4], [1, 2, 3, 4]) == {3}
    assert displaced([1, 1, 2, 2], [1, 2]) == {1, 2}
    assert len(displaced([2, 1, 3, 1, 2, 3], [1, 2, 3])) == 1
