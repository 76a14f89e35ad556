"""Main text of pages, held against what made the pages."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import pages

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    found = pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    return {r["page_id"]: r["text"] for r in found}


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(n)).capitalize() + "."


def prose(draw, blocks):
    return [words(draw, draw.randint(15, 40)) for _ in range(blocks)]


def test_pages_of_the_tables(spark):
    """The tables' pages hold their articles between tags of that name, as headings and paragraphs."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in pages.main_text(table).collect()}
    rows = table.collect()
    assert len(found) == len(rows)
    for row in rows:
        inside = re.search(r"<article>(.*)</article>", row["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside)]
        assert found[row["page_id"]] == "\n\n".join(b for b in blocks if b)


MARKED = [
    '<body class="home with-sidebar"><header class="top"><h1>Site</h1></header><div id="menu"><a href="/">Home</a></div><main><div class="breadcrumbs">You are here</div><article><header><h1>{title}</h1></header>{body}<aside>Read too</aside><div class="share-buttons">Share</div><footer>By us</footer></article></main><section id="comments"><article class="comment"><p>{noise}</p></article></section><footer>c</footer>',
    '<div class="cookie-notice">We use cookies</div><div class="topbar">Hi</div><div id="content"><h1>{title}</h1>{body}<form><p>Mail</p><input name=q></form><ul class="related"><li>{noise}</ul></div><div class="sidebar"><p>{noise}</p></div>',
    '<div class="layout-sidebar"><div role="main"><h1>{title}</h1>{body}<div style="display: none">{noise}</div><div class="advert">{noise}</div></div></div><div class="popup">{noise}</div>',
    '<table><tr><td class="menu">Menu<td><div itemprop="articleBody"><h1>{title}</h1>{body}</div></table><noscript>{noise}</noscript><template><p>{noise}</p></template>',
]


@pytest.mark.parametrize("frame", range(len(MARKED)))
@pytest.mark.parametrize("n", [1, 6])
def test_marked_pages(spark, frame, n):
    draw, rows, wanted = random.Random(frame), [], {}
    for k in range(n):
        title, blocks = words(draw, 5), prose(draw, draw.randint(1, 6))
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((k, f"https://host{frame}.example/{k}", "<!doctype html><html><head><title>T</title><style>p{}</style></head>" + MARKED[frame].format(title=title, body=body, noise=words(draw, 30))))
        wanted[k] = "\n\n".join([title, *blocks])
    assert texts(spark, rows) == wanted


def test_a_template_without_names_is_deduced(spark):
    """No element says what it is: the host's own words are on every page, and prose lies in one element."""
    draw, rows, wanted = random.Random(5), [], {}
    for k in range(12):
        title, blocks = words(draw, 6), prose(draw, draw.randint(3, 8))
        said = "".join(f'<div class="r1"><div class="r2">{words(draw, 2)}</div><p>{words(draw, draw.randint(3, 9))}</p></div>' for _ in range(draw.randint(0, 3)))
        links = "".join(f'<div class="l"><a href="{j}">{words(draw, 3)}</a></div>' for j in range(4))
        rows.append((k, "http://plain.example/" + str(k), f'<body><div class="a"><div>The Daily Plain</div>{links}</div><div class="b"><p>Our terms have changed, please read them all with care before you go on.</p><h2>{title}</h2>{"".join(f"<p>{b}" for b in blocks)}</div><div class="c">{said}</div><div class="d">All rights with The Daily Plain</div></body>'))
        wanted[k] = "\n\n".join([title, *blocks])
    assert texts(spark, rows) == wanted


def test_copies_of_an_article_stay(spark):
    body = "<p>The same words of an article that many pages carry, again and again, without a change.</p><p>And a second part of it that is no shorter than the first one was.</p>"
    marked = [(k, "http://copies.example/", f"<body><nav>x</nav><article>{body}</article>") for k in range(9)]
    plain = [(100 + k, "http://bare.example/", f'<body><div class="x">{body}</div>') for k in range(9)]
    wanted = body.replace("<p>", "").replace("</p>", "\n\n").strip()
    assert set(texts(spark, marked + plain).values()) == {wanted}


def test_markup(spark):
    cases = {
        "<p>a&amp;b &lt;x&gt; &eacute;&#233;&#xE9; &copy 1&nbsp;2<p>c": "a&b <x> ééé © 1 2\n\nc",
        "<p>one <b>two</b>three<br>four\n\tfive": "one twothree four five",
        "x<!-- hidden <p>y</p> -->z<script>if (a</b/) '<p>no</p>'</script>": "xz",
        "<ul><li>a<li>b</ul>tail<table><tr><td>c<td>d<tr><th>e</table>": "a\n\nb\n\ntail\n\nc\n\nd\n\ne",
        "a < b and 3 <4 <p title='>'>next</p></div></p>end": "a < b and 3 <4\n\nnext\n\nend",
        "<pre>  two\n  lines</pre><h3></h3><p> \n </p>last <i": "two lines\n\nlast",
        "<style>p{}</style><title>t</title><P CLASS=x>Upper</P>": "Upper",
        "<!-- never closed <p>x": "", "": "", "<script>never closed": "", "<nav>only a menu</nav>": "",
    }
    rows = [(k, f"http://h{k}.example/", page) for k, page in enumerate(cases)]
    assert texts(spark, rows) == dict(enumerate(cases.values()))


def test_odd_rows(spark):
    long = "<p>" + "word " * 300_000 + "</p>" + "<div>" * 3000 + "deep"
    rows = [(1, None, None), (2, "no address", "<p>x</p>"), (None, "http://a.example", "<p>y</p>"), (3, "http://b.example", long), (4, "HTTP://U@A.example:80/?q", "<p>z</p>")]
    found = texts(spark, rows + [(2, "no address", "<p>x</p>")])
    assert found[1] == "" and found[2] == "x" and found[None] == "y" and found[4] == "z" and found[3] == "word " * 299_999 + "word\n\ndeep"
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("q") for c in ("host", "row", "tokens", "blocks", "text", "slots", "main", "texts")})
    assert pages.main_text(wide).count() == 5
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_classes_are_equal_vectors(spark):
    """Tokens of a class are on the same pages as often, in one order."""
    draw = random.Random(1)
    rows = [(k, "http://one.example/", "<body><div><h1>t</h1><p>fixed</p></div>" + "<section><h2>s</h2><em>e</em></section>" * draw.randint(0, 3) + ("<h5>x</h5><h6>y</h6><pre>z</pre>" if k % 2 else "<pre>z</pre><h6>y</h6><h5>x</h5>")) for k in range(8)]
    read = pages.parsed(spark.createDataFrame(rows, SCHEMA))
    found = pages.classes(read, read.groupBy("host").agg(F.count("*").alias("all"))).collect()
    vectors = {}
    for row in read.collect():
        for t in row["tokens"]:
            vectors.setdefault(t["token"], {})[row["row"]] = t["n"]
    by_class = {}
    for row in found:
        by_class.setdefault(row["class"], set()).add(tuple(sorted(vectors[row["token"]].items())))
    assert by_class and all(len(v) == 1 for v in by_class.values())
    key = lambda path: pages._key(path)
    held = {r["token"] for r in found}
    # Tags of the part that changes its order are on all pages, as the frame is, which is no class of one order therefore.
    assert key("/body/section") in held and key("/body/h5") not in held
