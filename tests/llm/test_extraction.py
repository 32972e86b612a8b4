import html
import itertools
import math
import re
import time

import numpy as np
import pytest
from pulsegrid.llm import extraction as X


@pytest.fixture(scope="module")
def model():
    return X.train(X.labelled_pages())


def test_message_passing_is_exact():
    parent, own = [-1, 0, 0, 1, 1, 2], [0.3, -1.2, 0.8, 0.1, -0.4, 2.0]
    edge = [(0.0, 0.0, 0.0, 0.0), (0.5, -0.7, 0.1, 0.9), (0.2, 0.0, -1.0, 0.4), (0.5, -0.7, 0.1, 0.9), (1.0, 0.3, -0.2, 0.0), (0.2, 0.0, -1.0, 0.4)]
    total, one = 0.0, [0.0] * 6
    for y in itertools.product((0, 1), repeat=6):
        weight = math.exp(sum(o * v for o, v in zip(own, y, strict=True)) + sum(edge[i][2 * y[parent[i]] + y[i]] for i in range(1, 6)))
        total += weight
        one = [a + weight * v for a, v in zip(one, y, strict=True)]
    full, _ = X.beliefs(parent, own, edge)
    for kinds in ([0, 1, 0, 1, 1, 0],):
        edges = np.array([edge[2], edge[1]])
        lists, _ = X.beliefs(parent, own, [tuple(edges[k]) for k in kinds])
        arrays, _, _ = X.Forest([parent, parent], [kinds, kinds]).beliefs(np.array(own * 2), edges)
        assert arrays.tolist() == pytest.approx(lists * 2)
    assert [1 / (1 + math.exp(-b)) for b in full] == pytest.approx([a / total for a in one])


def test_held_out_layouts(model):
    wrong = blocks = 0
    for source in X.labelled_pages(400)[180:]:
        page, truth = X.Page(source), []
        for i, attrs in enumerate(page.attrs):
            m = X.LABEL.search(attrs)
            truth.append(int(m[1]) if m else truth[page.parent[i]] if i else 0)
        content = model.marginals(page)
        for node, _ in page.blocks:
            blocks += 1
            wrong += (content[node] >= 0.5) != truth[node]
    assert wrong < 0.03 * blocks


def test_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in X.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"<br>|</?p>|</?h1>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "plain text without markup"), (4, "<article><p>A &lt;b&gt; &amp; B&nbsp;\n C</p><p>open"), (4, "<article><p>A &lt;b&gt; &amp; B&nbsp;\n C</p><p>open"), (5, "<p <<< \"' <a href='x"), (6, "<article><h1>T</h1>" + "<p>word word, word.</p>" * 20_000 + "</article>"), (None, "<script>var a='</p>'</script>")]
    pages = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {}
    for r in X.extract_main_text(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == got[2] == got[None] == [""]
    assert got[4] == ["A <b> & B C\nopen"] * 2
    assert got[6][0].count("\n") == 20_000
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert X.extract_main_text(pages.limit(0)).count() == 0
    page = '<body><nav><ul><li><a href="/">Home</a></li></ul></nav><main><article><h1>Title</h1><p>First, with <a href="#">a link</a> inside.<p>Second.<div class="advert">Buy now, it is cheap and it is good for everybody here.</div><section class="comments"><p>I am a reader and I comment, at length, on this.</p></section></article></main><footer>End</footer>'
    assert model.extract(page) == "Title\nFirst, with a link inside.\nSecond."


@pytest.mark.parametrize("part", ["<a '", "<a =\"", "<div>", "</x>", "<!", "<a ", "<svg>", "<li><div>", "<button>", "&#", "<tr></tr>", "class = ", "<!--"])
def test_hostile_pages_take_time_in_proportion(part):
    seconds = []
    for n in (5_000, 40_000):
        source = "<ul><li><ul>" + "<div>" * (n // 10) + part * n + "</ul></p>" * n + "</div>" * n
        began = time.process_time()
        X.Page(source)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 25 * seconds[0] + 0.2 and seconds[1] < 5


def test_rules_unclosed_elements_and_names_that_mislead(model):
    assert model.extract("<article><p>One sentence here.<hr>Two</p></article>") == "One sentence here.\nTwo"
    for name in ("button", "svg", "select", "template"):
        assert model.extract(f"<article><p>Before it.</p><{name}><p>The rest of the text is still read.</p></article>") == "Before it.\nThe rest of the text is still read."
    long = "This is a sentence of the article, with commas, and it goes on for some time so that it counts. " * 3
    for names in ("shared-memory", "header-row", "sharedMemory", "navigational", "footnotes", "address-space"):
        assert model.extract(f'<body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title</h1><div class="{names}"><p>{long}</p></div></article></body>') == f"Title\n{long.strip()}"
    for names in ("advert", "cookie-banner", "comments", "share-links sharing", "newsletter"):
        assert model.extract(f'<body><article><h1>Title</h1><p>{long}</p><div class="{names}"><p>Something to read and to accept here.</p></div></article></body>') == f"Title\n{long.strip()}"


def test_rows_of_tables_close_each_other():
    page = X.Page("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [page.tag[i] for i in page.parent[2:]] == ["table", "tr", "tr", "table", "tr"]


def test_formulas_and_fallback_texts_are_read(model):
    long = "This is a sentence of the article, with commas, and it goes on for some time so that it counts. " * 2
    page = f'<article><h1>Title</h1><p>{long}The value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>See <object data="a.pdf">the report</object> and <video src="v">its film</video>. <svg><text>axis</text></svg></p></article>'
    assert model.extract(page) == f"Title\n{long}The value x=2 holds.\nSee the report and its film."


P = "This is a plain sentence of the article, which goes on for a while. " * 5
Q = P.strip()
LINKS = "<ul>" + '<li><a href="/a">Some page</a></li>' * 6 + "</ul>"
BAR = " | ".join(f'<a href="/{i}">Page {i}</a>' for i in range(7))


#: Their names are in no list of the training pages, or they have none.
LAYOUTS = [
    (f'<body><div class="x1"><h1>T</h1></div><div class="x2"><p>{P}</p><p>{P}</p></div></body>', ["T", Q, Q]),
    (f"<body><div><h1>Title</h1><p>{P}</p></div><div><p>{P}</p></div></body>", ["Title", Q, Q]),
    (f'<body><nav>{LINKS}</nav><div class="zq7"><h1>Title</h1></div><div class="wv"><p>{P}</p><p>{P}</p></div><footer><p>Imprint</p></footer></body>', ["Title", Q, Q]),
    (f'<body><div class="kx">{LINKS}</div><div class="qq"><div class="q1"><p>{P}</p></div><div class="q2"><p>{P}</p></div></div><div class="kz">{BAR}</div></body>', [Q, Q]),
    (f"<body><table><tr><td>{LINKS}</td><td><h1>Title</h1><p>{P}</p><p>{P}</p></td></tr></table></body>", ["Title", Q, Q]),
    (f'<body><div id="u1">{BAR}</div><section><h2>Title</h2><p>{P}</p><ul><li>One thing, and more.</li></ul></section><form><p>Search here</p></form></body>', ["Title", Q, "One thing, and more."]),
    (f"<body><div><div><div><h1>Title</h1><p>{P}</p></div></div></div><aside><p>{P}</p></aside></body>", ["Title", Q]),
    (f"<body><p>{P}</p><p>{P}</p></body>", [Q, Q]),
]
#: Written after the training pages were settled, and seen once: four of six came out whole.
LATER = [
    (f'<body><div id="cuerpo"><h2>Titulo</h2><p>{P}</p><div class="zz"><p>{P}</p></div></div><div id="pie"><a href="/">Inicio</a></div></body>', ["Titulo", Q, Q]),
    (f"<body><div><h1>Title</h1><dl><dt>Term</dt><dd>{P}</dd></dl><p>{P}</p></div></body>", ["Title", "Term", Q, Q]),
    (f"<body><nav>{LINKS}</nav><section><h1>Title</h1><p>{P}</p><blockquote><p>{P}</p></blockquote></section><footer><p>{P}</p></footer></body>", ["Title", Q, Q]),
    (f'<body><div class="v1"><h3>Pages</h3>{LINKS}</div><div class="v2"><h1>Title</h1><div><p>{P}</p></div><div><p>{P}</p></div></div></body>', ["Title", Q, Q]),
]
#: Those that did not: text between line breaks in an unnamed div, and a page of tables only.
OPEN = [
    (f"<body><div>{BAR}</div><div>{P}<br><br>{P}</div></body>", [Q, Q]),
    (f"<body><center><table><tr><td>{BAR}</td></tr></table></center><table><tr><td><p>{P}</p><p>{P}</p></td></tr></table></body>", [Q, Q]),
]


@pytest.mark.parametrize("source,want", LAYOUTS + LATER + [pytest.param(*x, marks=pytest.mark.xfail(strict=True)) for x in OPEN])
def test_layouts_of_other_names(model, source, want):
    assert model.extract(source).split("\n") == want
