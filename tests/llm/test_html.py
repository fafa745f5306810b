import re

import pytest
from marketprose.llm import html


@pytest.fixture(scope="module")
def model():
    return html.default_field()


def test_held_out_pages(model):
    right = wrong = missed = 0
    for page in html.labelled_pages(120, seed=1234):
        blocks = html.blocks_of(page)
        for block, label in zip(blocks, model.decode(blocks), strict=True):
            right += bool(label) and block.main
            wrong += bool(label) and not block.main
            missed += not label and block.main
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_viterbi_is_the_best_of_all(model):
    page = "<nav><a href=x>a</a></nav><article><h1>T</h1><p>Some text is here, and more of it.</p></article><footer>&copy; me</footer>"
    blocks = html.blocks_of(page)
    emit = model.emissions(blocks)

    def score(labels):
        out = model.start[labels[0]] + emit[0][labels[0]]
        return out + sum(model.move[a, b] + emit[i + 1][b] for i, (a, b) in enumerate(zip(labels, labels[1:], strict=False)))

    ways = [[k >> i & 1 for i in range(len(blocks))] for k in range(2 ** len(blocks))]
    assert score(model.decode(blocks)) == pytest.approx(max(map(score, ways)))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-banner"><p>We use cookies to make this site work for you.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph with
a <a href="x">link</a> and caf&eacute;, long enough to be prose.<p>Second &lt;b&gt; paragraph, unclosed, which goes on for a while.
<div class="ad">Buy now at the shop</div>
<blockquote>Quoted words of someone, as they were said back then.</blockquote></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/c">Three</a></li></ul></aside>
<section id="comments" class="comments"><div class="comment"><b>Jo</b><p>I liked this text very much, thanks for writing it.</p></div></section>
<form class="newsletter"><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_page(model):
    assert model.text(PAGE).split("\n") == [
        "Title & more",
        "First paragraph with a link and café, long enough to be prose.",
        "Second <b> paragraph, unclosed, which goes on for a while.",
        "Quoted words of someone, as they were said back then.",
    ]


BODY = "".join(f"<p>Paragraph {k} of the article tells something that is long enough to be prose, and goes on.</p>" for k in range(4))
LAYOUTS = [
    f'<body class="comments-open">{{}}<article>{BODY}</article></body>',
    f'<body>{{}}<article class="post related-posts-on">{BODY}</article></body>',
    *(f'<body>{{}}<div class="{name}"><article>{BODY}</article></div></body>'
      for name in ("right-sidebar", "search-results", "menu-open", "header-fixed", "contact", "has-sidebar", "layout-comments")),
    f'<body>{{}}<div class="post-content has-sidebar">{BODY}</div></body>',
    f'<body class="no-sidebar"><div id="page">{{}}<main><div class="entry-content">{BODY}</div></main></div></body>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("top", ["", "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>"])
def test_names_that_speak_of_something_else(model, layout, top):
    page = layout.format(top)
    assert model.text(page).split("\n") == re.findall("<p>(.*?)</p>", BODY)


def test_links_and_pull_quotes_in_an_article(model):
    link = '<p><a href="/x">See the whole report on the matter, as it was published by the office last year.</a></p>'
    quote = '<aside class="pullquote">Something that was said.</aside>'
    parts = re.findall("<p>.*?</p>", BODY)
    for page in (f"<article><h1>Title</h1>{parts[0]}{link}{parts[1]}</article>", f"<article><h1>Title</h1>{parts[0]}{quote}{parts[1]}{parts[2]}</article>"):
        assert {re.sub("<.*?>", "", p) for p in parts[:2]} <= set(model.text(f"<body>{page}</body>").split("\n"))
    assert "whole report" in model.text(f"<body><article><h1>Title</h1>{parts[0]}{link}{parts[1]}</article></body>")


def test_name_groups():
    groups = {"right-sidebar": "side", "has-sidebar": None, "comments-open": None, "sidebar2": "side", "post-content": "content",
              "related-posts-on": None, "header-fixed": None, "search-results": None, "x": None, "": None, "comment-list": None}
    assert {n: html.name_group(n) for n in groups} == groups


def test_broken_markup(model):
    for page in ["<", "</p></div>", "<p" * 100, "<b>" * 500 + "x", "<!-- never closed", "<script>never closed <p>x</p>", "&#xD800;&bogus;", "<![CDATA[x]]>"]:
        model.text(page)
    assert [b.text for b in html.blocks_of("<div>a<script>x<y</script>b<br>c<p>d<p>e</div>")] == ["ab c", "d", "e"]


def test_end_tags_that_may_be_left_out(model):
    text = "This is the text of the article, which is long enough to be prose."
    article = f"<article><h1>Title</h1><p>{text}</p><p>{text}</p></article>"
    for head in ("<head><title>No</title><body>", "<head><meta charset=utf-8><title>No</title><style>p{}</style>", "<title>No</title>",
                 "<head><title>No</title></head><body>", "<head><noscript><link href=x></noscript><body>"):
        assert model.text(f"<!DOCTYPE html><html>{head}{article}</html>") == f"Title\n{text}\n{text}"
    assert [b.text for b in html.blocks_of("<head><title>No</title>Words <b>here</b>")] == ["Words here"]
    assert [b.text for b in html.blocks_of("<head><title>No</title><body><p>a</p><head><title>No</title><p>b")] == ["a", "b"]
    lists = ["<datalist id=d><option value=a><option value=b>No</datalist>", "<select><optgroup><option>No<option>No</select>",
             "<select><option>No<div>No</div></option><option>No</select>", "<datalist><option><div>No</div>No</option></datalist>"]
    for options in lists:
        assert [b.text for b in html.blocks_of(f"<div><p>a</p><div>{options}b</div><p>c</div>")] == ["a", "b", "c"]


def test_formulas_and_fallback_text(model):
    found = html.blocks_of(
        "<article><p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>No</annotation></semantics></math> holds."
        "<p>See <object data=f.svg>the figure</object> here.<p>Then<math display=block><mi>y</mi></math>is."
        "<object data=g><p>One.</p><p>Two.</p></object></article>"
    )
    assert [b.text for b in found] == ["So x=2 holds.", "See the figure here.", "Then", "y", "is.", "One.", "Two."]


def test_tables(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (1, "u", PAGE), (4, "x", "<article>" + "<p>Long text of a paragraph, again and again.</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html.extract(pages, model).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[2] == texts[3] == "" and texts[None] == texts[1] == model.text(PAGE)
    assert texts[4].count("\n") == 19_999
    assert html.extract(pages.limit(0), model).count() == 0
