"""Shapes of pages that the tables don't hold."""

import time

import pytest

from textloom.llm import html_extract

LONG = "".join(f"<p>Paragraph {k} of an article that says something at some length, as articles do.</p>" for k in range(6))
TEXTS = [f"Paragraph {k} of an article that says something at some length, as articles do." for k in range(6)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><div id="content" class="has-sidebar"><article><h1>T</h1>{LONG}</article></div></body>', ["T", *TEXTS]),
        (f'<body><div class="post no-comments"><article><h1>T</h1>{LONG}</article></div></body>', ["T", *TEXTS]),
        (f'<body><div class="page-with-widgets sidebar-left"><article><h1>T</h1>{LONG}</article></div><div class="sidebar"><p>Side</p></div></body>', ["T", *TEXTS]),
        (f'<body><form id="aspnetForm"><article><h1>T</h1>{LONG}</article></form></body>', ["T", *TEXTS]),
        (f'<body><article><header class="entry-header"><h1>T</h1></header>{LONG}<footer>Tags</footer></article></body>', ["T", *TEXTS]),
        (f'<body><header><h1>Site</h1></header><div class="post"><div class="entry-header"><h1>T</h1></div><div class="entry">{LONG}</div></div></body>', ["T", *TEXTS]),
        (f"<body><article><h1>T</h1>{LONG}<button>Share</article><p>Elsewhere</p></body>", ["T", *TEXTS]),
        (f"<body><article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p>{LONG}</article></body>", ["If x=1 holds.", *TEXTS]),
        (f"<body><article><p>a&am<b>p;</b> &lt<i>;</i></p>{LONG}</article></body>", ["a&amp; <;", *TEXTS]),
        (f'<body><article><h1>T</h1>{LONG}<div class="zz9"><h3>More</h3><ul><li><a href=a>An older story of this kind</a></li><li><a href=b>Another older story</a></li><li><a href=c>A third story of old</a></li></ul></div></article></body>', ["T", *TEXTS]),
        (f'<body><article><h1>T</h1>{LONG}</article><section id="comments"><article>{LONG}{LONG}{LONG}</article></section></body>', ["T", *TEXTS]),
        (f'<body><article><h1>T</h1><p>Short.</p><div class="ad">{LONG}</div></article></body>', ["T", "Short."]),
        (f'<body><div class="cookie-notice"><p>We use cookies</p></div><div class="wrap-widget">{LONG}</div></body>', TEXTS),
        # readers' comments inside the article
        (f'<body><article><h1>T</h1>{LONG}<article class="comment"><p>I agree</p></article></article></body>', ["T", *TEXTS]),
        (f'<body><article><h1>T</h1>{LONG}<section class="comments" id="comments"><article class="comment">{LONG}</article><article>{LONG}</article></section></article></body>', ["T", *TEXTS]),
        (f'<body><article><h1>T</h1>{LONG}<ol class="comment-list"><li class="comment even depth-1" id="li-comment-5">{LONG}</li></ol><div id="respond">Reply</div></article></body>', ["T", *TEXTS]),
        (f'<body><article><h1>T</h1>{LONG}<section id="comments"><p>I agree</p></section><div id="disqus_thread">x</div></article></body>', ["T", *TEXTS]),
        (f'<body><main><h1>T</h1>{LONG}</main><section class="comments-area"><article class="comment-body">{LONG}{LONG}</article></section></body>', ["T", *TEXTS]),
        (f'<body><article class="post comments-open"><h1>T</h1>{LONG}</article></body>', ["T", *TEXTS]),
        # its own headings and sections, whose names are subjects
        (f'<body><article><h1>T</h1>{LONG}<h2 id="related-work">Related work</h2><p>Others.</p><h2 id="social-structure">Social structure</h2></article></body>', ["T", *TEXTS, "Related work", "Others.", "Social structure"]),
        (f'<body><article><h1>T</h1>{LONG}<section id="discussion"><h2>Discussion</h2><p>We find it so.</p></section></article></body>', ["T", *TEXTS, "Discussion", "We find it so."]),
        (f'<body><article><h1>T</h1>{LONG}<p class="promo-free">No promises.</p><div class="banner-history">Of flags.</div></article></body>', ["T", *TEXTS, "No promises.", "Of flags."]),
        (f'<body><article><h1>T</h1><p>Short.</p><div class="discussion">{LONG}</div></article></body>', ["T", "Short.", *TEXTS]),
        (f'<body><article><h1>T</h1>{LONG}<div class="related-posts"><p>More of it</p></div><div class="share-buttons">Share</div><div class="ad-slot">Buy</div><p id="ad-2">Buy</p></article></body>', ["T", *TEXTS]),
        (f'<body><div class="content"><h1>T</h1>{LONG}<h2 id="form-and-content">Form</h2><p>And so on.</p></div></body>', ["T", *TEXTS, "Form", "And so on."]),
        ("<body><article><table><tr><td>one<td>two<tr><td>three</table></article></body>", ["one", "two", "three"]),
        ("<body><dl><dt>a<dd>b<dt>c</dl><p>x<b>y</p>z</b> w</body>", ["a", "b", "c", "xy", "z w"]),
    ],
)
def test_marks_are_signs_only(page, want):
    assert html_extract.extract(page, []).split("\n\n") == want


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<ul><li>", "<div class=x><p>t", "<b></i>", "<div></span></section>", "<svg><g>", "<li><div>"])
def test_time_is_linear_in_depth(unit):
    page = "<body><p>Text</p>" + unit * (400_000 // len(unit))
    began = time.time()
    assert html_extract.extract(page, ["/body/div", "/div"])
    assert time.time() - began < 20


def test_a_template_s_text_loses_its_votes(spark):
    """A legal notice longer than the articles, in a path of its own, on every page of the host."""
    legal = "".join(f"<p>Clause {k}: nothing said here is binding on anyone at any time or place.</p>" for k in range(12))
    pages = [(k, f"http://h.example/{k}", f"<body><div class=zz><p>{' '.join(f'word{k}x{j}' for j in range(100))}</p></div><div class=yy>{legal}</div></body>") for k in range(20)]
    df = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, text string, paths string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert all(t.startswith(f"word{k}x0 ") and "Clause" not in t for k, t in got.items()) and len(got) == 20
