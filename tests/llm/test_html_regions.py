"""HTML extraction: nothing of a named article is lost, names of parts count as a whole, regions against brute force."""

from __future__ import annotations

import html
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import html_extract as H

CHROME = '<nav><ul><li><a href="/">home</a></li><li><a href="/x">more</a></li></ul></nav>'
PAGES = [f"<body>{CHROME}<article><h1>Title {i}</h1><p>Some words of text number {i} in here.</p><p>And more of them.</p></article><footer>end {i}</footer></body>" for i in range(30)]


@pytest.fixture(scope="module")
def weights():
    inside, outside = Counter(), Counter()
    for page in PAGES:
        a, b = H.count_features(page)
        inside += a
        outside += b
    return H.Weights(inside, outside)


ENDS = {
    "<ul><li>one</li><li>two</li></ul>": "one\n\ntwo",
    "<table><tr><td>cell</td><td>other</td></tr></table>": "cell\n\nother",
    "<figure><img src=x><figcaption>caption</figcaption></figure>": "caption",
    "<pre>code</pre>": "code",
    "<p>One</p>": "One",
    "<blockquote>said</blockquote>": "said",
    "<custom-part>odd</custom-part>": "odd",
    "<dl><dt>term</dt><dd>meaning</dd></dl>": "term\n\nmeaning",
}


@pytest.mark.parametrize("part", ENDS)
def test_both_ends_of_an_article_stay(weights, part):
    text = "This is the first longer paragraph of the page."
    for inner, want in ((f"{part}<p>{text}</p>", f"{ENDS[part]}\n\n{text}"), (f"<p>{text}</p>{part}", f"{text}\n\n{ENDS[part]}"), (f"<h1>Oil</h1>{part}<p>{text}</p>", f"Oil\n\n{ENDS[part]}\n\n{text}")):
        assert H.extract(f"<body>{CHROME}<article>{inner}</article><footer>end</footer></body>", weights) == want
        # without a label the scan decides
        assert H.extract(f"<body>{CHROME}<div>{inner}</div><footer>end</footer></body>", weights) == want


def test_names_count_as_a_whole(weights):
    kept = ['<h2 class="post-login">Kept heading</h2>', '<p class="dish-menu">kept words</p>', '<section class="study-cookies">kept section</section>', '<div class="side-effects">kept part</div>', '<table class="menu"><tr><td>kept cell</td></tr></table>'.replace("table class", "table data-class"), '<p id="sidebar">kept by its tag</p>']
    gone = ['<div class="sidebar">x</div>', '<div class="cookie-banner">x</div>', '<section class="related-posts">x</section>', '<ul class="site-nav"><li>x</li></ul>', '<div id="comments">x</div>', '<div class="post-comments">x</div>', '<div class="social-share-buttons sharing">x</div>', '<div role="navigation">x</div>', "<aside>x</aside>", "<form>x</form>"]
    body = "".join(a + b for a, b in zip([*kept, *[""] * 10], gone, strict=False))
    got = H.extract(f"<article><p>A paragraph of the article.</p>{body}</article>", weights)
    assert got == "\n\n".join(["A paragraph of the article.", "Kept heading", "kept words", "kept section", "kept part", "kept cell", "kept by its tag"])


def by_all_regions(page, weights):
    """The text of the best region by trying all of them, those that hold the named element if there is one."""
    found = H.tokens(page)
    scores = [weights.score(k, v, n, len(v.split())) if k != "text" or v.split() else 0.0 for k, v, n in found]
    sums = np.concatenate([[0], np.cumsum(scores)])
    named = H.named_region(found)
    regions = [(a, b) for a in range(len(found) + 1) for b in range(a, len(found) + 1) if not named or (a <= named[0] and b >= named[1])]
    start, end = max(regions, key=lambda r: (round(sums[r[1]] - sums[r[0]], 9), r[0] - r[1], -r[0]))
    if not named and sums[end] - sums[start] <= 0:
        return ""
    out, line = [], ""
    for kind, value, node in found[start:end]:
        if kind == "text" and (node is None or not node.unwanted):
            line += value
        elif kind == "gap" and value == "br":
            line += " "
        elif kind == "break" or (kind in ("open", "close") and node.tag in H._BLOCK):
            out.append(line)
            line = ""
    return "\n\n".join(x for x in (" ".join(html.unescape(x).split()) for x in [*out, line]) if x)


def test_whole_extraction_against_all_regions(weights):
    rng = np.random.default_rng(4)
    parts = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "words of text ", "one ", "&amp; ", "<br>", "<hr>", "<ul><li>", "</li></ul>", "<nav>", "</nav>", "<a href=x>link</a>", "<script>no()</script>", "<h1>Title</h1>", "<unknown>", "</unknown>", "<!-- no -->"]
    for i in range(150):
        page = "".join(rng.choice(parts, int(rng.integers(0, 30))))
        if i % 3 == 0:
            page = "".join(rng.choice(parts, 5)) + f"<article>{page}</article>" + "".join(rng.choice(parts, 5))
        assert H.extract(page, weights) == by_all_regions(page, weights), page


def test_a_page_of_a_megabyte(weights):
    text = "\n\n".join(f"Paragraph {i} of a very long page." for i in range(20_000))
    page = f"<body>{CHROME}<article>" + "".join(f"<p>{x}</p>" for x in text.split("\n\n")) + "</article><footer>end</footer></body>"
    assert len(page) > 800_000 and H.extract(page, weights) == text
