import html
import random
import time

import numpy as np
from helpers import pages, rows

from itemlab.llm import html_text

WORDS = "lorem ipsum dolor sit amet consectetur sed do eiusmod tempor incididunt ut labore et dolore magna".split()


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def page(rng, clutter=True):
    """A page and its text."""
    title = sentence(rng, 5) + " & co"
    paragraphs = [sentence(rng, rng.randrange(1, 60)) + rng.choice([".", " <3", " “x”", "\n\t z"]) for _ in range(rng.randrange(1, 8))]
    body = f"<h1>{html.escape(title)}</h1>" + "".join(
        f"<p{rng.choice(['', ' class=lead', ' id=x1'])}>" + html.escape(p).replace(" ", rng.choice([" ", "  ", "\n"]), 1) + rng.choice(["</p>", "", "<br>"]) for p in paragraphs
    )
    inside = rng.choice(["<script>var x = '</p><p>no';</script>", "<!-- <p>no</p> -->", '<div class="ad-box">buy this now</div>', "<form><p>name</p><input name=a></form>", "<aside><p>see also this</p></aside>", ""])
    around = (
        '<div class="cookie-notice"><p>we use cookies, accept them all please</p></div>'
        "<header><p>site name and motto</p></header><nav><ul><li><a href=/a>home</a><li><a href=/b>more things</a></ul></nav>"
    )
    after = (
        '<section id="comments"><p>first comment by a reader, quite long, and with many words in it</p></section>'
        '<div class="sidebar"><p>popular today</p></div><footer>&copy; someone &middot; all rights</footer>'
    )
    if not clutter:
        around = after = inside = ""
    text = " ".join(" ".join([title, *paragraphs]).split())
    at = body.index("</h1>") + 5
    full = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{around}<article>{body[:at]}{inside}{body[at:]}</article>{after}</body></html>"
    return full, text


def test_pages_with_clutter(spark):
    rng = random.Random(8)
    made = [page(rng) for _ in range(200)]
    table = pages(spark, [(i, f"u{i}", h) for i, (h, _) in enumerate(made)])
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(table).collect()}
    assert found == {i: (f"u{i}", t, len(t)) for i, (_, t) in enumerate(made)}


def test_awkward_pages(spark):
    long = "<article>" + "<p>many words &amp; more</p>" * 20_000 + "</article>"
    table = pages(spark, [(1, None, None), (1, "u", ""), (2, "u", "<>< <b"), (3, "u", long), (4, "u", "plain text only"), (None, "u", "<p>x<script>never closed <p>y")])
    found = {(repr(r.page_id), r.url): (r.text, r.n_chars) for r in html_text.extract(table).collect()}
    assert found["1", None] == found["1", "u"] == ("", 0)
    assert found["3", "u"][0] == " ".join(["many words & more"] * 20_000)
    assert found["4", "u"] == ("plain text only", 15)
    assert found["None", "u"] == ("x", 1)
    assert rows(html_text.extract(table.limit(0))) == []


def test_hostile_markup_ends():
    for text in ('<a href="' * 20_000, "<p " * 50_000, "<!--" * 50_000, "<script>" * 20_000, "</" * 50_000):
        html_text.main_text(text, {})


def test_unclosed_tags_take_time_in_proportion():
    def seconds(text):
        start = time.process_time()
        html_text.main_text(text, {})
        return time.process_time() - start

    for made in (lambda n: "<b>x" * n, lambda n: "<span>" * n + "</i>y" * n, lambda n: "<div><b>" * n + "</p>z" * n):
        assert seconds(made(80_000)) < 20 * seconds(made(10_000)) + 0.5


def test_names_inside_the_article():
    def text(article):
        made = f"<body><div class='promo teaser'><p>buy this</p></div>{article}<div id=social-bar><p>share it</p></div></body>"
        weights = html_text.weights_from(html_text.page_counts("<nav><li>a b</li></nav><article><h2>t</h2><p>d e f g</p></article>"))
        return html_text.main_text(made, weights)

    assert text('<article class="promo story"><p>one two three</p></article>') == "one two three"
    assert text('<article><h2 id="comments-on-method">on method</h2><p class="social-history">one two</p></article>') == "on method one two"
    assert text('<article class="post category-social"><p>one two</p></article>') == "one two"
    assert text('<main><article><p>one two</p><div class="ad-box"><p>an ad</p></div></article><article class="related promo"><p>more of it</p></article></main>') == "one two"
    assert text('<article><p>one two</p><section id="comments"><h2>what they say</h2><article class="comment depth"><p>nice</p></article></section></article>') == "one two"


def test_pages_without_marked_content():
    weights = html_text.weights_from(html_text.page_counts("<nav><li>a b</li></nav><article><p>d e f g</p></article>"))
    made = "<nav><li>home</li></nav><div id=page><p>one two</p><p>three four</p></div><div class='comment-list'><p>nice</p></div>"
    assert html_text.main_text(made, weights) == "one two three four"


def test_best_run_against_all_runs():
    rng = np.random.default_rng(9)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(0, 12)).astype(float)
        start, stop = html_text.best_run(scores)
        best = max((scores[a:b].sum() for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert scores[start:stop].sum() == max(best, 0)


def test_weights_are_learned():
    counts = html_text.page_counts("<nav><li>a b c</li></nav><article><p>d e f g</p></article><footer>h</footer>")
    weights = html_text.weights_from(counts)
    assert weights["text", "p"] > 0 > weights["text", "li"] and weights["tag", "li"] < weights["tag", "p"] < 0
    assert not html_text.page_counts("<p>no marked content</p>")
