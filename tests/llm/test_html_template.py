"""The template that pages share decides what is kept."""

import random

from helixspark.llm import html_extraction


def said(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def test_template_decides_inside_articles(spark):
    rng = random.Random(11)
    own = [(said(rng, 30), said(rng, 30)) for _ in range(6)]
    page = "<html><body><nav>Home</nav><article><h1>{}</h1><p>Read our paper every day</p><p>{}</p></article><footer>x</footer></body></html>"
    # An article element that holds only the template's text: the own text stands beside it.
    beside = "<html><body><article><p>Please log in</p></article><div><p>{}</p></div></body></html>"
    rows = [(i, f"http://a/{i}", page.format(*x)) for i, x in enumerate(own)] + [(10 + i, f"http://b/{i}", beside.format(x)) for i, (x, _) in enumerate(own)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(x) for i, x in enumerate(own)} | {10 + i: x for i, (x, _) in enumerate(own)}


def test_copies_are_not_template(spark):
    rng = random.Random(13)
    text, quoted, also = said(rng, 30), said(rng, 9), said(rng, 9)
    own = [said(rng, 30) for _ in range(6)]
    plain = "<body><p>{}</p></body>"
    rows = [(i, f"http://two/{i}", plain.format(text)) for i in range(2)] + [(10 + i, None, plain.format(text)) for i in range(2)]
    # Two of six pages quote a passage of two paragraphs.
    page = "<html><body><div><p>{}</p>{}</div></body></html>"
    rows += [(20 + i, f"http://six/{i}", page.format(x, f"<p>{quoted}</p><p>{also}</p>" if i < 2 else "<p>{}</p><p>{}</p>".format(said(rng, 9), i))) for i, x in enumerate(own)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (0, 1, 10, 11)] == [text] * 4
    assert [got[i] for i in (20, 21)] == [f"{own[i]} {quoted} {also}" for i in range(2)]
