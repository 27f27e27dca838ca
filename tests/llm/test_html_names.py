"""Names of enclosing elements and of paragraphs don't cost an article its text; containers of other matter do."""

import pytest

from helixspark.llm.html_extraction import slots


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>Hello world</p></article></div>', "Hello world"),
        ('<div id="page-with-menu"><main><p>a</p></main></div>', "a"),
        ('<article><p class="share">a</p><h2 class="section-related">b</h2></article>', "a b"),
        ("<article><p>x<math><mi>y</mi></math></p></article>", "xy"),
        ('<article><p>a</p><div class="share">no</div><section class="related">no</section><p>b</p></article>', "a b"),
        ('<div class="sidebar"><article><p>a</p></article></div>', "a"),
        ("<aside><article><p>no</p></article></aside><main><p>a</p></main>", "a"),
        ("", ""),
        ("<article>" + "<p>w</p>" * 20_000 + "</article>", " ".join("w" * 20_000)),
    ],
)
def test_names(page, want):
    assert slots(page, set()) == want
