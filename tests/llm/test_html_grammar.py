"""Quotes, slashes, depth and names in the markup of pages."""

from test_html_templates import own, texts


def test_quotes_open_values_only(spark):
    out = texts(spark, [
        "<p title=it's>Hello world</p><p>Second block</p>",
        "<p title='a>b' data-x=\"c>d\">One</p><p>Two</p>",
        "<p title=\"never closed>One</p><p>Two</p>",
        "<article><p>See <a href=http://x/>this link</a> and more</p><p>end</p></article>",
        "<p data-class='comments' title='class=menu'>Kept</p>",
        "<p>5 < 6 and a <b>b</b></p>",
    ])
    assert out == {0: "Hello world\n\nSecond block", 1: "One\n\nTwo", 2: "One\n\nTwo", 3: "See this link and more\n\nend", 4: "Kept", 5: "5 < 6 and a b"}


def test_depth_has_no_bound(spark):
    n = 10_000
    out = texts(spark, [
        "<div>" * n + own(0) + "</div>" * n + "<p>after</p>",
        "<article>" + "<span>" * n + own(1) + "</span>" * n + "<p>after</p></article>",
        "<div>" * n + "<p>one</p><p>two</p>" + "<nav>menu</nav>" + "</div>" * n + "<p>after</p>",
    ])
    assert out == {0: f"{own(0)}\n\nafter", 1: f"{own(1)}\n\nafter", 2: "one\n\ntwo\n\nafter"}


def test_names_inside_an_article(spark):
    keep = "<h2 id='related-work'>Related work</h2><section id='search'><p>How we search</p></section><div class='image-meta'>Photo: us</div>"
    gone = "<div class='comments'><p>first!</p></div><div class='ad-slot'>Buy</div><form>Name</form><aside>More</aside>"
    out = texts(spark, [f"<article><p>{own(0)}</p>{keep}{gone}</article>"])
    assert out[0] == f"{own(0)}\n\nRelated work\n\nHow we search\n\nPhoto: us"
