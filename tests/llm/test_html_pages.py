"""Pages that are long, deep or badly closed, and boxes by name inside an article."""

import random
import time

import pytest

from tracelake.llm import html_text as H


def text(page):
    return "\n\n".join(H.blocks_of(*H.read_page(page), frozenset()))


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- a --!>", "<!-- a -->", "<!---->", "<!-- > -- ->-->"])
def test_comments_end_as_in_browsers(comment):
    assert text(f"<article><p>One</p>{comment}<p>Two</p></article>") == "One\n\nTwo"


@pytest.mark.parametrize("box", ['div class="form-factor"', 'div class="social-contract"', 'div class="side menu-item"', 'section class="notice"', 'div class="note ad-hoc"'])
def test_names_that_only_hold_a_word_stay(box):
    tag = box.split()[0]
    assert text(f"<article><p>One</p><{box}><p>Two</p></{tag}></article>") == "One\n\nTwo"


@pytest.mark.parametrize("box", ['div class="share-buttons"', 'section class="comments"', 'div class="x cookie-notice"', 'aside', 'form', 'div class="ad_slot"', 'ul class="social"'])
def test_boxes_go(box):
    tag = box.split()[0]
    assert text(f"<article><p>One</p><{box}><p>Two</p></{tag}><p>Three</p></article>") == "One\n\nThree"


def test_many_open_and_wrong_end_tags_take_little_time():
    pages = ["<i>" * 20_000 + "</b>" * 20_000 + "x", "<div>" * 50_000 + "x" + "</div>" * 50_000, "<p><b>" * 30_000 + "x", "<nav>" * 30_000 + "x</p>" * 30_000, "".join(random.Random(1).choice(["<div>", "</div>", "<p>", "</i>", "<i>", "<li>", "</ul>", "w ", "<!--", "-->", '<a b="', "<td>"]) for _ in range(200_000))]
    for page in pages:
        began = time.time()
        H.read_page(page)
        assert time.time() - began < 15


def test_below_the_depth_text_stays_and_what_is_left_out_goes():
    deep = "<div>" * (H.MOST_DEPTH + 50)
    shut = "</div>" * (H.MOST_DEPTH + 50)
    assert text(f"<article>{deep}One<nav>menu<div>more</div></nav> two<p>Three</p>{shut}<p>Four</p></article>") == "One\n\ntwo\n\nThree\n\nFour"
    assert text(f"<article>{deep}<nav><nav>menu</nav>menu</nav>One{shut}</article><footer>end</footer>") == "One"
