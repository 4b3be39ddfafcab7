"""Pages without main content: what recurs on different pages goes, whatever its length or the host's size."""

import pytest

from test_html_templates import own, texts

NOTICE = "This long legal notice stands under each page of the site and has far more words than any paragraph of theirs. " * 3
OTHER = "Another notice, longer too than each paragraph, stands at the top of every page that the site shows to anyone. " * 3


def test_notices_longer_than_the_text(spark):
    out = texts(spark, [f"<div>{OTHER}</div><div><p>{own(i)}</p></div><div>{NOTICE}</div>" for i in range(6)])
    assert all(out[i] == own(i) for i in range(6))


def test_copies_of_a_page_stay(spark):
    same = "".join(f"<p>{own(k)} {own(k)} {own(k)} {own(k)}</p>" for k in range(3))
    out = texts(spark, [f"<div>{same}</div><i>{i} views</i>" for i in range(8)])
    assert all(own(2) in out[i] for i in range(8))


@pytest.mark.parametrize("most_sent", [200_000, 0])
def test_footer_of_a_section_on_a_large_host(spark, most_sent):
    out = texts(spark, [f"<div><p>{own(i)}</p></div>" + ("<div>Section end</div>" if i < 6 else "") for i in range(1500)], most_sent=most_sent)
    assert len(out) == 1500 and all(out[i] == own(i) for i in range(1500))
