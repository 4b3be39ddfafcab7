"""Recurring subtrees inside main content, and names around it."""

from tracelake.llm import html_text

SCHEMA = "page_id long, url string, html string"


def own(i):
    return f"Page {i} tells at some length what only page {i} has to tell, with {i * 7919} reasons and more."


def texts(spark, pages, host="h.org", **more):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_box_inside_article(spark):
    box = "<div class='zq1'><p>Get our letter every week.</p></div>"
    pages = [f"<article><h1>Title</h1><p>{own(i)}</p>{box}<h2>Notes</h2><p>Some <b>bold</b> words of {own(i + 100)}</p></article>" for i in range(6)]
    pages += [f"<main><p>{own(i)}</p>{box}</main>" for i in range(6, 12)]
    out = texts(spark, pages)
    assert all(out[i] == f"Title\n\n{own(i)}\n\nNotes\n\nSome bold words of {own(i + 100)}" for i in range(6))
    assert all(out[i] == own(i) for i in range(6, 12))


def test_edited_copies_keep_their_text(spark):
    same = "".join(f"<p>{own(k)}</p>" for k in range(4))
    out = texts(spark, [f"<article>{same}<p>{own(50 + i)}</p></article>" for i in range(8)])
    assert all(out[i].split("\n\n") == [*map(own, range(4)), own(50 + i)] for i in range(8))


def test_names_do_not_remove_the_article(spark):
    out = texts(spark, [
        f"<div class='site-header-menu'><article><p>{own(0)}</p></article></div>",
        f"<form id='form'><h1>T</h1><p>{own(1)}</p><div class='comments'>no</div></form>",
        f"<main><p>{own(2)}</p><p>{own(3)}</p><div class='comments'><article>{own(4)}</article></div></main>",
        f"<main>Site<div class='widget'><article>{own(5)}</article></div></main>",
    ])
    assert out == {0: own(0), 1: f"T\n\n{own(1)}", 2: f"{own(2)}\n\n{own(3)}", 3: own(5)}
