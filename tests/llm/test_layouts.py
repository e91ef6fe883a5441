"""Main text of hand-written layouts: exactly the article, whatever surrounds it."""

import pytest

from whorl.llm.html_text import extract

ONE = "Long words of a story, told in many sentences, that go on and on for a while, and then some more. " * 3
TWO = "Another part of it, with commas, and more to read, until the end of the page is near, or so it seems. " * 3
SAID = "I am a reader, and I say, this is a remark that goes on, and on, and does not end for quite a long time. " * 3
ONE, TWO, SAID = ONE.strip(), TWO.strip(), SAID.strip()
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
WANT = f"{ONE} {TWO}"
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
SIDE = "<ul><li><a href=1>First other story</a></li><li><a href=2>Second other story</a></li></ul>"
FOOT = "<footer><p>All rights reserved, by the publisher, since the year of its foundation.</p></footer>"

LAYOUTS = {
    "wrapper that says what it has": f'<div class="has-sidebar">{BODY}</div>',
    "wrapper that says what it lacks": f'<div class="layout-no-sidebar">{BODY}</div>',
    "wrapper free of adverts": f'<div class="ad-free-article">{BODY}</div>',
    "wrapper with a word at the start": f'<div id="share-story">{BODY}</div>',
    "page-wide form": f'<form action="/p"><input name="q" value="typed"><div>{BODY}</div></form>',
    "page-wide form around an article": f"<form>{MENU}<article>{BODY}</article></form>",
    "remarks under the post": f'<div class="post">{BODY}</div><div class="post-comments-list"><div><p>{SAID}</p></div></div>',
    "articles as remarks": f'<article>{BODY}</article><div id="comments" class="comments-area"><ol><li><article class="comment-body"><p>{SAID}</p><p>{SAID}</p></article></li></ol></div>',
    "more remarks than text": f'<div class="story">{BODY}</div><section class="reader-comments">' + f"<div><p>{SAID}</p></div>" * 9 + "</section>",
    "discussion thread": f'<main>{BODY}</main><div id="disqus_thread"><p>{SAID}</p></div>',
    "menu and footer": f"<header><h1>The Paper</h1>{MENU}</header><main>{BODY}</main>{FOOT}",
    "two columns": f'<div class="columns"><div class="content">{BODY}</div><div class="sidebar"><h3>More</h3>{SIDE}</div></div>',
    "sidebar with a longer name": f'<div class="columns"><div class="content">{BODY}</div><div class="sidebar-content"><p>Read, share, and enjoy, our other stories.</p></div></div>',
    "aside": f"<article>{BODY}<aside><p>{SAID}</p></aside></article>",
    "cookie notice": f'<div class="cookie-notice"><p>We use cookies, for good reasons, as everyone does, on all of our pages, all of the time.</p></div><div>{BODY}</div>',
    "newsletter form": f'<div>{BODY}<form class="newsletter"><label>Your mail</label><input><button>Send</button></form></div>',
    "contact form": f"<div>{BODY}</div><form><p>Write to us, and we may answer.</p><textarea></textarea></form>",
    "hidden parts": f'<div>{BODY}<div style="display: none"><p>{SAID}</p></div><div hidden><p>{SAID}</p></div><div aria-hidden="true"><p>{SAID}</p></div></div>',
    "roles": f'<div role="banner"><p>The Paper, since long ago, for all.</p></div><div role="main">{BODY}</div><div role="contentinfo"><p>{SAID}</p></div>',
    "scripts and styles": f'<style>p {{ color: red }}</style><div><script>if (a < b) write("<p>{SAID}</p>")</script>{BODY}</div>',
    "promotion box": f'<article><p>{ONE}</p><div class="promo"><p>Buy this, or that, today, and save.</p></div><p>{TWO}</p></article>',
    "related stories": f'<article>{BODY}</article><section class="related-stories">{SIDE}</section>',
    "tags and sharing": f'<article>{BODY}<ul class="tags"><li><a href=t>one</a></li></ul><div class="social-share"><a href=s>Share</a></div></article>',
    "breadcrumbs": f'<div class="breadcrumbs"><a href=/>Home</a> / <a href=/n>News</a></div><div id="content">{BODY}</div>',
    "old table layout": f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{BODY}</td></tr></table>",
    "layout word on a remark-free page": f'<div class="no-comments">{BODY}</div>',
    "modal in front": f'<div class="modal"><p>Sign up, please, now.</p></div><div class="page"><div class="inner">{BODY}</div></div>',
    "comments in the markup": f"<!-- <p>{SAID}</p> --><div><!--x-->{BODY}<!-- end --></div>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    assert extract(f"<html><head><title>T</title></head><body>{LAYOUTS[name]}</body></html>") == WANT


def test_all_text_under_a_boilerplate_name_is_better_than_none():
    assert extract(f'<div class="sidebar">{BODY}</div>') == WANT
    assert extract(f'<div class="comments">{BODY}</div>') == WANT
    assert extract(f"<form><p>{ONE}</p></form>") == ONE


def test_pages_without_main_text_are_empty():
    for page in ("", "<html></html>", MENU + FOOT, "<script>x</script><style>y</style>", "<img src=a><br>", f"<header>{MENU}</header>"):
        assert extract(page) == ""
