"""Ordinary pages: footers of any length, short last sections, leads, footnotes and titles of an article."""

import pytest

from segmentry.llm import html_text


def words(n):
    return " ".join(["Some words, here."] * (n // 18 + 1))[:n].strip()


@pytest.mark.parametrize("own", [60, 138, 900])
@pytest.mark.parametrize("other", [0, 640, 1280, 2560, 5120, 50_000])
@pytest.mark.parametrize("tag", ["footer", "nav", "aside"])
def test_other_parts_of_any_length_move_nothing(own, other, tag):
    page = f"<body><main><p>{words(own)}</p></main><{tag}><p>{words(other)}</p></{tag}></body>"
    assert html_text.main_text(page) == words(own)


@pytest.mark.parametrize("last", [8, 29, 65, 400])
def test_a_short_last_section_stays(last):
    page = f'<article><div class="a"><p>{words(500)}</p><p>{words(600)}</p></div><div class="b"><h2>Sub</h2><p>{words(last)}</p></div></article><footer><p>{words(900)}</p></footer>'
    assert html_text.main_text(page) == "\n\n".join([words(500), words(600), "Sub", words(last)])


def test_lead_byline_and_footnotes_stay():
    body = f"<div class='t'><p>{words(500)}</p><p>{words(600)}</p></div>"
    page = f'<article><div class="lead"><p>{words(40)}</p></div><p class="byline">By A. B.</p>{body}<section class="footnotes"><p>{words(80)}</p></section></article>'
    assert html_text.main_text(page) == "\n\n".join([words(40), "By A. B.", words(500), words(600), words(80)])


def test_the_title_in_an_articles_own_header():
    page = f"<header><h1>Site</h1></header><article><header><h1>Mine</h1></header><div><p>{words(500)}</p><p>{words(600)}</p></div></article>"
    assert html_text.main_text(page) == "\n\n".join(["Mine", words(500), words(600)])
    outside = f"<header><h1>Site</h1></header><div><p>{words(500)}</p><p>{words(600)}</p></div>"
    assert html_text.main_text(outside) == "\n\n".join([words(500), words(600)])


def test_pages_of_nothing_else_have_no_article():
    assert html_text.main_text(f"<nav><a href=x>x</a></nav><footer><p>{words(300)}</p></footer>") == ""


def test_comments_in_an_article_still_go():
    page = f'<article><p>{words(500)}</p><p>{words(600)}</p><section id="comments"><p>I think so.</p></section><aside><p>{words(700)}</p></aside></article>'
    assert html_text.main_text(page) == "\n\n".join([words(500), words(600)])
