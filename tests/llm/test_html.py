"""Main text of generated pages whose article is known, class names in both directions, other scripts, and time."""

from __future__ import annotations

import html
import random
import time

import pytest

from gleaner.llm import html_text

BODY = "the cat is on the mat and it was good for all of us " * 6
ONE = " ".join(BODY.split())


@pytest.mark.parametrize(
    "name",
    "comment-content comments-main footer-content main-footer main-menu sidebar-content cookie-content user-comments page-footer siteFooter ad-slot related-posts share-links cookieBanner newsletter-signup post-comments".split(),
)
def test_names_of_boilerplate(name):
    inside = f'<article><p>{BODY}</p><div class="{name}"><p>{BODY}x</p></div></article>'
    beside = f'<div><p>{BODY}</p></div><div id="{name}"><p>{BODY}x</p></div>'
    assert html_text.main_text(inside) == html_text.main_text(beside) == ONE
    if "comment" in name:
        assert html_text.main_text(f'<article><p>{BODY}</p></article><div class="{name}"><article>{BODY}x</article></div>') == ONE


@pytest.mark.parametrize("name", "related-work social-science header-image search-results menu-of-the-day ad-free no-sidebar content-with-sidebar entry-header header article-header shareholders".split())
def test_names_that_only_hold_such_a_word(name):
    assert html_text.main_text(f'<article><p>{BODY}</p><div class="{name}"><p>{BODY}x</p><p>Short one.</p></div></article>') == f"{ONE} {ONE} x Short one."
    if "header" not in name or name == "header-image":
        assert html_text.main_text(f'<div><p>{BODY}</p></div><div class="{name}"><p>{BODY}x</p></div><div><p>{BODY}</p></div>') == f"{ONE} {ONE} x {ONE}"


def test_comments_as_articles():
    page = f'<main><p>{BODY}</p><section class="comments"><article><p>{BODY}x</p></article></section></main><article class="comment"><p>{BODY}</p></article>'
    assert html_text.main_text(page) == ONE


def test_a_script_without_spaces_or_known_stop_words():
    text = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。" * 2
    assert html_text.main_text(f'<nav><a href="/">家</a></nav><div><h1>猫</h1><p>{text}</p></div><div class="sidebar"><p>{text}</p></div><footer>{text}</footer>') == f"猫 {text}"
    finnish = "Talvi tuli aikaisin tänä vuonna, joten kylän lapset laskivat mäkeä joka päivä ennen koulun alkua. " * 4
    assert html_text.main_text(f"<div><p>{finnish}</p></div><aside>{finnish}</aside>") == " ".join(finnish.split())


def generated(rng):
    """(page, its main text): blocks of an article between boilerplate, with inline marks, references and open tags."""
    prose = lambda n: " ".join(rng.choice("the of and is in that it was for cat house river & < é “quoted” blue stone walked slowly".split()) for _ in range(n))
    link = lambda: f'<a href="/{rng.randint(0, 99)}">{html.escape(prose(2))}</a>'
    want, inner = [], []
    for i in range(rng.randint(2, 9)):
        text = prose(rng.randint(40, 90)) if i % 3 == 0 else prose(rng.randint(2, 30))
        shown = html.escape(text)
        words = shown.split(" ")
        if rng.random() < 0.5:
            words[0] = f"<b>{words[0]}</b>"
        if rng.random() < 0.3:
            words[-1] = f"<em class='{rng.choice(['x', 'related-work'])}'>{words[-1]}</em>"
        kind = rng.choice(["p", "p", "li", "h2", "blockquote", "div"])
        inner.append(f"<{kind}>{rng.choice([' ', chr(10), '&nbsp; '])}" + rng.choice([" ", "\n\t"]).join(words) + (f"</{kind}>" if kind != "p" or rng.random() < 0.7 else ""))
        want.append(text)
        if rng.random() < 0.3:
            inner.append(rng.choice([f'<div class="share-links">{link()}{link()}</div>', "<script>var x = '</p>';</script>", f"<form>{prose(40)}</form>".replace("< ", "&lt; "), f'<div class="ad"><p>{html.escape(prose(50))}</p></div>', f"<aside>{html.escape(prose(60))}</aside>", "<!-- <p>not this</p> -->"]))
    around = lambda: rng.choice([f"<nav><ul><li>{link()}<li>{link()}</ul></nav>", f"<header><p>{html.escape(prose(30))}</p></header>", f'<div id="cookieBanner">{html.escape(prose(50))}</div>', f'<div class="sidebar-content"><p>{html.escape(prose(70))}</p></div>'])
    end = rng.choice([f"<footer>&copy; {html.escape(prose(20))}</footer>", f'<section class="comments"><p>{html.escape(prose(80))}</p></section>'])
    tag = rng.choice(["article", "main"])
    page = f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body>{around()}{around()}<{tag}>{''.join(inner)}</{tag}>{end}</body></html>"
    return page, " ".join(" ".join(t.split()) for t in want)


def test_generated_pages():
    rng = random.Random(5)
    for _ in range(400):
        page, want = generated(rng)
        assert html_text.main_text(page) == want, page


def test_time_is_in_proportion():
    for unit in ("<b>x ", "<i></b>x", "<div>", "</div>", "<![CDATA[x", "<head>", "<p class='a b'>x", "<a href='y'>", "<ul><li>", "<!--", "&amp", "<p a='>"):
        took = []
        for n in (4_000, 32_000):
            start = time.perf_counter()
            html_text.main_text(unit * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 20 * took[0] + 0.3, (unit, took)
