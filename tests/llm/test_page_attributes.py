"""Attributes that tell of an element's place on a page."""

import random
import time

import pytest

from crossweave.llm import html_text

ARTICLE = "A paragraph of the article that is long enough to count as its text, with more than a few words, so that nothing but its place can speak against it."


@pytest.mark.parametrize("attrs", ['class="post-content" style="overflow:hidden"', 'class="post-content" aria-hidden="false"', 'class="content has-sidebar"', 'class="entry_content no-comments" data-x="hidden"'])
def test_an_articles_element_is_kept(attrs):
    assert html_text.main_text(f"<body><div {attrs}><p>{ARTICLE}</p></div></body>") == ARTICLE


@pytest.mark.parametrize("attrs", ["hidden", 'hidden=""', 'class="post-content" hidden', 'aria-hidden="true"', 'style="display: none"', 'class="post-share"', 'class="content sidebar"'])
def test_an_element_beside_the_article_is_dropped(attrs):
    assert any(html_text._names(attrs)[:2])
    assert html_text.main_text(f"<body><article><p>{ARTICLE}</p></article><div {attrs}><p>Other {ARTICLE}</p></div></body>") == ARTICLE


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content no-sidebar"><p>%s</p></div>', '<div class="site no-banner"><p>%s</p></div>', '<div class="post sharing-economy"><p>%s</p></div>',
        '<div id="main"><section class="legal-text"><p>%s</p></section></div>', "<form><div><p>%s</p></div></form>", '<form id="aspnetForm"><article><p>%s</p></article></form>',
        '<div class="has_banner"><nav><a href=x>Home</a></nav><p>%s</p></div>',
    ],
)
def test_loose_names_and_forms_dont_cost_the_article(page):
    assert html_text.main_text(f"<html><body>{page % ARTICLE}</body></html>") == ARTICLE


COMMENT = "Nice post, thank you for it."


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>%s</p><section><article><p>%s</p></article><article><p>So do I.</p></article></section></article>", '<main><article><p>%s</p></article><article class="comment"><p>%s</p></article></main>',
        '<article><p>%s</p><div class="responses"><p>%s</p></div></article>', '<article><p>%s</p><ul class="discussion"><li>%s</li></ul></article>', '<article><p>%s</p></article><article class="ad"><p>%s</p></article>',
        "<article><p>%s</p></article><article hidden><p>%s</p></article>", '<div><p>%s</p></div><div class="CookieConsent"><p>%s</p></div>', '<div><p>%s</p></div><ol class="commentlist"><li>%s</li></ol>',
        "<article><p>%s</p>" + '<div class="social-wrap">' * 12 + "<p>%s</p>" + "</div>" * 12 + "</article>",
    ],
)
def test_comments_adverts_and_hidden_articles_go(page):
    assert html_text.main_text(f"<html><body>{page % (ARTICLE, COMMENT)}</body></html>") == ARTICLE


@pytest.mark.parametrize("name", ["social", "widget", "banner", "promo", "navigation"])
def test_a_wrapper_of_the_whole_page_is_kept(name):
    assert html_text.main_text(f'<body><div class="{name}"><p>{ARTICLE}</p></div></body>') == ARTICLE
    assert html_text.main_text(f"<body><header><p>{ARTICLE}</p></header></body>") == ARTICLE


@pytest.mark.parametrize("depth", [7, 8, 40])
def test_a_box_beside_the_article_goes_at_any_depth(depth):
    page = '<div class="social-wrap">' * depth + f'<p>{ARTICLE}</p><div class="related-box"><p>{COMMENT}</p></div>' + "</div>" * depth
    assert html_text.main_text(f"<body>{page}</body>") == ARTICLE


def test_articles_inside_an_empty_one_are_kept():
    assert html_text.main_text(f"<article><h1>News</h1><article><p>{ARTICLE}</p></article><article><p>{ARTICLE}</p></article></article>") == f"News\n{ARTICLE}\n{ARTICLE}"
    assert html_text.main_text(f'<article><p>{ARTICLE}</p><section id="discussion"><p>{COMMENT}</p></section></article>') == f"{ARTICLE}\n{COMMENT}"
    assert html_text.main_text(f'<main class="main sidebar"><p>{ARTICLE}</p></main>') == ARTICLE


def test_scripts_without_spaces():
    text = "这是一篇关于天气的文章，它足够长，可以算作正文，而且没有任何空格。"
    menu = "<ul>" + "".join(f"<li><a href=/{i}>栏目</a>" for i in range(6)) + "</ul>"
    assert html_text.main_text(f"<body>{menu}<div><p>{text}</p><p>{text}</p></div>{menu}</body>") == f"{text}\n{text}"


def test_inline_mathematics_stay():
    assert html_text.main_text(f"<article><p>{ARTICLE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == f"{ARTICLE} x=2"


def test_neighbours_decide_on_pages_without_marks():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(6)) + "</ul>"
    page = f"<html><body>{menu}<div>{ARTICLE}</div><p>\"Yes.\"</p><p>He left.</p><p>{ARTICLE}</p>{menu}<div>Contact us</div><ul><li><a href=/q>Imprint</a></ul></body></html>"
    assert html_text.main_text(page) == f'{ARTICLE}\n"Yes."\nHe left.\n{ARTICLE}'
    assert html_text.main_text(f"<body>{menu}<p>He left</p>{menu}</body>") == ""


def test_generated_pages_give_their_article_back():
    """Pages put together from known parts, with the article marked in many ways or not at all."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijk", k=rnd.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(9, 60))).capitalize() + rnd.choice(".!?")
    marks = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content" class="has-sidebar"><section>', "</section></div>"), ("<div>", "</div>")]
    beside = ['<nav><ul><li><a href="/">{}</a></ul></nav>', '<div class="cookie-banner">{}</div>', "<aside><p>{}</p></aside>", "<footer>{}</footer>", '<div class="ads">{}</div>', "<script>var x = '{}';</script>", "<!-- {} -->", '<section id="comments"><p>{}</p></section>', '<div hidden>{}</div>', "<form><input><p>{}</p></form>"]
    for _ in range(300):
        paragraphs = [sentence() for _ in range(rnd.randint(3, 9))]
        a, b = rnd.choice(marks)
        some = ["".join(x.format(sentence()) for x in rnd.sample(beside, rnd.randint(0, 4))) for _ in range(2)]
        inner = "".join(f"<p>{x}</p>" if rnd.random() < 0.8 else f"<div>{x}</div>" for x in paragraphs)
        page = f"<html><head><title>t</title></head><body>{some[0]}{a}{inner}{b}{some[1]}</body></html>"
        assert html_text.main_text(page) == "\n".join(paragraphs), page


@pytest.mark.parametrize("part", ["<script", "<a b='", "<div>", "</x>", "<p class='", "<", "<!--", "<svg>", "<button>", "<p>x", "<b><div>", "&#", '<form class="ad">x'])
def test_hostile_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part)) + '"' + "</x></b>" * 1000
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 12
