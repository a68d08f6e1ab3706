import html
import re
import time
from collections import Counter

import pytest

from evisparq.llm import registry
from evisparq.llm.html_text import extract, main_text

PROSE = "This is a sentence of some length, with commas, and with more words than a menu would have."


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


def test_templates():
    want = "\n".join([PROSE + " 1", PROSE + " 2 & \xe9"])
    paragraphs = f"<p>{PROSE} 1</p><p>{PROSE}\n <b>2</b> &amp; &eacute;</p>"
    nav = "<nav><ul><li><a href='/a'>One, two, three</a></li></ul></nav><header><p>Site header, with, commas</p></header>"
    after = "<aside><p>Side, bar, text, that, is, long enough to count as prose, really.</p></aside><footer>&copy; all, rights</footer>"
    for body in (
        f"{nav}<article>{paragraphs}</article>{after}",
        f"{nav}<div id='content'>{paragraphs}</div><div class='sidebar'><p>{PROSE}</p></div>{after}",
        f"{nav}<main><section>{paragraphs}</section><div class='comments'><p>{PROSE} by a reader</p></div></main>{after}",
        f"<div class='wrap'>{nav}<div class='post'>{paragraphs}<div class='ad'>Buy, buy, buy</div><form><p>Name, mail</p></form></div><div class='cookie-notice'><p>{PROSE}</p></div></div>{after}",
        f"{nav}{paragraphs}{after}",
        f"<div class='menu'><a href='#'>{PROSE}</a></div><table><tr><td><div>{paragraphs}</div></td></tr></table>",
        f"<div class='page with-sidebar no-comments'>{nav}<div class='text'>{paragraphs}</div></div>{after}",
        f"<div id='cookie-wrapper'><article class='post'>{paragraphs}</article></div><div id='discussion'><article class='comment-body'><p>{PROSE}, {PROSE}, {PROSE}</p></article></div>",
        f"<main><ul><li><a href='#'>Home, page</a></li><li><a href='#'>News</a></li></ul>{paragraphs}<div><a href='#'>Next</a> <a href='#'>Previous</a></div></main>",
        f"<section id='comments'><p>{PROSE}</p></section><div><p>{PROSE} 1<p>{PROSE} 2 &amp; &#233;</div>",
    ):
        assert main_text(page(body)) == want, body


def test_words_inside_attribute_values_are_not_attributes():
    want = "\n".join([f"{PROSE} linked", PROSE])
    for attrs in ('href="/blog/hidden-costs"', 'href="view.php?id=search"', "title='the hidden truth'", 'data-id="menu"', 'data-title="a hidden, class=menu role"', "href=/hidden", "data-class=comments", 'title=""', "a = 'x' b=\"id='menu'\""):
        assert main_text(page(f"<article><p>{PROSE} <a {attrs}>linked</a></p><p {attrs}>{PROSE}</p></article>")) == want, attrs
        assert main_text(page(f"<article {attrs}><p>{PROSE} linked</p><p>{PROSE}</p></article>")) == want, attrs
    for attrs in ("hidden", "HIDDEN=''", "data-x='1' hidden", "title=\"a\"class='menu'", "id = menu", "href=/a aria-hidden=true", "style='color:red; display: none'"):
        assert main_text(page(f"<article><p>{PROSE} linked</p><p>{PROSE}</p><p {attrs}>{PROSE}</p></article>")) == want, attrs


def test_forms_and_named_containers_are_judged_by_their_content():
    want = "\n".join(["Head", PROSE + " 1", PROSE + " 2", PROSE + " 3"])
    prose = "".join(f"<p>{PROSE} {i}</p>" for i in (1, 2, 3))
    text = f"<h1>Head</h1>{prose}"
    nav = "<nav><a href='/a'>One, two, three</a></nav>"
    for body in (
        f"<form id='aspnetForm'>{nav}<article>{text}</article></form>",
        f"<form action='/x'>{nav}<input type='hidden'><div>{text}</div></form>",
        f"{nav}<div class='elementor-widget-container'>{text}</div>",
        f"{nav}<div><h1 class='page-header'>Head</h1>{prose}</div>",
        f"{nav}<div class='sidebar-layout'><div class='post'>{text}</div><div class='sidebar'><a href='/b'>{PROSE}</a></div></div>",
        f"{nav}<div id='search-results'><div>{text}</div></div>",
        f"{nav}<div class='notice'>{text}</div><form><p>Name, mail</p></form>",
        f"{nav}<div class='comments-page'>{text}</div>",
    ):
        assert main_text(page(body)) == want, body
    shown = f"{nav}<div>{text}</div>"
    for body in (f"<div class='comments'>{prose * 3}</div>", f"<div class='cookie-notice'>{prose * 3}</div>", f"<div class='widget'><a href='#'>{PROSE * 4}</a></div>", f"<form><p>{PROSE}</p></form>", f"<div hidden>{prose * 3}</div>"):
        assert main_text(page(shown + body)) == want, body


def test_parts_of_an_article_stay():
    for body, want in (
        (f"<article><p>{PROSE}</p><ul><li><a href='/r1'>Reference one of the article</a></li><li><a href='/r2'>Two</a></li></ul></article>", f"{PROSE}\nReference one of the article\nTwo"),
        (f"<main><p>{PROSE}</p><ol><li><a href='/r1'>A reference of some length, 2010</a></li></ol></main>", f"{PROSE}\nA reference of some length, 2010"),
        (f"<article><p>{PROSE}</p><p class='notice-board'>{PROSE} 2</p></article>", f"{PROSE}\n{PROSE} 2"),
        (f"<article><div class='post-header'><h1>Headline</h1></div><p>{PROSE}</p></article>", f"Headline\n{PROSE}"),
        (f"<article><header><nav>x</nav><h1>Headline</h1><p>By a writer</p></header><p>{PROSE}</p></article>", f"Headline\n{PROSE}"),
        (f"<main><article><p>{PROSE}</p></article><article><p>{PROSE} 2</p></article></main>", f"{PROSE}\n{PROSE} 2"),
        (f"<h1>Site</h1><article><h1>Head</h1><p>{PROSE}</p></article>", f"Head\n{PROSE}"),
        ("<article><h1>Head alone</h1></article>", "Head alone"),
    ):
        assert main_text(page(body)) == want, body


def test_a_name_alone_drops_no_prose_of_an_article():
    for part in (
        '<section id="discussion">', '<section id="related-work">', '<div class="discussion">', '<section class="related-work section">', '<div class="newsletter-issue">', '<section class="advertising-law">', '<div id="comment-analysis">', '<div class="form-of-the-poem">', '<section class="search-methods">', '<div class="share-of-voters">',
    ):
        for mark in ("article", "main"):
            tag = part[1:].split()[0]
            want = f"{PROSE} 1\nHead\n{PROSE} 2"
            assert main_text(page(f"<{mark}><p>{PROSE} 1</p>{part}<h2>Head</h2><p>{PROSE} 2</p></{tag}></{mark}>")) == want, part
    for p in ('<p class="comment">', '<blockquote class="reply">', '<p class="advert">'):
        assert main_text(page(f"<article><p>{PROSE} 1</p>{p}{PROSE} 2</article>")) == f"{PROSE} 1\n{PROSE} 2", p
    # boxes go all the same
    for box in (
        f'<div class="comments"><p>{PROSE} by a reader</p></div>', f'<section id="comments-section"><div class="comment-body"><p>{PROSE}</p></div></section>', f'<div class="newsletter-box"><p>{PROSE}</p></div>', f'<div class="newsletter-issue"><p>{PROSE}</p><form><input><button>Go</button></form></div>',
        '<div class="related-posts"><a href="/x">One of the other posts here</a></div>', f'<div class="ad-slot">{PROSE}</div>', f'<div id="disqus_thread">{PROSE}</div>', '<div class="share-tools">Share, like</div>', '<div class="cookie-consent">We use cookies for this page and its readers, as you may know, and more.</div>',
    ):
        assert main_text(page(f"<article><p>{PROSE} 1</p><p>{PROSE} 2</p>{box}</article>")) == f"{PROSE} 1\n{PROSE} 2", box


def test_formulas_leads_and_announced_lists_stay():
    assert main_text(page(f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p></article>")) == f"{PROSE} x=2"
    assert main_text(page(f"<article><header><h1>Head</h1><p class='lead'>{PROSE} lead</p><p>By a writer</p></header><p>{PROSE}</p></article>")) == f"Head\n{PROSE} lead\n{PROSE}"
    assert main_text(page(f"<div><p>{PROSE}</p><p>{PROSE} See also:</p><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div>")) == f"{PROSE}\n{PROSE} See also:\nOne\nTwo"


#: Layouts as publishing systems make them; %s is the article.
LAYOUTS = {
    "blog": "<body class='home blog'><div id='page' class='site'><header id='masthead' class='site-header'><h1>Blog</h1><nav id='site-navigation'><ul><li><a href='/'>Home</a></li></ul></nav></header><div id='content'><main id='main' class='site-main'><article id='post-1' class='post type-post'><header class='entry-header'><h1 class='entry-title'>{head}</h1><div class='entry-meta'>Posted by x</div></header><div class='entry-content'>{text}</div><footer class='entry-footer'><a href='/c'>Category</a></footer></article><div id='comments' class='comments-area'><ol class='comment-list'><li class='comment'><p>{other}</p></li></ol><div id='respond'><form><textarea></textarea></form></div></div></main></div><aside id='secondary' class='widget-area'><section class='widget'><ul><li><a href='/r'>Recent</a></li></ul></section></aside><footer id='colophon'>Powered by x</footer></div>",
    "wiki": "<body><div id='mw-navigation'><div id='p-personal'><a href='/l'>Log in</a></div></div><div id='content' class='mw-body' role='main'><h1 id='firstHeading'>{head}</h1><div id='bodyContent'><div id='mw-content-text'><div class='mw-parser-output'>{text}</div></div></div></div><div id='mw-panel'><ul><li><a href='/m'>Main page</a></li></ul></div><div id='footer' role='contentinfo'>Text is available under a licence, with terms.</div>",
    "hosted blog": "<body><div class='navbar section'><a href='/n'>Next blog</a></div><div class='content-outer'><div class='main-outer'><div class='post hentry'><h3 class='post-title entry-title'>{head}</h3><div class='post-body entry-content'>{text}</div><div class='post-footer'>Posted at noon</div></div></div><div class='sidebar section'><div class='widget'><h2>Archive</h2><a href='/a'>2010</a></div></div></div>",
    "news": "<body><div class='topbar'><a href='/s'>Sections</a></div><main><article><header><h1>{head}</h1></header><div class='ad-container'>Advertisement, buy now</div><div class='story-body'>{text}</div><div class='related-links'><a href='/1'>Another story of today</a></div><div class='newsletter-signup'><p>Sign up, please.</p><form><input></form></div></article></main><div class='recirculation recommended'><a href='/2'>Most read, today</a></div><footer>About us</footer>",
    "docs": "<body><div class='related' role='navigation'><ul><li><a href='/i'>index</a></li></ul></div><div class='document'><div class='documentwrapper'><div class='bodywrapper'><div class='body' role='main'><section id='s'><h1>{head}</h1>{text}</section></div></div></div><div class='sphinxsidebar' role='navigation'><h3>Contents</h3><ul><li><a href='#'>Here</a></li></ul></div></div><div class='footer' role='contentinfo'>Copyright, x.</div>",
    "tables": "<body><table width='100%'><tr><td colspan='2'><a href='/'>Logo</a></td></tr><tr><td class='menu'><a href='/a'>One</a><br><a href='/b'>Two</a></td><td><h1>{head}</h1>{text}</td></tr><tr><td colspan='2' class='footer'>Copyright</td></tr></table>",
    "form page": "<body><form id='aspnetForm' method='post'><div id='header'><a href='/'>Home</a></div><div id='main'><div id='ctl00_content'><h1>{head}</h1>{text}</div></div><div id='footer'>Terms, and conditions</div></form>",
    "magazine": "<body><nav class='nav-main'><a href='/'>Home</a></nav><div class='wrapper'><div class='article-hero'><h1>{head}</h1></div><div class='article-body'>{text}</div><div class='share-bar'><a href='#'>Share</a></div><div class='more-stories'><a href='/x'>More stories for you</a></div></div><footer>Imprint</footer>",
    "journal": "<body><header role='banner'><a href='/'>Journal</a></header><main><article class='research'><h1>{head}</h1><section id='abstract'>{text}</section><section id='references'><ol><li>Someone, A title of a work, 2001.</li></ol></section></article></main><aside class='sidebar'><a href='/p'>Download</a></aside>",
    "forum": "<body><div id='nav'><a href='/'>Board</a></div><div class='thread'><h1>{head}</h1><div class='message first'><div class='content'>{text}</div></div></div><div id='foot'>Rules, and help</div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_words_found_in_layouts(name):
    words = lambda t: Counter(re.findall(r"\w+", t))
    prose = [f"{PROSE} Sentence {i} tells of thing{i}, and of matter{i} as well." for i in range(8)]
    text = "".join(f"<p>{x}</p>" + (f"<h2>Part {i}</h2>" if i % 3 == 0 else "") for i, x in enumerate(prose))
    want = words("A headline " + re.sub(r"<[^>]*>", " ", text))
    got = words(main_text("<html><head><title>t</title></head>" + LAYOUTS[name].format(head="A headline", text=text, other="I disagree, and say so here at some length, as readers do.")))
    both = sum((want & got).values())
    assert both / sum(want.values()) > 0.97 and both / sum(got.values()) > 0.95, (got - want, want - got)


def test_a_short_article_wins_over_a_longer_advert():
    for article in ("<h1>Short head, and no more.</h1><p><b>Short head, and no more.<br>", "<h1>Head</h1>"):
        for advert in (f"<div class='ad'>{PROSE}</div>", f"<div class='promo'><p>{PROSE}</p></div>", f"<div class='notice'><p>{PROSE}</p></div>"):
            want = "Short head, and no more.\nShort head, and no more." if "Short" in article else "Head"
            assert main_text(page(f"{advert}<article>{article}</article><footer>&copy; a, b</footer>")) == want
    assert main_text(page(f"<div class='post'><p>{PROSE}</p><p>{PROSE}</p></div><article class='card'><h3><a href='#'>More</a></h3><p>Teaser</p></article>")) == f"{PROSE}\n{PROSE}"


def test_malformed_attributes_leak_nothing():
    assert main_text(page(f'<div><p class="x>Text one, two</p><p class="y">{PROSE}</p></div>')) == f"Text one, two\n{PROSE}"
    assert main_text(page(f"<div><p title=it's>{PROSE}</p><p title='>'>{PROSE}</p><p title=\"a > b\" class=z>{PROSE}</p></div>")) == "\n".join([PROSE] * 3)
    assert main_text(page(f'<div><p class="x>{PROSE}')) == PROSE


@pytest.mark.parametrize("part", ["<div>a, b", "<b><h2>x, y", "<div><li>a, b", "<form><div>a, b", "<div class=menu>a, b", "<article>a, b", "<p class=\"x>a, b", "<main><ul><li><a href=x>y</a>", "<header><article>a", "a</x></section>", "<div><tr><td>a, b"])
def test_pages_of_a_megabyte_in_seconds(part):
    began = time.time()
    main_text(part * (1_000_000 // len(part)))
    main_text("<div>" * 50_000 + part * 20_000)
    assert time.time() - began < 30


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("<nav>menu</nav>") == ""
    assert main_text("<div>" * 5000 + PROSE + "</div>" * 5000) == PROSE
    assert main_text("<article><h1>Head</h1><p><b>a.<br><p>b, &lt;c&gt;  d</p></article>") == "Head\na.\nb, <c> d"
    long_page = "<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>"
    assert main_text(long_page) == "\n".join([PROSE] * 3000)
    assert main_text("<p unclosed " + PROSE) is not None
    rows = [(1, None, None, 0), (None, "u", "<p>" + PROSE, 0), (2, "u", "", 0), (2, "u", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extract(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None, "", 0), (None, "u", PROSE, len(PROSE)), (2, "u", "", 0), (2, "u", "", 0)]))
    assert extract(df.limit(0)).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in registry.queries()["op9_html_text"](spark, at).collect()}
    rows = spark.read.parquet(f"{at}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?p>|</?h1>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in blocks if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_query_equals_sql(compare):
    compare("op9_html_text")
