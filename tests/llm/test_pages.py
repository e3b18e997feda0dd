"""Main text of varied pages against the text a reader would copy, block by block."""

import difflib

import pytest

from larkspur.llm import html_text

A = "The river had been rising for three days before anybody in the village thought of moving the animals to the upper fields."
B = "When the water came it came at night, and by the morning the lower road was gone, together with two barns and the old mill."
C = "Nobody was hurt, which the mayor later called a matter of luck and of one dog that would not stop barking at the bridge."
D = "Repairs began in the spring. They cost more than the council had planned, and they are not over yet, as any visitor can see."
SHORT, LINE = "It rained.", "A short line here."
MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Contact"))
PLAIN_MENU = "".join(f'<div><a href="/{x}">{x}</a></div>' for x in ("Home", "News", "Sport", "Contact"))
RELATED = "".join(f'<li><a href="/{k}">Another story about the flood, part {k}</a></li>' for k in range(4))
LEGAL = "© 2024 The Village Paper. All rights reserved."
COOKIE = "We use cookies to give you the best experience on our site and to count visits."


def ps(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


#: (name, html, blocks expected)
PAGES = [
    ("no-sidebar", f'<div class="menu"><ul>{MENU}</ul></div><div class="content no-sidebar"><h1>The flood</h1>{ps(A, B, C)}</div><div class="footer">{LEGAL}</div>', ["The flood", A, B, C]),
    ("social history", f'<div class="nav"><ul>{MENU}</ul></div><div class="post social-history"><h1>The flood</h1>{ps(A, SHORT, B)}</div><div class="site-footer">{LEGAL}</div>', ["The flood", A, SHORT, B]),
    ("social history alone", f'<ul>{MENU}</ul><div class="social-history"><h1>The flood</h1>{ps(A, B, C)}</div>', ["The flood", A, B, C]),
    ("with-sidebar", f'<body><div class="content with-sidebar"><h2>The flood</h2>{ps(A, B)}</div><div class="sidebar"><p>{C}</p></div></body>', ["The flood", A, B]),
    ("no-comments", f'<div class="post no-comments">{ps(A, B, C)}</div><div class="share-buttons"><a href="#">Share</a></div>', [A, B, C]),
    ("article", f"<header><h1>Paper</h1><nav><ul>{MENU}</ul></nav></header><article><h1>The flood</h1>{ps(A, SHORT, B)}</article><footer>{LEGAL}</footer>", ["The flood", A, SHORT, B]),
    ("main", f"<nav><ul>{MENU}</ul></nav><main><h1>The flood</h1>{ps(A, B, LINE)}</main><aside>{ps(C)}</aside><footer>{LEGAL}</footer>", ["The flood", A, B, LINE]),
    ("article header", f"<article><header><h1>The flood</h1></header>{ps(A, B)}</article><footer>{LEGAL}</footer>", ["The flood", A, B]),
    ("advert inside", f'<article><h1>The flood</h1>{ps(A)}<div class="ad">Buy new boots today.</div>{ps(B)}</article>', ["The flood", A, B]),
    ("advert in a paragraph", f'<article><h1>The flood</h1>{ps(A)}<p class="advert">Buy new boots today.</p>{ps(B)}</article>', ["The flood", A, B]),
    ("comments inside", f'<main><h1>The flood</h1>{ps(A, B)}<section id="comments"><h3>Two comments</h3><div class="comment-body">{ps(C)}</div><div class="comment-body">{ps("I saw it too.")}</div></section></main>', ["The flood", A, B]),
    ("comments as articles", f'<article><h1>The flood</h1>{ps(A, B)}</article><section class="comments"><article class="comment">{ps(C)}</article></section>', ["The flood", A, B]),
    ("linked sentence", f'<article><h1>The flood</h1>{ps(A)}<p><a href="/x">Read the report of the council here.</a></p>{ps(B)}</article>', ["The flood", A, "Read the report of the council here.", B]),
    ("linked sentence in plain blocks", f'{PLAIN_MENU}<h1>The flood</h1>{ps(A)}<p><a href="/x">Read the report of the council here.</a></p>{ps(B)}', ["The flood", A, "Read the report of the council here.", B]),
    ("related links", f"<article><h1>The flood</h1>{ps(A, B)}<ul>{RELATED}</ul></article>", ["The flood", A, B]),
    ("related named", f'<div class="entry"><h1>The flood</h1>{ps(A, B)}</div><div class="related-posts"><h3>More</h3><ul>{RELATED}</ul></div>', ["The flood", A, B]),
    ("plain", f"{PLAIN_MENU}<h1>The flood</h1>{ps(A, B, C)}<div>{LEGAL}</div>", ["The flood", A, B, C]),
    ("plain, short paragraphs", f"{PLAIN_MENU}<h1>The flood</h1>{ps(LINE, SHORT, 'The cows went up.', 'So did we.')}<div>{LEGAL}</div>", ["The flood", LINE, SHORT, "The cows went up.", "So did we."]),
    ("plain divs", f"{PLAIN_MENU}<div>{A}</div><div>{B}</div><div>{C}</div><div>{LEGAL}</div>", [A, B, C]),
    ("line breaks", f"<div class='content'>{A}<br><br>{B}</div>", [f"{A} {B}"]),
    ("cookie notice", f'<div class="cookie-consent">{COOKIE}</div><article><h1>The flood</h1>{ps(A, B)}</article>', ["The flood", A, B]),
    ("cookie notice, unnamed", f"<div>{COOKIE}</div><h1>The flood</h1>{ps(A, B, C)}", ["The flood", A, B, C]),
    ("form", f'<article><h1>The flood</h1>{ps(A, B)}<form><label>Your mail</label><input><button>Subscribe</button></form></article>', ["The flood", A, B]),
    ("page in a form", f'<form id="page"><div class="menu"><ul>{MENU}</ul></div><h1>The flood</h1>{ps(A, B, C)}<div class="footer">{LEGAL}</div></form>', ["The flood", A, B, C]),
    ("page in a form, article", f"<form><article><h1>The flood</h1>{ps(A, B)}</article></form>", ["The flood", A, B]),
    ("list", f"<article><h1>What to pack</h1>{ps(A)}<ul><li>Boots and two coats</li><li>Bread</li><li>A lamp with oil for three nights</li></ul>{ps(B)}</article>", ["What to pack", A, "Boots and two coats", "Bread", "A lamp with oil for three nights", B]),
    ("list, named", f'<div class="post-content"><h1>What to pack</h1>{ps(A)}<ul><li>Boots and two coats</li><li>Bread</li></ul>{ps(B)}</div>', ["What to pack", A, "Boots and two coats", "Bread", B]),
    ("quotation", f"<article><h1>The flood</h1>{ps(A)}<blockquote><p>{LINE}</p></blockquote>{ps(B)}</article>", ["The flood", A, LINE, B]),
    ("sub-headings", f"<main><h1>The flood</h1>{ps(A)}<h2>Night</h2>{ps(B)}<h2>Spring</h2>{ps(C, D)}</main>", ["The flood", A, "Night", B, "Spring", C, D]),
    ("role", f'<div role="navigation"><ul>{MENU}</ul></div><div role="main"><h1>The flood</h1>{ps(A, B)}</div><div role="contentinfo">{LEGAL}</div>', ["The flood", A, B]),
    ("hidden", f'<article><h1>The flood</h1>{ps(A)}<div style="display:none">{C}</div><p hidden>{D}</p>{ps(B)}</article>', ["The flood", A, B]),
    ("sidebar around a widget article", f'<main><h1>The flood</h1>{ps(A, B)}</main><div class="sidebar"><div class="post">{ps(C)}</div></div>', ["The flood", A, B]),
    ("wrapper with a telling name", f'<div class="content-sidebar-wrap"><main><h1>The flood</h1>{ps(A, B)}</main></div>', ["The flood", A, B]),
    ("breadcrumbs and share", f'<div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div><div class="story"><h1>The flood</h1>{ps(A, B)}</div><div class="share"><a href="#">Mail</a> <a href="#">Print</a></div>', ["The flood", A, B]),
    ("newsletter", f'<div class="story"><h1>The flood</h1>{ps(A, B)}</div><div class="newsletter-signup"><h3>Letters</h3>{ps("Get our letter every week, free of charge, straight to your mail.")}</div>', ["The flood", A, B]),
    ("legal paragraph in an article", f"<article><h1>Licence</h1>{ps(A, 'Copyright 2020 by the council.', B)}</article><footer>{LEGAL}</footer>", ["Licence", A, "Copyright 2020 by the council.", B]),
    ("entities", "<article><h1>Fish &amp; chips</h1><p>A&nbsp;b &lt;c&gt; caf&eacute; &#8364;5 and some more words.</p></article>", ["Fish & chips", "A b <c> café €5 and some more words."]),
    ("scripts and styles", f"<article><script>var p = '<p>no</p>';</script><style>p {{}}</style><h1>The flood</h1>{ps(A)}<noscript>no</noscript>{ps(B)}</article>", ["The flood", A, B]),
    ("menu only", f"<nav><ul>{MENU}</ul></nav><footer>{LEGAL}</footer>", []),
    ("one paragraph, then links", f"<article>{ps(A)}<ul>{RELATED}</ul></article>", [A]),
    ("one paragraph, then links, in main", f"<main>{ps(B)}<ul>{RELATED}</ul></main><footer>{LEGAL}</footer>", [B]),
    ("one paragraph, then links, in a plain div", f"<div>{ps(A)}<ul>{RELATED}</ul></div>", [A]),
    ("one paragraph, then a linked one", f'<article>{ps(A)}<p><a href="/1">One</a></p><p><a href="/2">Two</a></p></article>', [A]),
    ("ten words, then links", f"<article>{ps('Ten words are enough for a paragraph of an article.')}<ul>{RELATED}</ul></article>", ["Ten words are enough for a paragraph of an article."]),
    ("a hundred words, then links", f"<article>{ps(' '.join([A, B, C, D, A]))}<ul>{RELATED}</ul></article>", [" ".join([A, B, C, D, A])]),
    ("a long paragraph about rights", f"<article><h1>Law</h1>{ps(' '.join([A, B, C, D, A, 'All rights reserved.']), B)}</article><footer>{LEGAL}</footer>", ["Law", " ".join([A, B, C, D, A, "All rights reserved."]), B]),
    ("two articles", f"<article><h2>One</h2>{ps(A)}</article><article><h2>Two</h2>{ps(B)}</article>", ["One", A, "Two", B]),
]


def wrong_blocks(page, want):
    got = [x for x in html_text.main_text(page, html_text.trained_tree()).split("\n") if x]
    return [x for x in difflib.ndiff(got, want) if x[0] in "+-"]


@pytest.mark.parametrize("name", [p[0] for p in PAGES])
def test_page_gives_its_article(name):
    _, page, want = next(p for p in PAGES if p[0] == name)
    assert wrong_blocks(f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>", want) == []


def test_names_are_shares():
    share = lambda value: html_text.share_of(html_text.names_of(value), html_text.BOILER_NAMES)
    assert share("ad") == 1 and share("share-buttons") == 1 and share("social-history") == 0.5
    assert share("no-sidebar") == share("with-ads") == share("wrapper") == share("") == 0


def test_tree_reads_both_neighbours():
    used = {html_text.FEATURES[n[0]] for n in html_text.trained_tree().nodes if n[0] is not None}
    assert {"words", "density"} <= used and {"words before", "density before", "words after", "density after"} <= used


def test_tree_on_pages_of_another_seed():
    import numpy as np

    tree = html_text.trained_tree()
    pages = html_text.training_pages(seed=1234)
    rows = np.vstack([html_text.features([b[:-1] for b in page]) for page in pages]).tolist()
    labels = [bool(b[-1]) for page in pages for b in page]
    assert sum(tree(r) != y for r, y in zip(rows, labels, strict=True)) < 0.02 * len(labels)
