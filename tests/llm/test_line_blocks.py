import random
import time

from lakekin.llm.line_blocks import extract, main_text, stretches

import numpy as np

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><header><h2>Site</h2></header>
<div class="ad">Buy</div><aside>Side</aside>
<article class="post"><h1>Head &amp; line</h1><p>One <b>bold</b>
 and&nbsp;more.<p>Two &lt;tags&gt;<br>here</p><ul><li>Item</ul><div id="comments"><p>First!</p></div>
<form><input name=q>Search</form><p>A.</p></article><footer>&copy; 2024</footer></body></html>"""

SOUP = """<body class="has-sidebar"><div class="top"><a href=/>Home</a> <a href=/a>About</a></div>
<div><ul><li><a>One</a></li><li><a>Two</a></li></ul></div>
<div class="x"><h2>The heading</h2><div>{long}</div><div>Short.</div><div>{long} Again.</div></div>
<div class="cookie-banner">{long}</div><section><div><div><p>Copyright</p></div></div></section></body>"""

LONG = "A sentence of the text that goes on for long enough to be counted as the main text of a page."


def test_marked_article():
    assert main_text(ARTICLE) == "Head & line\nOne bold and more.\nTwo <tags> here\nItem\nA."


def test_unmarked_page_by_surge_and_dive():
    assert main_text(SOUP.format(long=LONG)) == f"The heading\n{LONG}\nShort.\n{LONG} Again."


def test_main_without_article_and_hidden_parts():
    page = f"<nav>No</nav><main><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><div role=search>no</div><p>Yes</p></main><p>{LONG}</p>"
    assert main_text(page) == f"{LONG}\nYes"


def test_broken_markup():
    assert main_text("") == "" and main_text("just  text") == "just text"
    assert main_text("<article><p>cut off <b>here") == "cut off here"
    assert main_text("<article><script>never closed <p>x") == ""
    assert main_text("<article>a < b <p>c</article></p></div>") == "a < b\nc"
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "word " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_stretches():
    lengths = np.array([0, 5, 0, 0, 0, 100, 0, 50, 0, 0, 0, 0, 7, 0])
    assert stretches(lengths, 80) == [(5, 8)]
    assert stretches(np.zeros(4, int), 1) == []


def test_rows(spark):
    rows = [(1, "u1", ARTICLE, 5), (1, "u1", ARTICLE, 5), (2, None, None, 6), (None, "u3", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    found = extract(pages).collect()
    text = main_text(ARTICLE)
    want = [(1, "u1", text, len(text))] * 2 + [(2, None, "", 0), (None, "u3", "", 0)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert extract(pages.limit(0)).collect() == []


def test_wrappers_named_after_parts_keep_their_page():
    for wrapper in ('class="page no-sidebar"', 'class="content-area has-sidebar"', 'id="site" class="nav-open"', 'class="post-form"', 'class="sidebar"'):
        page = f'<body><div {wrapper}><div class="site-nav">No</div><article><div class="article-header"><h1>Title</h1></div><p>{LONG}</p></article></div></body>'
        assert main_text(page) == f"Title\n{LONG}", wrapper
    assert main_text(f'<form id="aspnetForm"><main><p>{LONG}</p></main></form>') == LONG
    # Most of a page without marks, and teasers beside the article.
    assert main_text(f'<div class="content comments"><p>{LONG}</p><p>{LONG}</p></div><div>Foot</div>').startswith(f"{LONG}\n{LONG}")
    assert main_text(f'<article><p>{LONG}</p><p>{LONG}</p></article><div class="related"><article>{LONG}</article></div>') == f"{LONG}\n{LONG}"


def test_windows_decide_on_marked_pages():
    story = "".join(f"<p>{LONG} {i}</p>" for i in range(4))
    text = "\n".join(f"{LONG} {i}" for i in range(4))
    cards = "".join(f"<article><a href=/{i}>Teaser {i}</a></article>" for i in range(3))
    assert main_text(f"<body><div>{story}</div>{cards}</body>") == text
    assert text in main_text(f"<div>{story}</div><article><p>{LONG}</p></article>")
    assert text in main_text(f"<main><div>{story}</div><article><p>{LONG}</p></article></main>")
    # Cards of links do not surge, other articles do.
    assert main_text(f"<article>{story}</article>{cards}<article><p>Another short article.</p></article>") == text + "\nAnother short article."


def test_short_sections_are_kept():
    between = "</p></div></section><section><div><p>"
    parts = ["Short introduction.", LONG * 8, "Short middle.", f"<a href=/x>All of it is a link</a>", LONG, "The end."]
    want = [p.replace("<a href=/x>", "").replace("</a>", "") for p in parts]
    assert main_text(f"<body><section><div><p>{between.join(parts)}</p></div></section></body>") == "\n".join(want)
    assert main_text("<body><div><p>A short article.</p></div></body>") == "A short article."
    links = "<ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul>"
    assert main_text(f"<p>{LONG} a</p><p>{LONG} b</p>{links}<p>Near.</p>{links}<p>{LONG} c</p><p>{LONG} d</p>") == f"{LONG} a\n{LONG} b\nNear.\n{LONG} c\n{LONG} d"


def test_windows_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randrange(1, 40))]
        groups = []
        for i in (i for i, n in enumerate(lengths) if n):
            if groups and i - groups[-1][-1] <= 3:
                groups[-1].append(i)
            else:
                groups.append([i])
        want = [(g[0], g[-1] + 1) for g in groups if any(sum(lengths[i : i + 3]) >= 80 for i in g)]
        assert stretches(np.array(lengths), 80) == want, lengths


def test_comments_and_sidebars_of_their_owners():
    story = f"<p>{LONG}</p><p>{LONG}</p>"
    for part in ('div id="user-comments"', 'div class="post-comments"', 'div class="share-this"', 'div class="blog-sidebar"', 'section class="reader_comments"'):
        block = f"<{part}><p>Not of the article.</p></{part.split()[0]}>"
        assert main_text(f"<div>{story}</div>{block}") == f"{LONG}\n{LONG}", part
        assert main_text(f"<article>{story}{block}</article>") == f"{LONG}\n{LONG}", part
    assert main_text(f'<div class="post-header"><h1>Title</h1></div>{story}') == f"Title\n{LONG}\n{LONG}"


def test_broken_pages_in_linear_time():
    pages = {
        "quotes": lambda n: "<p a=\"b'>" * n,
        "odd quotes": lambda n: "<a \">x" * (2 * n + 1),
        "open tags": lambda n: "<b>" * n + "</i>" * n + "<div>" * n,
        "inline": lambda n: "<b>" * n + "<div></div>" * n,
        "heads": lambda n: "<b>" * n + "<head><body>" * n,
        "comments": lambda n: "<!-- " * n,
        "raw": lambda n: "<script>" * n,
        "names": lambda n: "<" * n + "<a" * n,
    }
    for name, page in pages.items():
        began = time.perf_counter()
        main_text(page(200_000 // len(page(1)) * 5))
        assert time.perf_counter() - began < 10, name
    # One tag without an end: what follows is read without regard to quotes.
    assert main_text(f'<p>{LONG}</p><p title="x>It goes on.</p>') == f"{LONG}\nIt goes on."
