"""Operators against plain versions of their whole job, written from the method and not from the code."""

import random

from corpusflow.llm import html_extract, line_dedup
from tests.llm import brute


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_line_dedup_whole_removes_the_tails_of_repeated_runs(spark):
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    three, two = [line(30), line(30), line(10)], [line(60), line(40)]
    rows = [(1, "\n".join([line(5), *three, line(5)])), (2, "\n".join([line(7), *three, "own end"])), (3, "\n".join(two)), (4, "\n".join([*two, "own"])), (5, "\n".join(two))]
    pool = [line(r.choice([0, 1, 3, 12, 26, 55])) for _ in range(40)]
    runs = [[r.choice(pool) for _ in range(r.randrange(2, 9))] for _ in range(8)]
    for i in range(10, 110):
        lines = []
        for _ in range(r.randrange(5)):
            lines += r.choice(runs) if r.random() < 0.5 else [r.choice(pool) for _ in range(r.randrange(4))]
        rows.append((i, "\n".join(lines)))
    got = {x.doc.doc_id: x.kept_text for x in line_dedup.line_dedup(docs_frame(spark, rows)).collect()}
    assert got == brute.line_dedup(rows)
    assert got[2].split("\n")[1:] == ["own end"] and got[4] == "own" and got[5] == ""
    short = {x.doc.doc_id: x.kept_text for x in line_dedup.line_dedup(docs_frame(spark, rows), whole=False).collect()}
    assert three[2] in short[2] and two[1] in short[4]  # what the windows that start at a line leave


def test_html_unclosed_boilerplate_ends_where_html_ends_it():
    text = lambda page: html_extract.extract(page, {})
    body = "<article><h1>Title</h1><p>One two</p><p>Three four</p></article>"
    whole = "Title\n\nOne two\n\nThree four"
    assert text(f"<body><p class=ad>Buy this<p>Intro</p>{body}</body>") == "Intro\n\n" + whole
    assert text("<article><p>One<p class=ad>Buy this<p>Two</p><p>Three</p></article>") == "One\n\nTwo\n\nThree"
    assert text("<article><ul><li>One<li class=ad>Buy<li>Two</ul><p>Three</p></article>") == "One\n\nTwo\n\nThree"
    assert text("<dl><dt>A<dd class=ad>Buy<dt>B<dd>C</dl>") == "A\n\nB\n\nC"
    assert text("<table><tr><td>A<td class=ad>Buy<td>B<tr class=ad><td>Buy<tr><td>C</table>") == "A\n\nB\n\nC"
    assert text(f"<body><div><p class=ad>Buy this</div>{body}") == whole and text(f"<div><span class=ad>Buy</div>{body}") == whole
    assert text(f"<ul><li class=ad>Buy<ul><li>this</ul>now</ul>{body}") == whole  # an inner list doesn't end it
    assert text("<article><p>One <span class=ad>Buy <span>this</span> now</span> two</p></article>") == "One two"
    assert text("<article><div class=ad><table><tr><td></div>Buy</table></div><p>One</p></article>") == "One"
    assert text("<article><p>A</p><aside><p>side</aside><p>B</p></article>") == "A\n\nB"
    seen = html_extract.counted("<body><p class=ad>Buy<p>out</p><article><p>in words here</article></body>")
    assert seen["word p", True] == 3 and seen["word p", False] == 1


def test_html_everyday_names_keep_their_content():
    text = lambda page: html_extract.extract(page, {})
    for tag in (
        "h2 id=search", 'h2 class="section-header"', "section id=legal-history", "p class=related", 'div class="share-price-table"', 'div class="entry-header"',
        "div class=notice-period", 'div class="cookie-recipes"', 'div class="has-sidebar"', "h2 class=ad",
    ):
        assert text(f"<article><p>One</p><{tag}>Two</{tag.split()[0]}><p>Three</p></article>") == "One\n\nTwo\n\nThree", tag
    for tag in ("div class=ad", 'div class="ad-slot-3"', "div id=comments", "div class=comment", 'section class="reader-comments"', 'div id="user-comments"', "div class=notice", 'div class="sidebar-left"', 'div class="x newsletter-signup"', 'div class="cookie-notice"'):
        assert text(f"<article><p>One</p><{tag}>Two</{tag.split()[0]}><p>Three</p></article>") == "One\n\nThree", tag
    for tag in ('section class="reader-comments"', 'div id="user-comments"', "div class=comment"):
        assert text(f"<body><article><p>One</p></article><{tag}>Two words</{tag.split()[0]}></body>") == "One", tag
    for tag in ("div class=notice", 'div class="site-header"', "div id=search", 'div class="share-buttons"', 'div class="related-links"'):
        assert text(f"<body><{tag}>Two</div><article><p>One</p></article></body>") == "One", tag
    assert text('<body><div class="has-sidebar"><div class="entry-header"><h1 class=header>One</h1></div><p>Two</p></div></body>') == "One\n\nTwo"


def test_html_gaps_without_words_cut_nothing_off(spark):
    """Whatever is empty in an article, its last words stay; with weights from labelled pages and with none."""
    learned = html_extract.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for weights in (learned, {}):
        for gap in ("<table>" + "<tr><td></td><th></th></tr>" * 400 + "</table>", "<br>" * 3000, "<div><span></span></div>" * 500, "<ul>" + "<li>" * 300 + "</ul>", "<figure><img src=x></figure>" * 200):
            around = ("<nav>Menu one two</nav>", "<footer>Foot</footer>")
            assert html_extract.extract(f"<body>{around[0]}<article><p>First</p>{gap}<p>Last</p></article>{around[1]}</body>", weights) == "First\n\nLast", gap[:20]
            many = "a b c d e f g h i j"
            if weights:
                continue  # these pages' own tags may speak against a plain div
            assert html_extract.extract(f"<body><div><p>{many}</p>{gap}<p>{many}</p></div></body>", weights) == f"{many}\n\n{many}", gap[:20]


def test_html_region_is_the_largest_sum():
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-2, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(r.randint(0, 25))]
        lo, hi = html_extract.region(s)
        assert sum(s[lo:hi]) == max([0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))])


def test_html_without_article_leaves_what_scores_badly():
    """Pages of plain divs: the region is where the words are; links far off in many tags are not in it."""
    learned = {"tag li": -1.5, "tag /li": -0.5, "tag ul": -1.0, "tag /ul": -1.0, "tag a": -0.5, "tag /a": -0.1, "word li": 0.1, "word p": 1.0, "tag p": -0.02, "tag /p": -0.02}
    menu = "<ul>" + "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(20)) + "</ul>"
    body = "".join(f"<p>Paragraph {k} of the text.</p>" for k in range(6))
    assert html_extract.extract(f"<html><body>{menu}<div>{body}</div>{menu}</body></html>", learned) == "\n\n".join(f"Paragraph {k} of the text." for k in range(6))
