from __future__ import annotations

import html
import re

from kantar.llm import html_extract as H


def text(page, removed=frozenset()):
    return H.main_text(H.parse(page), removed)


def test_parts_that_go():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class=ad>Buy</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b> &lt;tag&gt; &#233;<br>two
    <p>Three&nbsp;four<!-- <p>no --><aside>see also</aside><form><p>mail<input></form><ul><li>a<li>b</ul>
    <div class="share-buttons">tweet</div><section id="comments"><p>first!</p></section><p>5 < 6 and 7 > 3</p></article></main>
    <aside class="sidebar">links</aside><footer>&copy;</footer></body></html>"""
    assert text(page) == "Title & more\nOne bold <tag> é two\nThree four\na\nb\n5 < 6 and 7 > 3"


def test_broken_pages():
    assert text("") == "" and text("plain  text ") == "plain text" and text("<article><p>a<p>b") == "a\nb"
    assert text("<article><p>cut off &am") == "cut off &am" and text("<article><p>x<a hre") == "x"
    assert text("<article><p>x</p></article><script>never closed <p>y") == "x"
    assert text("</p></div>a<p title='a>b' x=\"c>d\">e") == "a\ne"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<" * 2000 + "article><p>" + "w " * 100_000).endswith("w w")


def test_site_style_tree_removes_what_all_pages_share(spark):
    page = "<html><body><div class='x1'><span>Join our club today</span></div><div class='x2'><p>Body text number {0} of {1}</p></div></body></html>"
    rows = [(i, f"http://site.example/{i}", page.format(i, i * 7), "k") for i in range(40)]
    rows += [(100 + i, f"http://few.example/{i}", page.format(i, i), "k") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in H.extract_main(df).collect()}
    assert all(got[i] == f"Body text number {i} of {i * 7}" for i in range(40))
    assert got[101] == "Join our club today\nBody text number 1 of 1"
    # Few pages of its host, but the template is known from others.
    assert {r.page_id: r.text for r in H.extract_main(df, templates=True).collect()}[101] == "Body text number 1 of 1"


def test_salted_join_gives_the_same(spark, monkeypatch):
    test_site_style_tree_removes_what_all_pages_share(spark)
    monkeypatch.setattr(H, "SHIPPED_NODES", -1)
    test_site_style_tree_removes_what_all_pages_share(spark)


def test_copies_keep_their_article(spark):
    same = "<body><nav>n</nav><article><h1>T</h1><div class='x'><p>copy</p></div></article></body>"
    rows = [(i, "http://a.example/", same) for i in range(50)] + [(None, None, None), (60, "x", "")]
    out = [(r.page_id, r.text) for r in H.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(i, "T\ncopy") for i in range(50)] + [(None, ""), (60, "")]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_main(df).count() == 0


def test_whole_table_against_the_known_template(spark):
    """The tables' pages have one article each, of which the blocks can be cut out plainly."""

    def plain(page):
        found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
        parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        return "\n".join(x for x in lines if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in H.op10_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.page_id: (plain(r.html), len(plain(r.html))) for r in pages}


def test_deep_nesting_keeps_the_article_open():
    page = "<div><article><p>first</p>" + "<div>" * 300 + "deep" + "</div>" * 300 + "<p>last</p></article></div>after"
    assert text(page) == "first\ndeep\nlast"
    assert text("<article>" + "<b>" * 400 + "<p>x</p><nav>menu</nav><p>y</p></article>") == "x\ny"
    parsed = H.parse("<div>x" * 3000)
    assert len(H.features(parsed)[0]) == 3000
    assert text("<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000) == ""


def test_flow_that_a_site_repeats_in_its_articles_goes(spark):
    page = "<body><article><h1>Title {0}</h1><p>Text {0} of {1}</p><p class='sub'>Get our letter</p><ul class='tools'><li>Print</li><li>Mail</li></ul></article><i>{2}</i></body>"
    rows = [(i, "http://site.example/", page.format(i, i * 7, "")) for i in range(30)]
    rows += [(100 + i, "http://copies.example/", page.format("a", "b", i)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_main(df).collect()}
    assert all(got[i] == f"Title {i}\nText {i} of {i * 7}" for i in range(30))
    assert all(got[100 + i] == "Title a\nText a of b\nGet our letter\nPrint\nMail" for i in range(30))


def test_trees_equal_plain_entropies(spark):
    """Style trees counted plainly: entropies of places, weights of content nodes."""
    import math
    from collections import Counter, defaultdict

    page = "<body><div class='a'><p>{0}</p></div><div class='b'>{1}<i>x</i></div><div class='c'><ul>{2}</ul></div></body>"
    rows = [(i, f"http://h{i % 2}.example/", page.format(f"t{i}", f"same {i // 39}", "<li>k</li>" * (i % 3) + f"<li>{i}</li>")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    looks, said, often = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, url, html_text in rows:
        parsed = H.parse(html_text)
        found, nodes = H.features(parsed)
        for site in (f"host {url[7:-1]}", f"template {H.template(parsed)}"):
            for p, (look, text_digest) in found.items():
                looks[site, p][look] += 1
                said[site, p][text_digest] += 1
            often.update((site, p, c) for p, c in nodes)
    entropy = lambda n: -sum(c / n.total() * math.log(c / n.total()) for c in n.values()) / math.log(n.total())
    tree = H.tree_rows(df, templates=True)
    got = {(r.site, r.place): (r.pages, r.presentation, r.content) for r in H.style_trees(tree).collect()}
    assert got.keys() == looks.keys()
    for k, (n, presentation, content) in got.items():
        assert n == looks[k].total() and abs(presentation - entropy(looks[k])) < 1e-9 and abs(content - entropy(said[k])) < 1e-9
    want = {(s, p, None) for s, p in looks if max(entropy(looks[s, p]), entropy(said[s, p])) <= H.UNIMPORTANT}
    want |= {(s, p, c) for (s, p, c), n in often.items() if n > 1 and 1 - math.log(n) / math.log(looks[s, p].total()) <= H.UNIMPORTANT_CONTENT}
    assert {tuple(r) for r in H.unimportant(tree).collect()} == want and any(c is None for *_, c in want) and any(c for *_, c in want)


def test_a_repeated_paragraph_without_class_goes_and_its_neighbours_stay(spark):
    page = "<body><article><h1>Title {0}</h1><p>Text {0} of {1}</p><p>Read more on our site</p><p>End {1}</p></article></body>"
    rows = [(i, "http://site.example/", page.format(i, i * 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_main(df).collect()}
    assert got == {i: f"Title {i}\nText {i} of {i * 7}\nEnd {i * 7}" for i in range(30)}
    assert H.main_text(H.parse(rows[3][2])) == "Title 3\nText 3 of 21\nRead more on our site\nEnd 21"  # without the tree


def test_names_on_or_around_the_main_part_cost_no_article():
    body = "<h1>Title</h1><p>Text of the article.</p>"
    want = "Title\nText of the article."
    for page in (
        f'<body class="has-sidebar"><article class="post type-post comments-open">{body}</article></body>',
        f'<main class="site-main no-sidebar">{body}</main>',
        f'<div class="content with-sidebar">{body}</div>',
        f'<div class="sidebar-right page"><article id="comments-closed">{body}</article></div>',
        f'<div class="modal"><article>{body}</article></div>',
        f'<div class="related"><article>teaser</article></div><article class="related">{body}</article>',
        f'<div id="overlay">{body}</div>',
    ):
        assert text(page) == want, page
    assert text(f'<article>{body}<section id="discussion"><p>What it means</p></section><div class="notice">Note well</div></article>') == want + "\nWhat it means\nNote well"
    gone = '<div class="site-footer">f</div><div class="share-buttons">s</div><ol class="commentlist"><li id="comment-12">c</li></ol><div class="post-comments">d</div><div class="related-posts-list">r</div>'
    assert text(f"<article>{body}{gone}</article>") == want


def test_names_are_read_as_a_whole():
    assert [H.named(t, H.UNIMPORTANT_NAMES) for t in ("sidebar", "left-sidebar", "no-sidebar", "comments-open", "share_buttons", "ad-12", "adopt", "load", "navigation-free", "")] == ["sidebar", "sidebar", None, None, "share", "ad", None, None, None, None]


def test_page_without_article_or_names_is_cleaned_by_the_tree(spark):
    page = "<body><div class='u'><p>Home</p><p>Contact us at the desk</p></div><div class='v'><h2>Story {0}</h2><p>Told {1} times</p><p>It ends at {0}</p></div><div class='w'>All rights are ours</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i, i * 3)) for i in range(25)]
    got = {r.page_id: r.text for r in H.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\nTold {i * 3} times\nIt ends at {i}" for i in range(25)}
