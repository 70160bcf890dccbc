"""Main text of hand-made pages, and of pages whose nodes differ only by what the site repeats."""

from __future__ import annotations

import math
import random
import re

import pytest
import xxhash

from spanwise.llm import pages, registry

SCHEMA = "page_id long, url string, html string, text string"


def text_of(page):
    return pages.kept_texts(page)


@pytest.mark.parametrize("page, want", [
    ("<p>a  b\n c<p>d &amp; e&nbsp;&eacute;", ["a b c", "d & e é"]),
    ("<nav>x<ul><li>y</ul></nav><article><h1>T</h1><p><b>u<br><p>v</article><footer>z</footer>", ["T", "u", "v"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- no --><p>yes <i>it</i>s", ["yes its"]),
    ("<div class='comments'><p>c</p></div><div class=\"post has-sidebar\"><p>d</p></div>", ["d"]),
    ("<article><header class='entry-header'><h1>T</h1></header><p>a</p><div id='ad-12'>b</div><aside>c</aside></article>", ["T", "a"]),
    ("<p>1 < 2 and 3 > 2</p><p hidden>x</p><p>unclosed <b>bold", ["1 < 2 and 3 > 2", "unclosed bold"]),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>tail", ["a", "b", "c", "d", "e", "tail"]),
    ("<form><p>f</p><button>g</button></form><p>h<span class=ad>i</span> j</p><title>k</title>", ["h", "j"]),
    ("</div></p>stray<p>x</article>y", ["stray", "x", "y"]),
    ("", []), ("<", ["<"]), ("<p", ["<p"]), ("<!-- open", []), ("<script>open", []),
])
def test_blocks(page, want):
    assert text_of(page) == want


def test_repeated_nodes_of_a_site_go_and_copies_do_not_count(spark, tmp_path):
    def page(n, extra):
        return f"<body><div class=x>Same on all</div><div class=y><p>Text {n}</p><p>More {n} {extra}</p></div></body>"

    rows = [(n, f"https://A.example.com:80/{n}", page(n, "q"), "") for n in range(8)]
    rows += [(100 + n, "https://b.example.com/", page(0, "copy"), None) for n in range(5)]
    rows += [(None, None, None, None), (200, "no url", "<p>alone</p>", ""), (200, "no url", "<p>alone</p>", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in registry.op5_main_text(spark, str(tmp_path)).collect()), key=str)
    want = [(n, r[1], t := f"Text {n}\nMore {n} q", len(t)) for n, r in enumerate(rows[:8])]
    want += [(100 + n, rows[8][1], t := "Same on all\nText 0\nMore 0 copy", len(t)) for n in range(5)]
    want += [(None, None, "", 0), (200, "no url", "alone", 5), (200, "no url", "alone", 5)]
    assert got == sorted(want, key=str)


def test_deep_and_long_pages_and_empty_table(spark):
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000
    assert text_of(deep) == ["in"]
    assert text_of("<p a=\"" + "x" * 200_000) == ["<p a=\"" + "x" * 200_000]
    assert text_of("<p>" + "word " * 200_000)[0] == ("word " * 200_000).strip()
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("opened, closed, noise, article", [
    ("", "", "a b c d e f g h sidebar", "a b c d e f g h article-body"),
    ("", "", "x" * 120 + "-one sidebar", "x" * 120 + "-two"),
    ("<div class='alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima'>" * 40, "</div>" * 40, "sidebar", "body"),
])
def test_nodes_with_many_names_and_deep_nodes_stay_apart(spark, opened, closed, noise, article):
    rows = [(n, f"https://a.example.com/{n}", f"<body>{opened}<div class='{noise}'>Links {n}</div><div class='{article}'>Text {n}</div>{closed}", "")
            for n in range(6)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: f"Text {n}" for n in range(6)}


def page_rows(make, n=12, host="a.example.com"):
    return [(i, f"https://{host}/{i}", make(i), "") for i in range(n)]


def main_of(spark, rows):
    return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_misleading_name_is_outvoted(spark):
    def page(n):
        paragraphs = "".join(f"<p>Article {n} says {k}.</p>" for k in range(1 + n % 4))
        return f"<body><nav>Home</nav><div class='sidebar-layout-main'>{paragraphs}</div><div class='ad'>Buy {n}</div></body>"

    assert main_of(spark, page_rows(page)) == {n: "\n".join(f"Article {n} says {k}." for k in range(1 + n % 4)) for n in range(12)}
    # With too few articles, or next to another branch that differs, the name decides.
    assert set(main_of(spark, page_rows(page, 3)).values()) == {""}
    beside = main_of(spark, page_rows(lambda n: page(n).replace("</body>", f"<p>Long text of its own on page number {n}.</p></body>")))
    assert beside == {n: f"Long text of its own on page number {n}." for n in range(12)}


def test_boilerplate_within_the_article_goes(spark):
    def page(n):
        return (f"<body><div class='main-content'><h1>Title {n}</h1><p>Subscribe to our list now</p><p>Words of {n} and more {n}</p>"
                "<p>All rights reserved</p></div></body>")

    assert main_of(spark, page_rows(page)) == {n: f"Title {n}\nWords of {n} and more {n}" for n in range(12)}


def test_near_copies_are_one_article(spark):
    shared = "".join(f"<p>Paragraph {k} of the story that many pages tell alike.</p>" for k in range(5))
    long = "<p>" + "The longest paragraph of them all is the same on each of the copies. " * 3 + "</p>"
    rows = page_rows(lambda n: f"<article>{shared}{long}<p>Copy {n}</p></article>", 20)
    got = main_of(spark, rows)
    assert all(len(got[n].split("\n")) == 7 and got[n].endswith(f"Copy {n}") for n in range(20))


def plain_tree(rows):
    """The same measures in plain Python: texts that go, per host, and kept roots."""
    hosts = {}
    for _, url, page, *_ in rows:
        if page is not None:
            name = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or [None, ""])[1].lower()
            styles = {}
            found = list(pages.blocks(page, styles))
            hosts.setdefault(name, {}).setdefault(page, (found, styles))
    for name, seen in hosts.items():
        shows, nodes = {}, {}
        for page, (found, _) in seen.items():
            for path, _, _, _, text in found:
                shows.setdefault((path, text), set()).add(page)
                nodes.setdefault(path, set()).add(page)
        common = {k for k, on in shows.items() if len(nodes[k[0]]) > 1 and 2 * len(on) > len(nodes[k[0]])}
        hosts[name] = [(max(((len(f[4]), pages.text_key(f[0], f[4])) for f in found if (f[0], f[4]) not in common), default=page),
                        found, styles) for page, (found, styles) in seen.items()]
    out = {}

    def even(counts):
        total = sum(counts)
        return 1.0 if total <= 1 else (math.log(total) - sum(c * math.log(c) for c in counts) / total) / math.log(total)

    for name, seen in hosts.items():
        shows, articles, looks = {}, {}, {}
        for key, found, styles in seen:
            for path, mark, up, root, text in found:
                shows.setdefault((path, mark, up, root), {}).setdefault(text, set()).add(key)
                articles.setdefault(path, set()).add(key)
            for path, of in styles.items():
                looks.setdefault(path, {}).setdefault(tuple(of), set()).add(key)
        gone, elsewhere, roots = {}, 0.0, {}
        for (path, mark, up, root), texts in shows.items():
            m = len(articles[path])
            look = even([len(k) for k in looks[up].values()])
            differ = even([len(k) for k in texts.values()])
            prior = 1.0 if mark in ("article", "content") else pages.UNMARKED
            worth = pages.TAG_PAGES if mark == "article" else pages.PRIOR_PAGES

            def weighed(measured):
                return (m * measured + prior * worth) / (m + worth)

            for text, keys in texts.items():
                alone = 1 - math.log(len(keys)) / math.log(m) if m > 1 else 1.0
                measured = alone * pages.GAMMA + look * (1 - pages.GAMMA)
                said = len(text) * len(keys)
                if mark in pages.KEPT_MARKS:
                    elsewhere += said * measured
                if root is not None:
                    r = roots.setdefault(root, [0.0, 0, 0])
                    r[0], r[1], r[2] = r[0] + said * measured, r[1] + said, max(r[2], m)
                low = weighed(measured) < pages.THRESHOLD and 2 * len(keys) > m
                if low or weighed(differ * pages.GAMMA + look * (1 - pages.GAMMA)) < pages.THRESHOLD:
                    gone[path, text] = (mark, root)
        kept = None
        if roots:
            root, (says, size, most) = max(roots.items(), key=lambda r: (r[1][0], r[0]))
            if most >= pages.ENOUGH and says / size >= pages.SURE and elsewhere <= (1 - pages.VOICE) * says:
                kept = root
        out[name] = ({k for k, (mark, root) in gone.items() if mark in pages.KEPT_MARKS or root is not None and root == kept}, kept)
    return hosts, out


@pytest.mark.parametrize("source", ["shared", "made"])
def test_query_equals_the_tree_in_plain_python(spark, tmp_path, source):
    if source == "shared":
        rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
        folder = "/root/testdata/sf0.01"
    else:
        rng = random.Random(2)
        names = ["sidebar", "main-content", "box", "x1", "comments", "post"]
        rows = []
        for i in range(120):
            parts = "".join(f"<div class='{rng.choice(names)}'>" + "".join(f"<p>{rng.choice(['Same', 'Often', f'Own {i} {k}'])} text</p>"
                            for k in range(rng.randint(0, 4))) + "</div>" for _ in range(rng.randint(1, 5)))
            rows.append((i, f"http://h{i % 5}.org/{i}", f"<nav>menu</nav><div class='layout-aside'><p>Words {i}</p></div>{parts}" if i % 5 else
                         f"<div class='layout-aside'><p>Words {i}</p><p>{'more ' * (i % 7)}</p></div>"))
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        folder = str(tmp_path)
    _, trees = plain_tree(rows)
    want = {}
    for i, url, page in rows:
        name = (re.match(r"[a-z]+://([^/?#:]*)", url) or [None, ""])[1].lower()
        gone, kept = trees[name]
        want[i] = "\n".join(t for path, mark, _, root, t in pages.blocks(page)
                            if (mark in pages.KEPT_MARKS or mark == "named" and root == kept) and (path, t) not in gone)
    assert {r.page_id: r.text for r in registry.op5_main_text(spark, folder).collect()} == want
    if source == "made":
        assert trees["h0.org"][1] is not None and any(g for g, _ in trees.values())
