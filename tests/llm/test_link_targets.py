"""Canonical links and redirects in all their forms."""

import random

import pytest

from eventlens.llm import url_filter
from eventlens.llm.url_filter import Rule

RULES = [Rule.parse("block", "net/es/")]


def verdicts(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.verdict for r in sorted(url_filter.judge(df, RULES).collect(), key=lambda r: r.id)]


def test_targets_are_resolved_against_the_page(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        ("http://a.net/x", link("/es/x"), "block"),
        ("http://b.org/x", link("//c.net/es/y"), "block"),
        ("http://d.net/en/p.html", link("../es/x.html"), "block"),
        ("http://e.net", link("es/"), "block"),
        ("http://f.net/en/q", link("x.html"), "allow"),
        ("http://g.org/q", '<base href="http://g.net/es/">' + link("x.html"), "block"),
        ("http://h.net/q", '<link rel="alternate canonical" href=/es/z>', "block"),
        ("http://i.net/q", '<link rel="alternate" href="/es/z">', "allow"),
        ("http://j.net/q", '<meta http-equiv="refresh" content="0; url=/es/z">', "block"),
        ("http://k.net/q", link("mailto:es@k.net") + link("#es/"), "allow"),
        (" http://l.net/q?a=1&amp;b=2#top", link("/es/l"), "block"),
        ("http://m.org/q", link("http://l.net/q?a=1&b=2"), "block"),
        ("http://n.net/en/q?u=/es/", link("?v=1"), "allow"),
    ]
    assert verdicts(spark, [p[:2] for p in pages]) == [p[2] for p in pages]


@pytest.mark.parametrize(
    "target, want",
    [
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g/"),
        ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("g#s", "http://a/b/c/g"), (".", "http://a/b/c/"), ("..", "http://a/b/"),
        ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../../g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y"),
        ("g?y/../x", "http://a/b/c/g?y/../x"), ("https://x/a/../b", "https://x/b"), ("mailto:x", None), ("", None),
    ],
)
def test_resolution_of_rfc_3986(spark, target, want):
    row = spark.createDataFrame([(target, "http://a/b/c/d;p?q")], "t string, u string")
    assert row.select(url_filter.resolved(row["t"], row["u"]).alias("r")).first().r == want


def test_spellings_and_tags(spark):
    """Pages of http://a.org/ in all its spellings, and tags that are read or aren't."""
    block = "http://x.net/es/p"
    link = lambda target: f'<link rel="canonical" href="{target}">'
    pages = [
        ("http://a.org/", link(block), "block"),
        ("http://b.org/1", link("http://a.org"), "block"),
        ("http://b.org/2", link("http://A.ORG/"), "block"),
        ("http://b.org/3", link("http://a.org:80/"), "block"),
        ("HTTP://b.org:/4", link("HTTP://a.org:#x"), "block"),
        ("https://b.org:443/5", link("https://b.org/4b"), "allow"),
        ("https://B.org/4b", link(block), "block"),
        ("http://b.org/6", """<link rel="canonical" href="http://x.net/es/it's">""", "block"),
        ("http://b.org/7", f"""<meta http-equiv="refresh" content="0;{block}">""", "block"),
        ("http://b.org/8", f"""<meta http-equiv=refresh content='0; URL="{block}"'>""", "block"),
        ("http://b.org/9", f"""<link title="a > b" rel="canonical" href="{block}">""", "block"),
        ("http://b.org/10", f"""<link data-href="http://ok.org/" rel=canonical href={block}>""", "block"),
        ("http://b.org/11", f"<!-- {link(block)} -->", "allow"),
        ("http://b.org/12", f"<script>var x = '{link(block)}';</script>", "allow"),
        ("http://b.org/13", f"""<meta http-equiv="refresh" content="30; url={block}">""", "allow"),
        ("http://b.org/14", """<meta http-equiv="refresh" content="0">""", "allow"),
        ("http://b.org/15", f"<style>{link(block)}</style>" + link("http://ok.org/?a=1&amp;b=2"), "allow"),
        ("http://b.org/16", f"<link REL='Canonical' HREF='{block}' href='http://ok.org/'/>", "block"),
        ("http://b.org/17", f"<links rel=canonical href={block}>", "allow"),
        ("http://ok.org/?a=1&b=2", None, "allow"),
        (None, link(block), "allow"),
        (None, None, "allow"),
    ]
    pages[5] = ("https://b.org:443/5", link("https://b.org/4b"), "block")
    assert verdicts(spark, [p[:2] for p in pages]) == [p[2] for p in pages]


def reach(edges):
    """The smallest member of each node's component, by plain search."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        out[start] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_links_against_plain_search(spark, seed):
    """Random links of all forms; a page is blocked if its component has a blocked address."""
    rnd = random.Random(seed)
    nodes = [f"http://h{i}.{'net' if i % 3 else 'org'}/{rnd.choice(['es/', 'en/', ''])}p{i}" for i in range(60)]
    spell = [str.upper, lambda u: u, lambda u: u.replace("/p", "/./p"), lambda u: u + "#t"]
    pages, edges = [], []
    for url in nodes:
        html = ""
        for _ in range(rnd.choice([0, 0, 1, 2])):
            other = rnd.choice(nodes)
            edges.append((url, other))
            written = rnd.choice(spell[1:])(other)
            html += rnd.choice([f"<link href='{written}' rel=canonical>", f"<meta content='0;url={written}' http-equiv=Refresh>", f'<LINK REL="next canonical" HREF="{written}">'])
        pages.append((url, html))
    blocked = [u for u in nodes if ".net/es/" in u]
    component = reach(edges)
    want = ["block" if any(b in component.get(u, {u}) for b in blocked) else "allow" for u in nodes]
    assert verdicts(spark, pages) == want
    assert len(set(want)) == 2


def test_a_very_long_page_and_clashing_columns(spark):
    html = "<p>" + "word <b class='x'> " * 300_000 + '<link rel="canonical" href="http://x.net/es/p">'
    df = spark.createDataFrame([(1, "http://a.org/", html), (1, "http://a.org/", html)], "page_id long, url string, html string")
    df = df.selectExpr("*", "1 AS host", "2 AS node", "3 AS tag", "4 AS base")
    assert [r.verdict for r in url_filter.judge(df, RULES).collect()] == ["block", "block"]
    assert url_filter.judge(df.limit(0), RULES).count() == 0
