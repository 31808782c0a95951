from urllib.parse import urljoin

import pytest
from gistmill.llm import urls

LINK, META = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="{}">'


def found(spark, *pages):
    return sorted((r["url"], r["target"]) for r in urls.alias_links(spark.createDataFrame(list(pages), "url string, html string")).collect())


def test_targets_resolve_as_in_urljoin(spark):
    bases = ["http://a.b/c/d;p?q", "http://a.b", "https://A.b/x/", "http://a.b?x=1", "http://a.b/c/d#f"]
    refs = "page.html ../x ./x ../../../g g/./h/../i ?p=2 #s /w /w/../v //h.org/z http://h.org/a/b . .. ./ ../ /out?u=http://x/ g?y/./x g#s/../x x/.hidden .a ..b".split()
    got = found(spark, *[(b, LINK.format(r)) for b in bases for r in refs])
    assert got == sorted((b, urljoin(b, r)) for b in bases for r in refs)
    assert found(spark, ("http://a.b/", LINK.format("http://h.org/a/../b"))) == [("http://a.b/", "http://h.org/b")]  # RFC 3986, 5.2.2, other than urljoin
    assert found(spark, ("http://a.b/", LINK.format("mailto:x@y.z")), ("no scheme", LINK.format("x")), ("no scheme", LINK.format("//h/x"))) == []


@pytest.mark.parametrize(
    "html",
    [META.format("0; url='http://b.org/x'"), "<meta content='0;URL=\"http://b.org/x\"' http-equiv=Refresh>", META.format("5; http://b.org/x"), META.format("0;url= http://b.org/x "), "<meta http-equiv=refresh content=0;url=http://b.org/x>",
     '<link rel="nofollow canonical" href="http://b.org/x">', "<link href=' http://b.org/x' rel='canonical nofollow'/>", "<link rel=canonical href=http://b.org/x>"],
)
def test_forms_of_links(spark, html):
    assert found(spark, ("http://a.org/", html)) == [("http://a.org/", "http://b.org/x")]


def test_no_links(spark):
    htmls = [META.format("30"), '<link rel="canonical-x" href="/x">', '<link data-rel="canonical" href="/x">', '<link rel="next" href="/canonical">', '<meta name="x" content="0; url=/y">']
    assert found(spark, *[("http://a.org/", h) for h in htmls]) == []


def test_aliases_of_blocked_pages_by_relative_links(spark):
    rows = [(1, "http://e.com/a/p", LINK.format("../en/x")), (2, "http://e.com/a/q", LINK.format("p")), (3, "http://f.com/a", LINK.format("/out?u=http://x.com/en/")), (4, "http://e.com/a/./b/../q", "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow", 4: "block"}
