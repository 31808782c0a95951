"""URL rules with block decisions carried over redirects and canonical links, in DataFrame operations alone."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import connected_components

#: (verdict, host, path): fixed values of the production rule set.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host, path, rules: Sequence[tuple[str, str, str]]) -> F.Column:
    """{rule, verdict} of the longest rule that fits, null if none does; of equally long ones an allow rule wins."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _without_dots(path) -> F.Column:
    """A path that begins with / without its segments . and .. (RFC 3986, 5.2.4)."""
    steps = F.split(F.substring(path, 2, 2**31 - 1), "/")
    empty = F.expr("cast(array() as array<string>)")

    def step(acc, x):
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    clean = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(steps, empty, step), ends), "/"))
    return F.when(path.contains("/."), clean).otherwise(path)


def _node(url) -> F.Column:
    """What names a page whatever its scheme and fragment: host, path (without dot segments) and query; null without ://."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(path == "", "/").otherwise(_without_dots(path)), query))


def resolved(url, t) -> F.Column:
    """The URL that reference t means on the page url (RFC 3986, 5.2); null if it has another scheme than with ://, or the page has none."""
    scheme, base = F.regexp_extract(url, r"^[^:/?#]*:", 0), F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0)
    own = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path, tail = F.regexp_extract(t, r"^[^?#]*", 0), F.regexp_extract(t, r"^[^?#]*(.*)", 1)
    full = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", 0)
    rest = F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    host = F.when(full.startswith("//"), F.concat(scheme, full)).otherwise(full)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(own == "", "/").otherwise(F.regexp_replace(own, r"[^/]*$", "")), path))
    return (
        F.when(full.startswith("//") & (base == ""), F.lit(None))
        .when(full != "", F.concat(host, _without_dots(rest), tail))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (base == ""), F.lit(None))
        .when(path != "", F.concat(base, _without_dots(joined), tail))
        .when(t.startswith("?"), F.concat(base, own, tail))
        .otherwise(F.concat(base, own, query, tail))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and of refresh redirects in a page's HTML; targets are resolved against the page's URL."""
    attr = r"""(?is)(?<![\w-]){}\s*=\s*(?:"\s*([^">]*)|'\s*([^'>]*)|([^\s"'>]+))"""

    def value(name: str) -> F.Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("tag", attr.format(name), i), F.lit("")) for i in (1, 2, 3)])

    canonical = r"""(?is)(?<![\w-])rel\s*=\s*(?:"(?:[^">]*\s)?canonical[\s"]|'(?:[^'>]*\s)?canonical[\s']|canonical(?=[\s/>]))"""
    tags = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(canonical) | t.rlike(r"""(?is)(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b"""),
    )
    content = value("content")
    named = F.regexp_extract(content, r"""(?is)(?:^|[;,\s])url\s*=\s*["']?\s*([^"'\s]+)""", 1)
    bare = F.regexp_extract(content, r"""(?is)^[\d.]+\s*[;,]\s*(?!url\s*=)["']?\s*([^"'\s]+)""", 1)
    target = F.coalesce(F.nullif(F.regexp_extract(value("href"), r"^\S+", 0), F.lit("")), F.nullif(named, F.lit("")), F.nullif(bare, F.lit("")))
    return (
        pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").isNotNull())
        .select("url", F.explode(tags).alias("tag"))
        .select("url", F.regexp_replace(target, "&(?:amp|#38|#[xX]26);", "&").alias("t"))
        .select("url", resolved(F.col("url"), F.col("t")).alias("target"))
        .filter("target is not null")
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, html).

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest one (host and path)
    wins and its verdict holds: an explicit allow stands even among blocked aliases. A page without a rule is blocked
    if a redirect or canonical link joins it, over any number of steps and in either direction, to a URL that a rule
    blocks, else allowed. Rules are a bounded parameter and are compared in the scan itself; only the URLs of pages are
    shuffled, to meet the nodes of blocked components. A hub that very many pages link to is never gathered. Null url,
    or one without ://: host and path are empty, no rule, no links, allow. Null html: no links. Rows that repeat get equal
    results. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", "url", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node"))
    found = found.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    links = scratch.save(alias_links(pages), "links")
    components = connected_components(links.select(_node(F.col("url")).alias("a"), _node(F.col("target")).alias("b")), scratch)
    ends = links.select(F.explode(F.array("url", "target")).alias("url"))
    bad = ends.filter(rule_for(*host_and_path(F.col("url")), rules)["verdict"] == "block").select(_node(F.col("url")).alias("node")).distinct()
    roots = components.join(bad, "node").select("root").distinct()
    blocked = components.join(roots, "root").select("node", F.lit("block").alias("by_alias"))
    return found.join(blocked, "node", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "by_alias", F.lit("allow")).alias("verdict")
    )


def _oracle() -> str:
    """DuckDB SQL for op4 where no page has links, as in the given tables: it doesn't follow any."""
    parse = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    case = "case " + " ".join(
        f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{h}{p}|{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""with a as (select page_id, coalesce({parse}, '') as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, {case} end as r from b)
select page_id, host, path, split_part(r, '|', 1) as rule, coalesce(split_part(r, '|', 2), 'allow') as verdict from c"""


ORACLE = _oracle()
