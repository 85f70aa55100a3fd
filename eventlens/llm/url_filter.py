"""URL filtering with redirect equivalence.

Rules of (host, path prefix) decide directly; the longest that fits wins. Pages that redirect to each
other or name a common canonical address are aliases: distributed connected components over
those edges join them, and a blocked member's decision reaches all aliases that no rule of their own
allows. In a component that holds an explicitly allowed page too, aliases without a rule are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import columns_of
from eventlens.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Block or allow a host, its subdomains and every path that starts with ``path`` (``/`` or ``/en/``)."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block") or not self.path.startswith("/") or not self.host:
            raise ValueError(f"not a rule: {self}")

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        if not slash:
            raise ValueError(f"a rule is a host, a slash and a path: {text!r}")
        return cls(verdict, host, f"/{path}")

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, or null; an allow rule comes before a block rule of the same text.

    Rules are compared by the length of the host, then of the path. They are configuration, bounded
    by what is written into the plan.
    """
    best = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host), len(r.path), r.verdict == "allow", r.text)):
        on_host = (host == F.lit(rule.host)) | host.endswith(F.lit(f".{rule.host}"))
        best = F.when(on_host & path.startswith(F.lit(rule.path)), F.lit(rule.text)).otherwise(best)
    return best


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    allowed = {r.text for r in rules if r.verdict == "allow"}
    return F.when(rule.isNull(), F.lit(None)).when(rule.isin(sorted(allowed)), F.lit("allow")).otherwise(F.lit("block"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that it names more than once; as a variable, so that the plan holds the value once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    start = F.array().cast("array<string>")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    # a dot segment at the end leaves the slash before it
    segments = F.split(F.regexp_replace(path, r"(?<=/)(\.{1,2})$", "$1/"), "/", -1)
    kept = _let(segments, lambda s: F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), start, step))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _plain(url: Column) -> Column:
    """Trimmed, ``&amp;`` read as ``&``, without what follows a ``#``."""
    return F.regexp_replace(F.trim(F.replace(url, F.lit("&amp;"), F.lit("&"))), "(?s)#.*$", "")


def _parts(plain: Column) -> Column:
    """Scheme, user, host with port, path and query of an address; all empty if it has no ``://``."""
    part = lambda group: F.regexp_extract(plain, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*@)?([^/?@]*)([^?]*)(.*)$", group)
    parts = {"scheme": F.translate(part(1), UPPER, LOWER), "user": part(2), "site": F.translate(part(3), UPPER, LOWER), "path": part(4), "query": part(5)}
    return F.named_struct(*[x for name, value in parts.items() for x in (F.lit(name), value)])


def _joined(p: Column) -> Column:
    port = F.when(p["scheme"] == "http", F.regexp_replace(p["site"], ":(80)?$", "")).when(p["scheme"] == "https", F.regexp_replace(p["site"], ":(443)?$", ""))
    path = F.when(p["path"] == "", F.lit("/")).otherwise(_without_dots(p["path"]))
    return F.concat(p["scheme"], F.lit("://"), p["user"], F.coalesce(port, p["site"]), path, p["query"])


def address(url: Column) -> Column:
    """An address as a node, the same for all its spellings that RFC 3986 (6.2.2 and 6.2.3) calls equivalent without a look at the site.

    Scheme and host in lower case (A-Z), no default or empty port, ``/`` for an empty path, no dot segments, nothing from a ``#``
    on, blanks around it trimmed, ``&amp;`` read as ``&``. Percent-escapes stay as they are. What has no ``://`` is only trimmed.
    """
    return _let(_plain(url), lambda plain: _let(_parts(plain), lambda p: F.when(p["scheme"] != "", _joined(p)).otherwise(plain)))


def resolved(target: Column, base: Column) -> Column:
    """The address that a link's target means on a page at ``base`` (RFC 3986, 5.2); null if it is none with ``://``, or empty."""

    def against(plain: Column, own: Column) -> Column:
        site = F.concat(own["scheme"], F.lit("://"), own["user"], own["site"])
        folder = F.when(own["path"] == "", F.lit("/")).otherwise(F.regexp_extract(own["path"], r"(?s)^(.*/)", 1))
        return (
            F.when(plain == "", F.lit(None))
            .when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(plain.contains("://"), plain))
            .when(own["scheme"] == "", F.lit(None))
            .when(plain.startswith("//"), F.concat(own["scheme"], F.lit(":"), plain))
            .when(plain.startswith("/"), F.concat(site, plain))
            .when(plain.startswith("?"), F.concat(site, own["path"], plain))
            .otherwise(F.concat(site, folder, plain))
        )

    return address(_let(_plain(target), lambda plain: _let(_parts(_plain(base)), lambda own: against(plain, own))))


#: What browsers don't read as tags: comments, and the content of scripts, styles and the like.
_UNREAD = r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|$)"
#: A tag; a ``>`` between quotes doesn't end it.
_TAG = r"""(?is)<(?:link|meta|base)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: An attribute: its name, and its value between double quotes, single quotes or none.
_ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?"""
#: Seconds of delay up to which a refresh is a redirect.
MAX_DELAY = 0


def _attributes(tag: Column) -> Column:
    """Names (in lower case) and values of a tag's attributes, in order; a name without a value has an empty one."""
    inside = F.regexp_replace(tag, r"(?s)^<\w+|>$", " ")
    group = lambda i: F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(i))
    either = lambda x, y: F.concat(x, y)  # noqa: E731  at most one of the three forms has matched
    values = F.zip_with(F.zip_with(group(2), group(3), either), group(4), either)
    return F.zip_with(group(1), values, lambda n, v: F.named_struct(F.lit("name"), F.lower(n), F.lit("value"), v))


def _value(attributes: Column, name: str) -> Column:
    """The value of the first attribute of a name; empty if there is none."""
    return F.coalesce(F.get(F.filter(attributes, lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def _refresh_target(content: Column, max_delay: int) -> Column:
    """Where a refresh leads: after the delay and a ``;``, ``,`` or blank, with or without ``url=`` and quotes; empty if it waits too long."""
    part = lambda group: F.regexp_extract(content, r"(?is)^\s*(\d+)(?:\.\d*)?(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(.*)$", group)
    rest = part(2)
    quoted = F.when(rest.startswith("'"), F.regexp_extract(rest, "(?s)^'([^']*)", 1)).when(rest.startswith('"'), F.regexp_extract(rest, '(?s)^"([^"]*)', 1))
    return F.when(part(1).try_cast("bigint") <= max_delay, F.trim(F.coalesce(quoted, rest))).otherwise(F.lit(""))


def alias_links(df: DataFrame, url_col: str = "url", html_col: str = "html", max_delay: int = MAX_DELAY) -> DataFrame:
    """(a, b): from each page's address to its canonical link and to the target of an immediate redirect.

    Reads ``<link rel=canonical href=...>``, also among other words of ``rel``, and ``<meta http-equiv=refresh
    content="0; url=...">`` with a delay of at most ``max_delay`` seconds, attributes in any order, the first of a name. Comments,
    scripts, styles and the like are no tags. Targets are resolved against the page's first ``<base href=...>``, if there
    is one, and its address. Ends are as ``address`` gives them. Links in HTTP headers, scripts and frames aren't seen.
    """
    html = F.col("html")
    pages = df.select(*columns_of(df, url=url_col, html=html_col)).where("url is not null and html is not null")
    hinted = pages.where(html.rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b"))
    tags = F.regexp_extract_all(F.regexp_replace(html, _UNREAD, " "), F.lit(_TAG), F.lit(0))
    read = hinted.select("url", F.transform(tags, lambda t: F.named_struct(F.lit("kind"), F.lower(F.regexp_extract(t, r"^<(\w+)", 1)), F.lit("has"), _attributes(t))).alias("tags"))
    bases = F.filter("tags", lambda t: (t["kind"] == "base") & (_value(t["has"], "href") != ""))
    named = _value(F.get(bases, F.lit(0))["has"], "href")
    tagged = read.select("url", F.coalesce(resolved(named, F.col("url")), F.col("url")).alias("base"), F.explode("tags").alias("tag"))
    has = F.col("tag.has")
    canonical = (F.col("tag.kind") == "link") & _value(has, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = (F.col("tag.kind") == "meta") & (F.lower(F.trim(_value(has, "http-equiv"))) == "refresh")
    target = F.when(canonical, _value(has, "href")).when(refresh, _refresh_target(_value(has, "content"), max_delay))
    linked = tagged.select("url", "base", target.alias("target")).where("target <> ''")
    return linked.select(address(F.col("url")).alias("a"), resolved(F.col("target"), F.col("base")).alias("b")).where("b is not null")


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, alias_rule, verdict.

    A row's own rule decides; else its component: ``block`` if it has a blocked member and none that
    is explicitly allowed; else ``default``. ``alias_rule`` is the smallest rule text that decided for
    a component. Members are addresses of rows and all ends of links, judged by the rules alike.
    ``links`` (a, b) come from crawl logs and add to those of the pages. Null addresses match no rule and link
    to nothing. Repeated rows are judged alike. Other columns are ignored; an empty table gives none.
    """
    rows = df.select(*columns_of(df, id=id_col, url=url_col))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "node": address(F.col("url"))})
    edges = links.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")) if links is not None else None
    if html_col is not None:
        found = alias_links(df, url_col, html_col)
        edges = found if edges is None else edges.union(found)
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    if edges is None:
        settled = rows.withColumns({"alias_rule": F.lit(None).cast("string"), "alias": F.lit(None).cast("string")})
    else:
        # null addresses have no component, and would all meet in one task
        named = rows.where("node is not null").join(_decided(components(edges), rules), "node", "left")
        settled = named.unionByName(rows.where("node is null"), allowMissingColumns=True)
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("alias"), F.lit(default))
    alias_rule = F.when(F.col("rule").isNull(), F.col("alias_rule"))
    return settled.select("id", "host", "path", "rule", alias_rule.alias("alias_rule"), verdict.alias("verdict"))


def _decided(members: DataFrame, rules: list[Rule]) -> DataFrame:
    """(node, alias, alias_rule) of the addresses in components where a rule decides for all."""
    rule = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    judged = members.withColumn("rule", rule)
    own = verdict_of(F.col("rule"), rules)
    whole = judged.groupBy("component").agg(
        F.min(F.when(own == "allow", F.col("rule"))).alias("allowed"),
        F.min(F.when(own == "block", F.col("rule"))).alias("blocked"),
    )
    ruled = whole.where("allowed is not null or blocked is not null")
    verdict = F.when(F.col("allowed").isNotNull(), F.lit("allow")).otherwise(F.lit("block"))
    sides = ruled.select("component", verdict.alias("alias"), F.coalesce("allowed", "blocked").alias("alias_rule"))
    return members.join(sides, "component").select("node", "alias", "alias_rule")
