"""URL verdicts by rules, and by redirects and canonical links where no rule fits.

A rule has a host and a path. It fits a url of its host or a subdomain whose path
starts with the rule's; the longest rule decides. Urls that a redirect or a
canonical link joins are aliases of one another: they form the connected components
of those edges. A url without a rule takes its component's verdict: allow if one of
the aliases is allowed by a rule, else block if one is blocked by a rule, else allow.

All of it is DataFrame operations: no Python runs on rows. Up to INLINE_RULES rules
are one expression; more are joined by the suffixes of hosts.

Links and refreshes are taken from ``<link>`` and ``<meta>`` tags as a browser sees them: not
from comments, scripts, styles or other tags' values; quoted values may hold ``<`` and ``>``;
``rel`` is a list of words; references such as ``&amp;`` are decoded; targets are resolved
against the page's url, dots included.

Defined results: a null url or one without ``://`` has an empty host and path and no
rule; of equally long rules block wins, then the first by name; repeated rows give
repeated results; columns that are not named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.components import components
from genoframe.llm.scratch import Scratch

INLINE_RULES = 64
#: Rows up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Pages are cut by one pattern that takes whatever comes next whole: a comment, an element
# whose content is text, a tag with its quoted values. So nothing within these passes for a
# tag. All quantifiers keep what they took and what is not closed reaches to the end, so a
# pattern passes over a text once.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+)*+"""
_TEXT_ELEMENTS = "script style textarea title xmp iframe noembed noframes template".split()
PIECES = (
    r"(?is)<!--.*?(?:-->|\z)|"
    + "|".join(rf"<{x}(?=[\s/>]){_REST}(?:>|\z).*?(?:</{x}(?=[\s/>])|\z)" for x in _TEXT_ELEMENTS)
    + rf"|(<(?:link|meta)(?=[\s/>]){_REST}>)|<[a-z/!?]{_REST}(?:>|\z)"
)
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>"'][^\s>]*+))"""
ATTRIBUTE = rf"""(?s)[^\s/>=][^\s/>=]*+(?:{_VALUE.replace("([", "(?:[")})?+"""
WAIT_URL = r"(?is)^\s*+[0-9.]*+\s*+[;,]?+\s*+(?:url\s*+=\s*+)?+(?:\"([^\"]*+)|'([^']*+)|(.*))"
#: Named references that urls are read with, besides those by number.
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
#: A url of more segments keeps its dots.
MAX_SEGMENTS = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path; both empty for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))


def fit_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict, or null) to rows with ``host`` and ``path``."""
    none = F.lit(None).cast("string")
    if not rules:
        return urls.withColumns({"rule": none, "ruled": none})
    if len(rules) <= INLINE_RULES:
        host, path = F.col("host"), F.col("path")
        fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in _longest_first(rules)]
        pick = reduce(lambda so_far, i: F.when(fits[i], F.lit(i)).otherwise(so_far), range(len(fits) - 1, -1, -1), F.lit(None).cast("int"))
        names, verdicts = (F.array(*(F.lit(x) for x in xs)) for xs in zip(*((h + p, v) for h, p, v in _longest_first(rules)), strict=True))
        return urls.withColumn("_pick", pick).withColumns({"rule": F.get(names, F.col("_pick")), "ruled": F.get(verdicts, F.col("_pick"))}).drop("_pick")
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, v, -i) for i, (h, p, v) in enumerate(_longest_first(rules))], "h string, p string, v string, first int")
    table = F.broadcast(table) if len(rules) <= BROADCAST_ROWS else table
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.select("host", "path").distinct()
    fitted = keys.withColumn("h", F.explode(suffixes)).join(table, "h").where(F.startswith("path", "p"))
    fitted = fitted.groupBy("host", "path").agg(F.max(F.struct("first", F.concat("h", "p").alias("rule"), F.col("v").alias("ruled"))).alias("best"))
    return urls.join(fitted, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")}).drop("best")


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its segments of one or two dots."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.element_at(parts, -1)
    open_end = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def step(kept: Column, part: Column) -> Column:
        above = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", above).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    dotted = path.rlike(r"/\.{1,2}(?:/|$)") & (F.size(parts) <= MAX_SEGMENTS)
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(F.aggregate(open_end, F.array().cast("array<string>"), step), "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """What edges join: a url without its fragment and the dots of its path, its scheme and
    host in lower case, its empty path a slash."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = r"(?s)^([^:/?#]*://[^/?#]*)([^?]*)(.*)$"
    site, path, rest = (F.regexp_extract(whole, pattern, i) for i in (1, 2, 3))
    return F.when(site != "", F.concat(F.translate(site, UPPER, LOWER), F.when(path == "", "/").otherwise(without_dots(path)), rest)).otherwise(whole)


def resolve(base: Column, target: Column) -> Column:
    """A target as written in a page, as an absolute url."""
    t = F.trim(F.regexp_replace(target, r"[\t\n\r]", ""))
    scheme = F.regexp_extract(base, "^([^:/?#]*:)//", 1)
    site = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^([^:/?#]*://[^?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(t == "", None)
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(t.contains("://"), t))
        .when(F.startswith(t, F.lit("//")), F.concat(scheme, t))
        .when(F.startswith(t, F.lit("/")), F.concat(site, t))
        .when(F.startswith(t, F.lit("?")), F.concat(page, t))
        .when(F.startswith(t, F.lit("#")), base)
        .otherwise(F.concat(folder, t))
    )


def unescaped(text: Column) -> Column:
    """Character references by number, and the named ones that urls use, as characters."""
    named = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))

    def read(part: Column) -> Column:
        hexed = F.regexp_extract(part, "(?i)^&#x0*+([0-9a-f]{1,6});$", 1)
        plain = F.regexp_extract(part, "^&#0*+([0-9]{1,7});$", 1)
        number = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(plain != "", plain.cast("long"))
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, character).otherwise(F.coalesce(F.try_element_at(named, F.lower(part)), part))

    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#?+[0-9A-Za-z]++;|[^&]++|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, read), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name; empty if it has none."""
    inside = F.regexp_replace(tag, r"(?i)^<(?:link|meta)", "")
    named = F.filter(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}(?:[\s=]|$)"))
    first = F.coalesce(F.get(named, F.lit(0)), F.lit(""))
    return unescaped(F.concat(*(F.regexp_extract(first, r"(?s)^[^\s/>=]++" + _VALUE, i) for i in (1, 2, 3))))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src`` and ``dst`` urls of canonical links and refreshes in pages: of each page the
    first link and the first refresh that have a target."""
    body, base = F.col(html).cast("string"), F.col(url).cast("string")
    linked = body.rlike(r"(?i)<link[\s/]") & body.rlike("(?i)canonical") | body.rlike(r"(?i)<meta[\s/]") & body.rlike("(?i)refresh")
    tags = pages.where(base.isNotNull() & linked).select(base.alias("src"), F.filter(F.regexp_extract_all(body, F.lit(PIECES), F.lit(1)), lambda t: t != "").alias("tags"))

    def first(fits, target) -> Column:
        return F.get(F.filter(F.transform(F.filter("tags", fits), target), lambda t: t != ""), F.lit(0))

    words = lambda tag: F.split(F.lower(attribute(tag, "rel")), r"[ \t\n\f\r]+")
    canonical = first(lambda tag: tag.rlike("(?i)^<link") & F.array_contains(words(tag), "canonical"), lambda tag: F.trim(attribute(tag, "href")))

    def waited(tag: Column) -> Column:
        content = attribute(tag, "content")
        return F.trim(F.concat(*(F.regexp_extract(content, WAIT_URL, i) for i in (1, 2, 3))))

    refresh = first(lambda tag: tag.rlike("(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"), waited)
    found = tags.select("src", F.explode(F.array(canonical, refresh)).alias("to"))
    return found.where("to <> ''").select("src", resolve(F.col("src"), F.col("to")).alias("dst")).where("dst IS NOT NULL")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row. ``rules`` are
    (host, path, verdict), ``edges`` have the urls ``src`` and ``dst``."""
    scratch = Scratch(urls.sparkSession)
    text = F.col(url).cast("string")
    host, path = host_and_path(text)
    rows = fit_rules(urls.select(F.col(key).alias("key"), node_of(text).alias("node"), host.alias("host"), path.alias("path")), rules)
    joined = scratch.table(components(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")), scratch=scratch), "aliases")
    host, path = host_and_path(F.col("node"))
    ruled = fit_rules(joined.withColumns({"host": host, "path": path}), rules).where("ruled IS NOT NULL")
    said = ruled.groupBy("component").agg(F.min("ruled").alias("said"))  # allow sorts before block
    aliases = scratch.table(joined.join(said, "component").where("said = 'block'").select("node", "said"), "blocked")
    small = aliases.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(aliases) if small else aliases, "node", "left")
    return rows.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", "said", F.lit("allow")).alias("verdict"))
