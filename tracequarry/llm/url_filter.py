"""URL rules with redirect equivalence.

Rules name a host and the start of a path; the longest that fits decides a
url. Redirects and canonical links join urls into classes of aliases by
distributed connected components. A url without a rule of its own takes its
class's decision: allow if the class has an allowed url, else block if it has
a blocked one, else allow. Everything is DataFrame functions.

Defined results: a null url, or one without `://`, has an empty host and path,
fits no rule and has no aliases, so it is allowed; a null or empty page has no
links; repeated pages each get a row; other columns are ignored, whatever
their names; an empty table gives an empty result. Pages of any length are read whole, in time in proportion to it, and a tag that never ends is none.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .components import components

#: (verdict, rule), fixed values of the contract.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def _rest(url: Column) -> Column:
    """What follows the first `://`, null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name by which redirects and links know a url: without scheme and fragment; null without `://`."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Few rules: one expression, no join."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        its_host, _, rest = rule.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _resolved(link: Column, url: Column) -> Column:
    """The node that a link on a page means."""
    host = host_of(url)
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(F.instr(link, "://") > 0, node_of(link))
        .when(link.startswith("//"), node_of(F.concat(F.lit("http:"), link)))
        .when(link.startswith("/"), F.concat(host, F.regexp_extract(link, "^[^#]*", 0)))
        .when(link.startswith("#") | (link == ""), F.lit(None))
        .otherwise(F.concat(host, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_extract(link, "^[^#]*", 0)))
    )


#: A tag's attributes: a name where one can begin, and its value. Nothing is gone by twice, whatever a tag looks like.
_ATTRIBUTE = r"""(?<![^\s"'/])([^\s"'>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, without its quotes; null if it has none."""
    names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2))
    value = F.get(F.filter(F.zip_with(names, values, lambda n, v: F.when(F.lower(n) == name, v)), lambda v: v.isNotNull()), F.lit(0))
    return F.trim(F.when(F.substring(value, 1, 1).isin('"', "'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def page_links(pages: DataFrame) -> DataFrame:
    """(u, v): each page's node and what its canonical links and refresh redirects name.

    A page is cut at its last `>`, so that every tag ends, and read once from left to right.
    """
    html = F.col("html")
    whole = F.substring(html, F.lit(1), F.length(html) - F.length(F.substring_index(html, ">", -1)))
    tags = pages.filter("instr(lower(html), 'canonical') > 0 or instr(lower(html), 'refresh') > 0").select("url", F.explode(F.regexp_extract_all(whole, F.lit(r"(?i)(<(?:link|meta)\b[^>]*+>)"), F.lit(1))).alias("tag"))
    tags = tags.filter("instr(lower(tag), 'canonical') > 0 or instr(lower(tag), 'refresh') > 0")
    tag = F.col("tag")
    canonical = F.when(F.lower(F.substring(tag, 2, 4)) == "link", F.when(F.instr(F.lower(_attribute(tag, "rel")), "canonical") > 0, _attribute(tag, "href")))
    wait = F.when(F.lower(F.substring(tag, 2, 4)) == "meta", F.when(F.lower(_attribute(tag, "http-equiv")).startswith("refresh"), _attribute(tag, "content")))
    refresh = F.regexp_extract(wait, r"""(?i)\burl\s*+=\s*+["']?\s*+([^"'\s>;]++)""", 1)
    link = F.replace(F.coalesce(F.regexp_extract(canonical, r"^\s*+(\S++)", 1), refresh), F.lit("&amp;"), F.lit("&"))
    return tags.select(node_of(F.col("url")).alias("u"), _resolved(link, F.col("url")).alias("v")).dropna().filter("u != v")


def judged(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, inherited of every page.

    redirects: optional (from_url, to_url), such as a crawler's log. Urls named only
    by a link or redirect take part: their own rules count for their aliases.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))).toDF("u", "v").dropna().filter("u != v"))
    classes = components(links)
    by_node = rule_for(F.regexp_extract("node", "^[^/?#]*", 0), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1), rules)["verdict"]
    said = (
        classes.select("root", by_node.alias("own"))
        .groupBy("root")
        .agg(F.when(F.count_if(F.col("own") == "allow") > 0, "allow").when(F.count_if(F.col("own") == "block") > 0, "block").alias("said"))
    )
    aliases = classes.join(said, "root").select(F.col("node").alias("_node"), "said")
    own = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_node")
    )
    own = own.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return own.join(aliases, "_node", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "said", F.lit("allow")).alias("verdict"),
        (F.col("_rule").isNull() & F.col("said").isNotNull()).alias("inherited"),
    )
