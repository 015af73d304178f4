"""HTML and web documents as Columns: text, titles, links, labelled values, linked data, sitemaps."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import values
from sluice.shipping import ship


def collapse(text: Column) -> Column:
    """Runs of white space become one space; a text that has none but single spaces is looked at and left alone."""
    return values._once(text, lambda t: F.when(t.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(t, r"\s+", " ")).otherwise(t))


def strip(markup: Column) -> Column:
    """Tags become spaces, white space collapses."""
    return F.trim(collapse(F.regexp_replace(markup, "<[^>]+>", " ")))


def title(markup: Column) -> Column:
    return strip(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))


def decode(texts: Column, df: DataFrame) -> Column:
    """Entities decoded, named and numbered; what is no entity stays."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        entity = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
        return s.map(lambda x: entity.sub(lambda m: html.unescape(m.group()), x), na_action="ignore")

    return decoded(texts)


def labelled(rows: Column) -> Column:
    """Definition lists and two-column tables as ``Label: value`` lines."""
    lists = F.regexp_replace(rows, r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>", "$1: $2 \n")
    return F.regexp_replace(lists, r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>\s*</tr>", "$1: $2 \n")


def value_of(text: Column, label: str) -> Column:
    """What follows ``Label:`` up to the end of its line, without closing punctuation; null if nothing does."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?im)^\s*{re.escape(label)}\s*:\s*([^\n]+)$", 1)), r"[\s.,;]+$", ""), F.lit(""))


#: What stands for a value where there is none, without closing punctuation (fixed values).
NO_VALUES = ("-", "n.v.t", "nvt", "onbekend", "geen", "in overleg", "nader te bepalen")


def between_labels(text: Column, labels: dict[str, str]) -> Column:
    """``map<field, value>`` of ``Label: value`` in running text: a value ends at the next label or line, without closing punctuation.

    Blanks and what stands for no value are left out.
    """
    return values._once(text, lambda bound: _between_labels(bound, labels))


def _between_labels(text: Column, labels: dict[str, str]) -> Column:
    stops = "|".join(re.escape(label) for label in labels.values())
    cells = []
    for name, label in labels.items():
        found = F.regexp_extract(text, rf"(?is)(?:^|[^\p{{L}}])(?:{re.escape(label)})\s*:\s*(.*?)(?=\s*(?:{stops})\s*:|\n|$)", 1)
        cells += [F.lit(name), F.regexp_replace(F.trim(found), r"[\s.,;:|–-]+$", "")]
    return F.map_filter(F.create_map(*cells), lambda k, v: (v != "") & ~F.lower(v).isin(*NO_VALUES))


def description(linked: Column, markup: Column) -> Column:
    """The usable description of linked data, else of the page's main part."""
    return F.coalesce(usable(linked), usable(F.regexp_extract(markup, r"(?is)<main[^>]*>(.*?)</main>", 1)))


def label_blocks(markup: Column, description: Column, fields: dict[str, tuple[str, str]]) -> Column:
    """``map<field, value>`` of patterns with one group, each looked for in the page or (``description``) in the posting's text; blanks are left out."""
    cells = [x for name, (where, pattern) in fields.items() for x in (F.lit(name), F.trim(F.regexp_extract(description if where == "description" else markup, pattern, 1)))]
    return F.map_filter(F.create_map(*cells), lambda k, v: v != "")


#: Words that pages are furnished with, and how notices about cookies begin (fixed values).
FURNITURE = r"accept(?:eer| all)? cookies?|cookie(?:s|beleid)?|home(?:page)?|menu|navigatie|inloggen|registreren|privacy(?:beleid)?|contact"
NOTICE = r"(?is)^(?:accep\w+|allow|manage|we use)\b.*\bcookies?\b"


def usable(description: Column) -> Column:
    """The description without page furniture, if it has 24 characters and four words and is no notice about cookies."""
    body = strip(F.regexp_replace(description, r"(?is)<(nav|header|footer|aside|script|style|form)\b.*?</\1>", " "))
    furniture = rf"(?i)^(?:{FURNITURE})(?:[\s|•·:/-]+(?:{FURNITURE}))*[.!?]?\s*$"
    fits = (F.length(body) >= 24) & (F.size(F.split(body, " ")) >= 4) & ~body.rlike(furniture) & ~body.rlike(NOTICE)
    return F.when(fits, body)


def _parts(address: Column) -> Column:
    """``struct<scheme, authority, path, query, fragment>``; a part that isn't there is null, an empty one empty."""
    scheme = F.when(address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(address, r"^([^:]+):", 1))
    rest = F.when(scheme.isNotNull(), F.substr(address, F.length(scheme) + 2)).otherwise(address)
    return values._once(F.struct(scheme.alias("scheme"), rest.alias("rest")), lambda x: _below(x["scheme"], x["rest"]))


def _below(scheme: Column, rest: Column) -> Column:
    there = lambda pattern: F.when(rest.rlike("(?s)" + pattern), F.regexp_extract(rest, "(?s)" + pattern, 1))
    return F.struct(
        scheme.alias("scheme"),
        there(r"^//([^/?#]*)").alias("authority"),
        F.regexp_extract(rest, r"(?s)^(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        there(r"^[^?#]*\?([^#]*)").alias("query"),
        there(r"^[^#]*#(.*)$").alias("fragment"),
    )


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments have been followed (RFC 3986, 5.2.4): a fold over its segments."""
    rooted = path.startswith("/")
    segments = F.split(F.when(rooted, F.substr(path, F.lit(2))).otherwise(path), "/", -1)
    none = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(segments, none, lambda done, s: F.when(s == ".", done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s))))
    last = F.element_at(segments, -1)
    ended = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.when(rooted, "/").otherwise(""), F.array_join(ended, "/"))).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference as an absolute address, seen from the page at ``base`` (RFC 3986, 5.2)."""

    def joined(x: Column) -> Column:
        b, r = x["base"], x["ref"]
        merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], r"[^/]*$", ""), r["path"]))
        path = F.when(r["path"].startswith("/"), r["path"]).otherwise(merged)
        own, placed = r["scheme"].isNotNull(), r["authority"].isNotNull()
        stays = ~own & ~placed & (r["path"] == "")
        full = F.when(own | placed, r["path"]).when(stays, b["path"]).otherwise(path)
        query = F.when(stays & r["query"].isNull(), b["query"]).otherwise(r["query"])
        authority = F.when(own | placed, r["authority"]).otherwise(b["authority"])
        head = lambda mark, part: F.coalesce(F.concat(F.lit(mark), part), F.lit(""))
        scheme = F.when(own, r["scheme"]).otherwise(b["scheme"])
        return F.concat(F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), head("//", authority), F.when(stays, full).otherwise(without_dots(full)), head("?", query), head("#", r["fragment"]))

    return values._once(F.struct(_parts(base).alias("base"), _parts(reference).alias("ref")), joined)


def links(pages: DataFrame, key: str, url: str, markup: str, path: str) -> DataFrame:
    """``key, pos, href``: the links of each page whose path matches, absolute, the first of each in page order.

    Entities in addresses are decoded before they are resolved.
    """
    found = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(markup, F.lit(r"""href=["']([^"']+)"""), F.lit(1))).alias("pos", "raw"))
    raw = F.replace(F.replace("raw", F.lit("&#38;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    absolute = found.select(key, "pos", resolve(F.col("_base"), F.trim(raw)).alias("href"))
    pathname = F.regexp_extract("href", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return absolute.where(pathname.rlike(path)).groupBy(key, "href").agg(F.min("pos").alias("pos")).select(key, "pos", "href")


def sitemap(documents: DataFrame, xml: str) -> DataFrame:
    """``loc, lastmod`` of every ``<url>`` block that has a location."""
    block = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    part = lambda name: F.nullif(F.trim(F.regexp_extract("b", rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    return documents.select(block.alias("b")).select(part("loc").alias("loc"), part("lastmod").alias("lastmod")).where("loc IS NOT NULL")


def newest_chunks(documents: DataFrame, loc: str, n: int) -> DataFrame:
    """The ``n`` sitemap chunks of the highest number in their name."""
    number = F.regexp_extract(loc, r"(\d+)\D*$", 1).try_cast("long")
    return documents.withColumn("_n", number).where("_n IS NOT NULL").orderBy(F.desc("_n"), loc).limit(n).drop("_n")


def nodes_of(raw: Column, depth: int = 8) -> Column:
    """``array<variant>``: the nodes of a linked-data script, in its order, through arrays and graphs of ``depth`` levels.

    An array stands for its elements and an object with an array ``@graph`` for that array's; any other value is a node.
    A script that is no JSON has none.  What lies deeper stays folded.
    """
    below = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, '$["@graph"]', "array<variant>"), F.array(v))
    nodes = F.array_compact(F.array(F.try_parse_json(raw)))
    for _ in range(depth):
        nodes = F.flatten(F.transform(nodes, below))
    return nodes


def is_a(node: Column, kind: str) -> Column:
    """Whether a node's type is ``kind``, or its list of types holds it."""
    one = F.try_variant_get(node, '$["@type"]', "string")
    many = F.try_variant_get(node, '$["@type"]', "array<string>")
    return F.coalesce(F.array_contains(many, kind), one == kind, F.lit(False))


def linked_data(pages: DataFrame, key: str, markup: str, kind: str = "JobPosting", depth: int = 8) -> DataFrame:
    """``key, node``: the first linked-data node of a type on each page, as JSON; broken scripts are skipped.

    Scripts hold nodes, lists of nodes and graphs, in one another (see :func:`nodes_of`).
    """
    scripts = F.regexp_extract_all(markup, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    every = F.flatten(F.transform(scripts, lambda raw: nodes_of(F.trim(raw), depth)))
    first = F.get(F.filter(every, lambda node: is_a(node, kind)), F.lit(0))
    return pages.select(key, first.alias("_node")).where("_node IS NOT NULL").select(key, F.to_json("_node").alias("node"))


#: What linked data calls the unit of a salary (fixed values).
SALARY_UNITS = {"HOUR": "uur", "DAY": "dag", "MONTH": "maand"}


def posting_facts(nodes: DataFrame) -> DataFrame:
    """Title, dates, hours, contract tokens, education and salary of posting nodes."""
    at = lambda path: F.get_json_object("node", path)
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in SALARY_UNITS.items() for x in kv)), F.upper(at("$.baseSalary.value.unitText")))
    kinds = F.coalesce(F.from_json(at("$.employmentType"), "array<string>"), F.array(at("$.employmentType")))
    return nodes.select(
        *[c for c in nodes.columns if c != "node"],
        strip(at("$.title")).alias("title"),
        at("$.datePosted").alias("date_posted"),
        at("$.validThrough").alias("valid_through"),
        at("$.workHours").alias("work_hours"),
        F.array_compact(kinds).alias("employment"),
        F.coalesce(at("$.educationRequirements.credentialCategory"), F.when(~at("$.educationRequirements").startswith("{"), at("$.educationRequirements"))).alias("education"),
        F.coalesce(at("$.baseSalary.value.minValue"), at("$.baseSalary.value.value")).try_cast("double").alias("salary_min"),
        F.coalesce(at("$.baseSalary.value.maxValue"), at("$.baseSalary.value.value")).try_cast("double").alias("salary_max"),
        unit.alias("salary_unit"),
    )
