"""Sites whose postings are linked data in pages, as descriptions: where their pages are found, which count, and what else they say.

A site's pages are found in a sitemap or by the links of a listing; a page's posting is the first node of its type, at any
depth of its scripts, and labelled values of the page fill what the node leaves open.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import contracts, html, values
from sluice.operators.dedup import bounded, dedup_key
from sluice.sources import listings


@dataclass(frozen=True)
class LinkedSite:
    """``kind`` is how pages are found: ``sitemap``, or ``listing`` with a pattern of the paths that are postings."""

    name: str
    kind: str
    url: str
    link: str = ""
    excluded: tuple[str, ...] = ()
    #: Fields by what of a page they are looked for in (``page`` or ``description``) and a pattern with one group.
    labels: dict[str, tuple[str, str]] = field(default_factory=dict)


#: Addresses, patterns and labels of known sites (fixed values).
SITES = {
    s.name: s
    for s in (
        LinkedSite("alliander", "sitemap", "https://werkenbij.alliander.com/sitemap.xml", excluded=(r"(?i)^(?!https://werkenbij\.alliander\.com/vacatures/[^/]+/jr\d+/?$).+$",)),
        LinkedSite("bam", "sitemap", "https://www.bamcareers.com/nl/nl/sitemap.xml", excluded=(r"^(?!https://www\.bamcareers\.com/nl/nl/job/\d+/[^/?#]+$).+$",)),
        LinkedSite("bluetrail", "sitemap", "https://www.bluetrail.nl/job-sitemap.xml", excluded=(r"/opdrachten/?$", r"[?&]order=", r"[?&]_sft_"), labels={
            "skills": ("page", r"(?s)Competenties:</strong><br><br><ul>(.*?)</ul>"), "ends": ("page", r"<b>Einddatum</b>([^<]+)"),
            "client": ("description", r"^\s*(?:<[^>]+>\s*)*Voor (?:de |het )?([A-Z][^,.<]{1,59}?) zoeken wij"), "place": ("page", r"<b>Locatie</b>([^<]+)"),
            "ref": ("page", r"<b>Referentienummer</b>([^<]+)"), "closes": ("page", r"<b>Sluitingsdatum</b>([^<]+)"), "starts": ("page", r"<b>Startdatum</b>([^<]+)"),
            "hours": ("page", r"<b>Uren per week</b>([^<]+)"),
        }),
        LinkedSite("circle8", "listing", "https://werkenbij.circle8.nl/jobs", r"^/jobs/\d+-[^/?#]+$", labels={
            "department": ("page", r"<dt[^>]*>\s*Afdeling\s*</dt>\s*<dd[^>]*>\s*([^<]+)"), "place": ("page", r"<dt[^>]*>\s*Locaties\s*</dt>\s*<dd[^>]*>\s*([^<]+)"),
            "role": ("page", r"<dt[^>]*>\s*Rol\s*</dt>\s*<dd[^>]*>\s*([^<]+)"), "work_form": ("page", r"<dt[^>]*>\s*Status werken op afstand\s*</dt>\s*<dd[^>]*>\s*([^<]+)"),
            "rate": ("description", r"(?i)((?:maand)?salaris\b[^<.]{0,80}?€\s*[\d.,]+(?:\s*(?:[-–]|en|tot|t/m)\s*€?\s*[\d.,]+)?)"),
            "hours": ("description", r"(?i)werkt\s+tussen\s+de\s+(\d+\s*(?:en|tot|t/m|[-–])\s*\d+\s*uur)"),
        }),
        LinkedSite("datajobs", "sitemap", "https://www.datajobs.nl/sitemap.xml", excluded=(r"^(?!https://www\.datajobs\.nl/vacatures/[^/?#]+$).+$",)),
        LinkedSite("eneco", "sitemap", "https://www.werkenbijeneco.nl/sitemap.xml", excluded=(r"^(?!https://www\.werkenbijeneco\.nl/vacatures/[^/]+-\d+$).+$",)),
        LinkedSite("hero", "listing", "https://hero.eu/interim-opdrachten", r"^/interim-opdrachten/[a-z0-9-]+$", (r"/api/",)),
        LinkedSite("ns", "listing", "https://www.werkenbijns.nl/vacatures", r"^/vacatures/[a-z0-9]+-[a-z0-9-]+$"),
        LinkedSite("planet-interim", "listing", "https://planetinterim.nl/opdrachten", r"^/[a-z0-9-]+/\d+/p\d+/default\.html$"),
    )
}


def detail_urls(captured: DataFrame, site: LinkedSite) -> DataFrame:
    """``url, lastmod, pos`` of the postings that a site's captured sitemap or listing (``body``) names, the first of each."""
    if site.kind == "sitemap":
        found = html.sitemap(captured, "body").select(F.col("loc").alias("url"), "lastmod", F.lit(0).alias("pos"))
    else:
        found = html.links(captured.withColumn("_at", F.lit(site.url)), "_at", "_at", "body", site.link).select(F.col("href").alias("url"), F.lit(None).cast("string").alias("lastmod"), "pos")
    return listings.excluded(found, "url", list(site.excluded))


def drafts(pages: DataFrame, site: LinkedSite) -> DataFrame:
    """Pages (``url, html``) as drafts; pages without a posting give none.

    A labelled value comes before the node's for what the page itself labels (hours, dates, place, reference) and fills
    the rest; a posting's contract form comes from its tokens, else its text.
    """
    nodes = html.posting_facts(html.linked_data(pages.select("url", "html"), "url", "html").withColumn("raw", F.col("node")))
    at = lambda path: F.nullif(F.trim(F.get_json_object("raw", path)), F.lit(""))
    whole = nodes.join(pages.select("url", "html"), "url").withColumn("text", at("$.description"))
    found = html.label_blocks(F.col("html"), F.col("text"), site.labels) if site.labels else F.create_map().cast("map<string,string>")
    said = whole.withColumn("said", found)
    label: dict[str, Column] = {name: F.element_at("said", name) for name in ("ref", "client", "place", "starts", "ends", "closes", "hours", "rate", "skills")}
    body = html.strip(F.col("text"))
    salary = F.struct(F.col("salary_min").alias("min"), F.col("salary_max").alias("max"), F.col("salary_unit").alias("unit"))
    written = values.rate(F.coalesce(label["rate"], body))
    rate = F.when(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull(), salary).otherwise(written)
    client = F.coalesce(label["client"], at("$.hiringOrganization.name"))
    starts = F.coalesce(values.dutch_date(label["starts"]).cast("string"), label["starts"], at("$.jobStartDate"))
    problems = F.array_compact(F.array(F.when(F.col("title") == "", "no title"), F.when(values.gap(body), "no description")))
    return said.select(
        F.lit(site.name).alias("source"), bounded(F.coalesce(label["ref"], at("$.identifier.value"), at("$.identifier"), F.col("url")), 512).alias("ref"), "url", "title", html.usable(F.col("text")).alias("description"),
        client.alias("client"), F.coalesce(label["place"], at("$.jobLocation.address.addressLocality"), at("$.jobLocation[0].address.addressLocality")).alias("place"),
        values.publication(F.col("date_posted")).alias("posted"), starts.alias("starts"), F.coalesce(values.dutch_date(label["ends"]).cast("string"), label["ends"]).alias("ends"),
        values.closing_moment(F.coalesce(values.dutch_date(label["closes"]).cast("string"), label["closes"], F.col("valid_through"))).alias("closing"),
        values.hours_range(values.hours_text(F.coalesce(label["hours"], F.col("work_hours"), body))).alias("hours"), rate.alias("rate"),
        contracts.resolved_contract(F.lit(None).cast("string"), F.col("employment"), F.concat_ws("\n", "title", body)).alias("contract"), "education",
        values.skills(F.regexp_extract_all(label["skills"], F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("skills"), dedup_key(F.col("title"), client, starts).alias("dedup_key"), problems.alias("problems"),
    )
