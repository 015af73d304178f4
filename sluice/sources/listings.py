"""JSON listings of job sites as drafts of one schema, by a description of each site's fields.

A site is described, not programmed: where its records are and which path holds each field.  Adding a site adds
a description.  Paths are those of ``get_json_object``; several are tried in order.  A path with a pattern behind it gives
the pattern's first group.  Sites whose pages are HTML are described by what is stored of a page: a listing row and a detail.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import contracts, html, proposals, values
from sluice.operators.dedup import bounded, dedup_key


@dataclass(frozen=True)
class Site:
    """Where a listing keeps its records (a JSON path to an array) and the paths of their fields."""

    name: str
    records: str
    fields: dict[str, tuple[str | tuple[str, str], ...]]
    total: str | None = None
    constants: dict[str, str] = field(default_factory=dict)


ABOVE_ZERO, ONE = r"^(0*[1-9].*|0*[.,].*[1-9].*)$", r"^\s*(\d+(?:[.,]\d+)?)\s*$"
#: What sites call the unit of a rate (fixed values).
UNITS = {"uur": "uur", "hour": "uur", "hourly": "uur", "daily": "dag", "monthly": "maand"}
#: Field paths of known listings (fixed values).
SITES = {
    s.name: s
    for s in (
        Site("striive", "$.data", {"ref": ("$.id", "$.referenceCode"), "title": ("$.title",), "description": ("$.content",), "client": ("$.clientName",), "place": ("$.location",), "hours_min": ("$.hoursPerWeekMin",), "hours_max": ("$.hoursPerWeekMax",), "starts": ("$.startDate",), "ends": ("$.endDate",), "closes": ("$.closingDateClient",)}, "$.total"),
        Site("inhuurdesk", "$.data", {"ref": ("$.id",), "title": ("$.title",), "description": ("$.content",), "client": ("$.clientName",), "place": ("$.location",), "hours_min": ("$.hoursPerWeekMin",), "hours_max": ("$.hoursPerWeekMax",), "posted": ("$.publishedDate",), "starts": ("$.startDate",), "closes": ("$.closingDateClient",)}, "$.total"),
        Site("tenderned", "$.content", {"ref": ("$.publicatieId",), "title": ("$.aanbestedingNaam",), "description": ("$.opdrachtBeschrijving",), "client": ("$.opdrachtgeverNaam",), "posted": ("$.publicatieDatum",)}, "$.totalElements"),
        Site("onefellow", "$.jobs", {"ref": ("$.joborder_id",), "title": ("$.title",), "description": ("$.description", "$.teaser"), "client": ("$.company",), "place": ("$.company_city", "$.address_city"), "posted": ("$.time_published",), "starts": ("$.start_date",), "closes": ("$.time_deadline",), "rate_text": ("$.max_rate", "$.salary")}),
        Site("ctm", "$.entries", {"ref": ("$.referentie", "$.aanvraagnummer"), "title": ("$.titel",), "client": ("$.organisatie",), "posted": ("$.publicatiedatum",), "closes": ("$.sluitingstijd",)}),
        Site("harveynash", "$.results", {"ref": ("$.job.id",), "title": ("$.job.title",), "place": ("$.job.addresses[0]",), "rate_text": ("$.job.salary_package",)}, "$.total_size"),
        Site("werk-nl", "$.items", {"ref": ("$.referenceNumber", "$.key"), "title": ("$.vacatureTitle",), "client": ("$.organisation",), "hours_min": ("$.minHours",), "hours_max": ("$.maxHours",), "contract_text": ("$.contractType",)}, "$.totalResults"),
        Site("opdrachtoverheid", "$.negometrix_tenders", {
            "ref": ("$.tender_id",), "title": ("$.tender_name",), "description": ("$.tender_description", "$.tender_name"), "client": ("$.tender_buying_organization",),
            "place": ("$.tender_job_location", "$.vacancies_location.company_address", "$.vacancies_location.province", "$.organization_location.company_address", "$.organization_location.province"),
            "hours_min": (("$.tender_min_hours", ABOVE_ZERO), ("$.tender_hours_week", ONE)), "hours_max": (("$.tender_max_hours", ABOVE_ZERO), ("$.tender_hours_week", ONE)),
            "starts": ("$.tender_start_date",), "ends": ("$.tender_end_date",), "closes": ("$.tender_offline_date",), "posted": ("$.tender_first_seen",), "contract_text": ("$.contract_type",),
            "rate_max": ("$.tender_maximum_tariff", ("$.tender_tariff", r"(?i)^(?!.*geen\s*maximum).*?(\d+(?:[.,]\d+)?)")), "education": (("$.education_level_obj.education_level_label", r"(?i)^(?!onbekend$)(.+)$"),),
        }, constants={"rate_unit": "uur"}),
        Site("mercell", "$.CurrentPageResults", {"ref": ("$.TenderId",), "title": ("$.TenderName",), "description": ("$.TenderDescription", "$.TenderName"), "client": ("$.OrganizationName",), "posted": ("$.PublicationDate",), "closes": ("$.Deadline",)}, "$.ResultsCount"),
        Site("needstaffing", "$.items", {
            "ref": ("$.detail.id",), "title": ("$.detail.titel",), "description": ("$.raw.html", "$.detail.titel"), "client": ("$.listing.opdrachtgeverNaam",), "place": ("$.detail.locatie",),
            "hours_min": (("$.detail.uren", r"^(\d+)"),), "hours_max": (("$.detail.uren", r"^(?:\d+\s*-\s*)?(\d+)"),), "starts": ("$.detail.start",), "closes": ("$.detail.deadline",), "duration": ("$.detail.periode",),
            "rate_min": ("$.detail.tariefMin",), "rate_max": ("$.detail.tariefMax",), "rate_unit": (("$.detail.tarief", r"(?i)\bper\s+(uur|hour)\b"),), "work_form": ("$.detail.werkvorm",), "skills": ("$.detail.competenties",),
        }),
        Site("flinter", "$.items", {"ref": ("$.listing.slug",), "title": ("$.detail.titel", "$.listing.titel"), "description": ("$.detail.beschrijvingHtml", "$.detail.titel"), "client": ("$.listing.opdrachtgeverNaam",), "place": ("$.listing.locatiePlaats",), "hours_min": ("$.detail.urenPerWeek",), "hours_max": ("$.detail.urenPerWeek",), "duration": ("$.listing.looptijdTekst",)}),
        Site("freelancer-nl", "$.items", {
            "ref": ("$.detail.bronReferentie",), "title": ("$.detail.titel", "$.listing.titel"), "description": ("$.detail.omschrijvingHtml", "$.detail.titel"), "place": ("$.detail.locatie", "$.listing.locatie"),
            "posted": (("$.detail.geplaatst", r"(?i)^geplaatst\s+(.+)$"),), "starts": (("$.detail.start", r"^(\d{2}-\d{2}-\d{4})$"),), "duration": ("$.detail.verwachteDuur",), "skills": ("$.detail.skills",),
            "rate_text": (("$.listing.budget", r"(?i)^(.*\b(?:per\s+(?:uur|dag|maand)|p/u)\b.*)$"),),
        }),
        Site("prounity", "$.items", {
            "ref": ("$.detail.uuid",), "title": ("$.detail.titel",), "description": ("$.raw.html", "$.detail.titel"), "place": ("$.detail.land",), "duration": ("$.detail.duur",), "skills": ("$.detail.skills[*].naam",),
            "starts": (("$.detail.periode", r"(\d{2}/\d{2}/\d{4})\s*-"),), "ends": (("$.detail.periode", r"-\s*(\d{2}/\d{2}/\d{4})"),), "closes": (("$.detail.periode", r"-\s*(\d{2}/\d{2}/\d{4})"),),
        }),
        Site("linkedin", "$.items", {"ref": ("$.listing.bronReferentie",), "title": ("$.listing.titel",), "description": ("$.detail.description",), "client": ("$.listing.opdrachtgever",), "place": ("$.listing.locatie",), "posted": ("$.listing.geplaatst",), "contract_text": ("$.detail.criteria.employment_type",)}),
        Site("indeed", "$.items", {
            "ref": ("$.jobkey",), "title": ("$.detail.jobTitle", "$.card.displayTitle", "$.card.title"), "description": ("$.detail.sanitizedJobDescription", "$.card.snippet"), "client": ("$.detail.companyName", "$.card.company"),
            "place": ("$.detail.formattedLocation", "$.card.formattedLocation"), "posted": ("$.card.pubDate",), "work_form": ("$.detail.remoteWorkModel.text", "$.card.remoteWorkModel.text"),
            "rate_min": (("$.detail.salaryInfoModel.salaryMin", ABOVE_ZERO), ("$.card.extractedSalary.min", ABOVE_ZERO)), "rate_max": (("$.detail.salaryInfoModel.salaryMax", ABOVE_ZERO), ("$.card.extractedSalary.max", ABOVE_ZERO)),
            "rate_unit": ("$.detail.salaryInfoModel.salaryType", "$.card.extractedSalary.type"),
        }),
    )
}
DRAFT = ("title", "description", "client", "place", "posted", "starts", "ends", "closes", "hours_min", "hours_max", "rate_text", "contract_text", "work_form", "education", "duration", "skills", "rate_min", "rate_max", "rate_unit")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, captured, payload``: captured listing pages, one JSON document each, the payload as text."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.get_json_object("value", "$.capturedAt").alias("captured"), F.get_json_object("value", "$.payload").alias("payload"))


def records(pages: DataFrame, site: Site) -> DataFrame:
    """``pos, record`` of all records of a site's pages, in page order."""
    every = F.from_json(F.get_json_object("payload", site.records), "array<string>")
    return pages.select(*[c for c in pages.columns if c != "payload"], F.posexplode(every).alias("pos", "record"))


def total(pages: DataFrame, site: Site) -> DataFrame:
    """How many records the site says there are, and how many its pages hold."""
    said = F.get_json_object("payload", site.total).try_cast("long") if site.total else F.lit(None).cast("long")
    held = F.size(F.from_json(F.get_json_object("payload", site.records), "array<string>"))
    return pages.agg(F.max(said).alias("said"), F.sum(held).alias("held"))


def _at(site: Site, name: str) -> Column:
    def one(path: str | tuple[str, str]) -> Column:
        if isinstance(path, str):
            return F.get_json_object("record", path)
        return F.regexp_extract(F.trim(F.get_json_object("record", path[0])), path[1], 1)

    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = [blank(one(p)) for p in site.fields.get(name, ())]
    constant = F.lit(site.constants.get(name)).cast("string")
    return F.coalesce(*found, constant) if found else constant


def _written(name: str) -> Column:
    """A date as a site writes it: thousandths of a second since 1970 become a moment, a day its ISO form, anything else stays."""
    epoch = F.when(F.col(name).rlike(r"^\d{11,14}$"), F.date_format(F.timestamp_millis(F.col(name).try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.coalesce(epoch, F.when(F.col(name).rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"), proposals.day(F.col(name))), F.col(name))


def _rate(text: Column) -> Column:
    """The rate that a site states by its bounds and unit, else the first of its texts."""
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    low, high = number("rate_min"), number("rate_max")
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), F.lower("rate_unit"))
    stated = F.struct(low.alias("min"), high.alias("max"), unit.alias("unit"))
    return F.when((low.isNotNull() | high.isNotNull()) & unit.isNotNull(), stated).otherwise(values.rate(text))


def drafts(rows: DataFrame, site: Site, also: tuple[str, ...] = ()) -> DataFrame:
    """Records as drafts: plain texts, parsed hours, rate, contract, province and dates, keys, hash and problems, and columns of ``also``."""
    raw = rows.select(*[c for c in rows.columns if c != "record"], "record", bounded(_at(site, "ref"), 512).alias("ref"), *(_at(site, n).alias(n) for n in DRAFT))
    title, text = html.strip(F.col("title")), html.strip(F.col("description"))
    typed = F.regexp_replace(F.coalesce("rate_text", F.lit("")), "[‐-―−]", "-")
    problems = F.array_compact(F.array(F.when(F.col("ref").isNull(), "no key"), F.when(values.gap(title), "no title"), F.when(values.gap(text), "no description")))
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    return raw.select(
        F.lit(site.name).alias("source"), "ref", title.alias("title"), text.alias("description"), "client", "place",
        F.coalesce(values.province(F.col("place")), values.last_province(F.col("place"))).alias("province"),
        _written("posted").try_cast("timestamp").alias("posted"), _written("starts").alias("starts"), _written("ends").alias("ends"), values.closing_moment(_written("closes")).alias("closing"),
        number("hours_min").alias("hours_min"), number("hours_max").alias("hours_max"), _rate(F.concat_ws(" ", typed, text)).alias("rate"),
        F.coalesce(values.contract_form(F.col("contract_text")), contracts.contract_in_text(F.concat_ws(" ", title, text))).alias("contract"),
        F.coalesce(values.work_form(F.col("work_form")), values.work_form(F.concat_ws(" ", title, text))).alias("work_form"), dedup_key(title, F.col("client"), F.col("starts")).alias("dedup_key"),
        F.sha2("record", 256).alias("hash"), problems.alias("problems"), "education", "duration",
        F.coalesce(values.skills(F.from_json("skills", "array<string>")), F.array().cast("array<string>")).alias("skills"), *also,
    )


def excluded(listed: DataFrame, url: str, patterns: list[str]) -> DataFrame:
    """Listed rows whose url matches none of the patterns, the first of each url in listing order (``pos``)."""
    out = listed
    for p in patterns:
        out = out.where(~F.col(url).rlike(p))
    return out.withColumn("_first", F.expr(f"row_number() OVER (PARTITION BY {url} ORDER BY pos)")).where("_first = 1").drop("_first")
