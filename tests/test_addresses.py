from urllib.parse import urljoin

from pyspark.sql import functions as F

from sluice.functions import html

BASES = ["https://a.nl/x/y/z.html", "http://b.org", "https://c.de/a/b/?q=1#f", "https://d.fr/x/../y/./z?k=/v/..", "https://e.nl/p;x/q"]
REFERENCES = [
    "g", "./g", "g/", "/g", "//h/k", "?y=1", "g?y", "#s", "g#s", ";x", "../g", "../../g", "../../../g", "..", ".", "../", "./", "./g/.", "g/./h", "g/../h", "/./g", "/../g", "g.", "..g", "https://o.org/a/../b",
    "mailto:x@y.z", "a b", "g?y/../x", "g#s/../x", "/a/b/c/./../../g", "tel:+31",
]


def test_references_resolve_as_the_standard_says(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES]
    got = {(x["b"], x["r"]): x["a"] for x in spark.createDataFrame(rows, "b string, r string").select("b", "r", html.resolve(F.col("b"), F.col("r")).alias("a")).collect()}
    # The library leaves dots in references that have a scheme; the standard does not.
    want = {k: "https://o.org/b" if k[1] == "https://o.org/a/../b" else urljoin(*k) for k in got}
    assert [(k, got[k], want[k]) for k in got if got[k] != want[k]] == []


def test_links_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    relative = pages.withColumn("html", F.concat("html", F.lit("<a href='../q/1'></a><a href='./w'></a><a href='?p=2&amp;r=1'></a><a href='#f'></a><a href='//h.nl/z'></a>")))
    got = {(r["page_id"], r["href"]) for r in html.links(relative, "page_id", "url", "html", "").collect()}
    found = relative.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit("""href=["']([^"']+)"""), F.lit(1))).alias("raw")).collect()
    assert got == {(r["page_id"], urljoin(r["url"], r["raw"].replace("&amp;", "&").strip())) for r in found}
