"""Raw payloads under their digest, imports from databases, and a generated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_raw(payloads: DataFrame, path: str) -> DataFrame:
    """Write ``slug, at, kind, body`` as Parquet by source and month; returns them with the ``ref`` that names each.

    A payload's name is its SHA-256, so that the same bytes have the same name whenever they come.
    """
    digest = F.sha2("body", 256)
    month = F.date_format(F.col("at").cast("timestamp"), "yyyy/MM")
    named = payloads.withColumns({"sha256": digest, "ref": F.concat_ws("/", F.lit("raw"), "slug", month, F.concat_ws(".", digest, "kind")), "month": F.replace(month, F.lit("/"), F.lit("-"))})
    named.dropDuplicates(["ref"]).write.mode("append").partitionBy("slug", "month").parquet(path)
    return named.drop("month")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads whose bytes no longer give their name."""
    return spark.read.parquet(path).where(F.sha2("body", 256) != F.col("sha256")).select("ref")


def from_database(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> DataFrame:
    """A table read in ``parts`` ranges of a numeric key, whose bounds the database gives."""
    base = spark.read.format("jdbc").options(url=url, **options)
    low, high = base.option("query", f"SELECT min({key}) AS a, max({key}) AS b FROM {table}").load().first()
    if low is None:
        return base.option("dbtable", table).load()
    return base.options(dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def import_window(rows: DataFrame, known: DataFrame, key: list[str], at: str, until: str) -> DataFrame:
    """Rows up to a moment that aren't imported yet; running it again imports nothing."""
    return rows.where(F.col(at) <= F.lit(until).cast("timestamp")).join(known.select(*key), key, "left_anti")


def import_metrics(selected: DataFrame, stored: DataFrame, by: str, key: str) -> DataFrame:
    """``by, is_total, selected, records, matched, missing, extra, duplicates`` of an import, by platform and, ``is_total`` 1, for all.

    ``selected`` are the rows that were to come, ``stored`` those that are there (both ``by, key``).  A key is matched if both
    have it, missing or extra if one has; stored rows beyond a key's first are duplicates.  One pass of grouping sets
    over one row for each key.
    """
    count = lambda rows, name: rows.groupBy(by, key).agg(F.count("*").alias(name))
    both = count(selected, "wanted").join(count(stored, "held"), [by, key], "full_outer")
    return both.sparkSession.sql(
        f"""
        SELECT `{by}`, grouping(`{by}`) AS is_total, count_if(wanted IS NOT NULL) AS selected, coalesce(sum(held), 0) AS records,
               count_if(wanted IS NOT NULL AND held IS NOT NULL) AS matched, count_if(held IS NULL) AS missing,
               count_if(wanted IS NULL) AS extra, coalesce(sum(held - 1), 0) AS duplicates
        FROM {{both}} GROUP BY GROUPING SETS ((`{by}`), ())""",
        both=both,
    )


#: Parts into which keys are dealt before rows are compared.
PARTS = 1024


def _digests(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows as ``key``, their part, and a digest of their values."""
    body = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    return rows.select(*key, F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int").alias("part"), body.alias("digest"))


def _sums(rows: DataFrame, name: str) -> DataFrame:
    """For each part the count of its rows and the sum of their digests' first 120 bits, so that order and place don't matter."""
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)")
    more = F.conv(F.substring("digest", 16, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("part").agg(F.struct(F.count("*"), F.sum(number), F.sum(more)).alias(name))


def readback(source: DataFrame, stored: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``key, problem``: what a readback finds - ``lost``, ``changed``, ``extra`` or ``repeated`` keys.

    Both sides are summed up by part as multisets of digests first; only the rows of parts that differ are
    matched by key, so a readback that finds nothing shuffles a few numbers.
    """
    a, b = _digests(source, key, columns), _digests(stored, key, columns)
    differing = _sums(a, "a").join(_sums(b, "b"), "part", "full_outer").where("NOT a <=> b").select("part")
    parts = F.broadcast(differing)  # PARTS numbers at most
    group = lambda rows, n, d: rows.join(parts, "part", "left_semi").groupBy(*key).agg(F.count("*").alias(n), F.max("digest").alias(d), F.min("digest").alias(f"{d}_least"))
    both = group(a, "n", "x").join(group(b, "m", "y"), key, "full_outer")
    problem = (
        F.when(F.col("m").isNull(), "lost")
        .when(F.col("n").isNull(), "extra")
        .when((F.col("x") != F.col("y")) | (F.col("x_least") != F.col("y_least")), "changed")
        .when(F.col("n") != F.col("m"), "repeated")
    )
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def corpus(spark: SparkSession, n: int, seed: int = 1337) -> DataFrame:
    """``n`` search documents that depend on the seed and their number only."""
    draw = lambda name, k: F.pmod(F.xxhash64("id", F.lit(f"{seed}-{name}")), F.lit(k))
    pick = lambda name, options: F.element_at(F.array(*map(F.lit, options)), (draw(name, len(options)) + 1).cast("int"))
    roles, tools = ["engineer", "consultant", "architect", "analyst"], ["java", "spark", "azure", "kubernetes", "scrum"]
    rate = draw("rate", 80) + 40
    return spark.range(n).select(
        "id", F.concat_ws(" ", pick("tool", tools), pick("role", roles)).alias("title"),
        F.concat_ws(" ", *(pick(f"w{i}", roles + tools + ["the", "with", "and"]) for i in range(12))).alias("text"),
        F.concat(F.lit("src"), draw("source", 40).cast("string")).alias("source"), pick("status", ["active", "active", "stale", "closed"]).alias("status"),
        F.when(draw("norate", 5) > 0, rate.cast("double")).alias("rate_min"), F.when(draw("norate", 5) > 0, (rate + draw("span", 30)).cast("double")).alias("rate_max"),
    )
