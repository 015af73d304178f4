"""Captured listing pages as a data source: a page is a partition, and the number of pages read is the checkpoint.

``spark.readStream.format("pages").options(...)`` gives ``page, pos, record, captured, total, short`` for each record, in
batches from the page after the checkpoint to the last one captured; ``spark.read`` gives all of them.  Options:

* ``path``: the folder with ``page-1.json``, ``page-2.json``, ...; each holds ``capturedAt`` and ``payload``.  It must be one
  that Python on all machines can open (a mounted folder); listings in other stores go through ``listings.read``.
* ``records``, ``page``, ``size``, ``total``: pointers into the payload, names joined by dots; ``[]`` behind a name goes
  through an array.  Only ``records`` is needed.
* ``most``: pages that a listing may have (100); one that says it has more is an error, not a part of it.

A listing whose numbers are no whole numbers, that doesn't begin at page 1 or whose pages say other numbers than their own
is an error.  ``short`` tells a page that holds fewer records than its listing promises for it.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sluice.shipping import ship

SCHEMA = "page int, pos int, record string, captured string, total long, short boolean"


def pointed(document: object, pointer: str) -> list:
    """What a pointer leads to in a document, through objects and, at ``[]``, arrays; an error where nothing is."""
    steps = pointer.split(".")
    if "" in steps or "[]" in steps:
        raise ValueError(f"the pointer {pointer!r} has an empty step")
    found = [document]
    for step in steps:
        name, many = step.removesuffix("[]"), step.endswith("[]")
        below = [x[name] for x in found if isinstance(x, dict) and name in x]
        if not below:
            raise ValueError(f"the pointer {pointer!r} leads nowhere at {step!r}")
        if many:
            if not all(isinstance(x, list) for x in below):
                raise ValueError(f"the pointer {pointer!r} finds no array at {step!r}")
            below = [x for xs in below for x in xs]
            if not below:
                return []
        found = below
    return found


def number(payload: object, pointer: str, least: int) -> int:
    """The one whole number at a pointer."""
    found = pointed(payload, pointer)
    value = found[0] if len(found) == 1 else None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < least:
        raise ValueError(f"{pointer!r} gives no whole number of {least} or more")
    return int(value)


class Listing:
    """A captured listing: where its pages lie and how its numbers are found."""

    def __init__(self, options: dict[str, str]):
        self.path, self.records = options["path"], options["records"]
        self.pointers = {k: options[k] for k in ("page", "size", "total") if options.get(k)}
        self.most = int(options.get("most", 100))

    def file(self, page: int) -> str:
        return os.path.join(self.path, f"page-{page}.json")

    def numbers(self, payload: object) -> dict[str, int]:
        return {k: number(payload, p, 0 if k == "total" else 1) for k, p in self.pointers.items()}

    def load(self, page: int) -> dict:
        with open(self.file(page), encoding="utf-8") as file:
            return json.load(file)

    def pages(self) -> int | None:
        """How many pages the listing says it has, by its first one; null if it doesn't say."""
        said = self.numbers(self.load(1)["payload"])
        if "size" not in said or "total" not in said:
            return None
        many = max(1, math.ceil(said["total"] / said["size"]))
        if said.get("page", 1) != 1:
            raise ValueError(f"a listing begins at page 1, not {said['page']}")
        if many > self.most:
            raise ValueError(f"the listing has {many} pages, more than {self.most}")
        return many

    def captured(self) -> int:
        """Pages that lie there, from the first on without a gap; only the first is opened."""
        there = 0
        while os.path.exists(self.file(there + 1)):
            there += 1
        said = self.pages() if there else None
        return there if said is None else min(there, said)

    def read(self, page: int) -> Iterator[tuple]:
        envelope = self.load(page)
        payload = envelope["payload"]
        said = self.numbers(payload)
        if said.get("page", page) != page:
            raise ValueError(f"page {page} calls itself {said['page']}")
        records = pointed(payload, self.records + "[]" if not self.records.endswith("[]") else self.records)
        total, size = said.get("total"), said.get("size")
        short = None
        if total is not None and size is not None:
            short = len(records) < min(size, max(0, total - (page - 1) * size))
        for pos, record in enumerate(records):
            yield (page, pos, json.dumps(record, ensure_ascii=False), envelope.get("capturedAt"), total, short)


class Page(InputPartition):
    pass


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = Listing(options)

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(1, self.listing.captured() + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None and partition.value is not None:
            yield from self.listing.read(partition.value)


class PagesStream(PagesReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.listing.captured()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(n) for n in range(start["pages"] + 1, end["pages"] + 1)]


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagesStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``pages`` known to a session."""
    ship(spark)
    spark.dataSource.register(Pages)
