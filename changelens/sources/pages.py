"""Paged listings as a Spark data source: a partition for each listing, read page by page until what a filter asks
for is passed.

A listing gives its newest rows first. A filter `time > value` is pushed down to the reader, which then stops behind
the first page that reaches back to that value instead of walking to the end. A page whose tag is known is asked for
with it; where it has not changed, the body kept from the last time is used."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

PUSH_KEY = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Page:
    """Rows of a page, the address of the next one, and the tag it was served under. Without rows: not changed."""

    rows: list[tuple] | None
    next: str | None = None
    tag: str | None = None


@dataclass(frozen=True)
class Listing:
    """What is listed: a schema, its time column, and the first address of each partition. fetch(address, tag)
    asks for a page; kept(address) gives a page of the last time, if there is one. Both run in tasks."""

    schema: str
    time: str
    first: tuple[str, ...]
    fetch: Callable[[str, str | None], Page]
    kept: Callable[[str], Page | None] = field(default=lambda address: None)


@dataclass
class Start(InputPartition):
    address: str


class PageReader(DataSourceReader):
    def __init__(self, listing: Listing) -> None:
        self.listing, self.floor = listing, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the time from below tell where to stop; rows are filtered by Spark all the same."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (self.listing.time,):
                self.floor = f.value if self.floor is None else max(self.floor, f.value)
            yield f

    def partitions(self) -> list[Start]:
        return [Start(address) for address in self.listing.first]

    def pages(self, address: str | None) -> Iterator[Page]:
        while address:
            before = self.listing.kept(address)
            page = self.listing.fetch(address, before.tag if before else None)
            if page.rows is None:
                if before is None:
                    return
                page = before
            yield page
            address = page.next

    def read(self, partition: Start) -> Iterator[tuple]:
        at = [c.strip().split()[0] for c in self.listing.schema.split(",")].index(self.listing.time)
        for page in self.pages(partition.address):
            yield from page.rows
            if self.floor is not None and any(r[at] is not None and r[at] < self.floor for r in page.rows):
                return  # all that follows is older


def register(spark: SparkSession, name: str, listing: Listing) -> None:
    """Makes a listing readable as spark.read.format(name).load()."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return listing.schema

        def reader(self, schema) -> DataSourceReader:
            return PageReader(listing)

    spark.conf.set(PUSH_KEY, "true")
    spark.dataSource.register(Pages)
