"""The market as a Spark data source: ``spark.read.format("market_feed")`` and, page by page, ``spark.readStream``.

A feed is a folder of pages. ``publish`` appends a batch of them: Parquet files of at most ``page_rows`` rows of one site and basis,
ordered by seller. A page is a partition of the scan. Filters on columns are pushed into the reader: those on site and basis
leave out pages by their paths, before any task starts; all go to the Parquet reader, which skips row groups by their
statistics. As a stream, the offset is the last page taken. Pages are only added and sort after the earlier ones, so a
stream that starts again goes on with the page behind its offset and repeats nothing.

Spark doesn't tell Python sources which columns are wanted, so a page is read with all of them. Folders are opened by pyarrow,
on the driver to list pages and in tasks to read them: the feed must lie where all can reach it.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith

from tidemark.plans.register import query
from tidemark.sources.shared import shared_folder
from tidemark.sources.views import market, titled

FORMAT = "market_feed"
SCHEMA = (
    "key string, basis string, kind string, site string, seller long, buyer long, part_key long, card string, series string, rarity string, grade int, grader string, "
    "price double, list_price double, quantity int, sold_at long, priority string, title string"
)
IN_PATH = ("site", "basis")
PAGE_ROWS = 50_000


def publish(rows: DataFrame, folder: str, batch: int = 0, page_rows: int = PAGE_ROWS) -> None:
    """Adds the pages of a batch to the feed; writing a batch again replaces it, so a repeated call adds nothing."""
    typed = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")])
    spread = typed.repartitionByRange(*IN_PATH, "seller").sortWithinPartitions(*IN_PATH, "seller")
    spread.write.mode("overwrite").option("maxRecordsPerFile", page_rows).partitionBy(*IN_PATH).parquet(f"{folder}/batch={batch:09d}")


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


@dataclass
class Page(InputPartition):
    """A page by its path below the feed's folder, which names its batch, site and basis."""

    path: str

    def values(self) -> dict[str, str | None]:
        found = dict(unquote(part).split("=", 1) for part in self.path.split("/")[:-1])
        return {c: None if found[c] == "__HIVE_DEFAULT_PARTITION__" else found[c] for c in IN_PATH}


def pages(folder: str) -> list[Page]:
    """All pages of finished batches, in the order in which they were added."""
    fs, root = opened(folder)
    files = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path[len(root.rstrip("/")) + 1 :] for f in files if f.is_file]
    finished = {n.split("/")[0] for n in names if n.endswith("/_SUCCESS") and n.count("/") == 1}
    return [Page(n) for n in sorted(names) if n.endswith(".parquet") and n.split("/")[0] in finished]


_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def expression(f: Filter) -> pc.Expression | None:
    """A filter for the Parquet reader, or None if Spark has to apply it."""
    if len(f.attribute) != 1:
        return None
    column = pc.field(f.attribute[0])
    if type(f) in _COMPARE:
        return _COMPARE[type(f)](column, f.value)
    if isinstance(f, In):
        return column.isin([v for v in f.value if v is not None])
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, f.value)
    return pc.match_substring(column, f.value) if isinstance(f, StringContains) else None


def may_hold(f: Filter, values: dict[str, str | None]) -> bool:
    """Whether a page of these path values may hold rows that pass."""
    if len(f.attribute) != 1 or f.attribute[0] not in values:
        return True
    value = values[f.attribute[0]]
    if type(f) in _COMPARE:
        return value is not None and _COMPARE[type(f)](value, f.value)
    return value in f.value if isinstance(f, In) else value is not None if isinstance(f, IsNotNull) else True


class PageReader:
    """Reads a page with the pushed filters."""

    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def read(self, partition: Page | None) -> Iterator:
        if partition is None:  # of a feed without pages Spark reads this
            return
        fs, root = opened(self.folder)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        page = pads.dataset(f"{root.rstrip('/')}/{partition.path}", filesystem=fs, format="parquet")
        constants = {c: pc.scalar(v) for c, v in partition.values().items()}
        columns = {c: constants[c].cast("string") if c in constants else pc.field(c) for c in names}
        wanted = [e for f in self.filters if f.attribute[0] not in IN_PATH and (e := expression(f)) is not None]
        yield from page.scanner(columns=columns, filter=functools.reduce(operator.and_, wanted) if wanted else None).to_batches()


class MarketReader(PageReader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if expression(f) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Page]:
        return [p for p in pages(self.folder) if all(may_hold(f, p.values()) for f in self.filters)]


class MarketStream(PageReader, DataSourceStreamReader):
    """Offsets are {"after": path of the last page taken}."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = pages(self.folder)
        return {"after": found[-1].path if found else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        return [p for p in pages(self.folder) if start["after"] < p.path <= end["after"]]

    def commit(self, end: dict) -> None:
        """Pages stay: other readers may want them."""


class MarketFeed(DataSource):
    """Option ``path``: the feed's folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options["path"])

    def streamReader(self, schema) -> MarketStream:  # noqa: N802
        return MarketStream(self.options["path"])


def enable(spark: SparkSession) -> None:
    """Registers the format with the session, and lets filters reach Python sources."""
    spark.dataSource.register(MarketFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def feed(spark: SparkSession, folder: str) -> DataFrame:
    enable(spark)
    return spark.read.format(FORMAT).load(folder)


@query("SELECT site, seller, basis, count(*) AS n, min(price) AS low, max(price) AS high, count(DISTINCT title) AS titles FROM titled GROUP BY ALL", "titled")
def market_feed_scan(spark, sf_dir):
    """The whole market published as pages and read back through the data source, by site, seller and basis."""
    folder = shared_folder(spark, "market-feed")
    publish(titled(market(spark, sf_dir)), folder)
    return feed(spark, folder).groupBy("site", "seller", "basis").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.count_distinct("title").alias("titles"))
