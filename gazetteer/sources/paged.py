"""A paged JSON service as a Spark source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE = 5000
FetchPage = Callable[[int, int], list[dict]]


class Lane(InputPartition):
    """Pages ``first``, ``first + step``, ... of the service."""

    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


def read_paged(
    spark: SparkSession, fetch_page: FetchPage, columns: list[str],
    page_size: int = PAGE_SIZE, lanes: int = 8,
) -> DataFrame:
    """All rows of a service that answers ``fetch_page(offset, limit)``.

    The number of pages is not known ahead, so each task reads every n-th page
    until it meets a short one.  Values are text; ``_ord`` is the row's place.
    """
    schema = T.StructType(
        [T.StructField("_ord", T.LongType())] + [T.StructField(c, T.StringType()) for c in columns])

    class Reader(DataSourceReader):
        def partitions(self):
            return [Lane(i, lanes) for i in range(lanes)]

        def read(self, partition: Lane) -> Iterator[tuple]:
            page = partition.first
            while True:
                rows = fetch_page(page * page_size, page_size)
                for i, row in enumerate(rows):
                    yield (page * page_size + i, *[
                        None if row.get(c) is None else str(row[c]) for c in columns])
                if len(rows) < page_size:
                    return
                page += partition.step

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_json"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").load()


def parquet_pages(path: str, columns: list[str]) -> FetchPage:
    """Pages out of a parquet file, standing in for a service without a network."""
    def fetch(offset: int, limit: int) -> list[dict]:
        import pyarrow.parquet as pq

        file = pq.ParquetFile(path)
        rows, start = [], 0
        for g in range(file.metadata.num_row_groups):
            size = file.metadata.row_group(g).num_rows
            lo, hi = max(offset - start, 0), min(offset + limit - start, size)
            if lo < hi:
                rows += file.read_row_group(g, columns=columns).slice(lo, hi - lo).to_pylist()
            start += size
        return rows

    return fetch
