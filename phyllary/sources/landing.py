"""Landed pages on disk, and a data source that reads raw response files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from phyllary.sources.common import PAGE


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as Parquet in a folder for each source, so that a scan of one source reads nothing of the others."""
    pages.write.mode("append").partitionBy("source").parquet(folder)


def read_pages(spark: SparkSession, folder: str, source: str | None = None, query_name: str | None = None) -> DataFrame:
    """The pages of a source and query: the source prunes folders, the query is pushed to the scan."""
    pages = spark.read.schema(PAGE).parquet(folder)
    pages = pages.select("source", "query_name", "page_no", "url", "body")
    if source is not None:
        pages = pages.where(pages["source"] == source)
    return pages if query_name is None else pages.where(pages["query_name"] == query_name)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, folder: str, files_per_task: int, source: str | None) -> None:
        self.folder, self.files_per_task, self.source = folder, files_per_task, source

    def partitions(self) -> list[InputPartition]:
        root = Path(self.folder)
        folders = [root / self.source] if self.source is not None else sorted(p for p in root.iterdir() if p.is_dir())
        paths = [str(p) for d in folders if d.is_dir() for p in sorted(d.glob("*.json"))]
        return [_Files(paths[i : i + self.files_per_task]) for i in range(0, len(paths), self.files_per_task)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            p = Path(path)
            page = json.loads(p.read_text(encoding="utf-8"))
            body = page.get("body")
            yield p.parent.name, page.get("query_name"), page.get("page_no"), page.get("url"), body if isinstance(body, str) or body is None else json.dumps(body, ensure_ascii=False)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802 (the interface's name)
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",) and self.source in (None, f.value):
                self.source = f.value
            else:
                yield f


class LandedPages(DataSource):
    """Raw response files, <folder>/<source>/*.json, each an object with query_name, page_no, url and body (text or JSON).

    spark.dataSource.register(LandedPages); spark.read.format("landed_pages").option("folder", f).load(). The option source reads that
    source's folder only; with the option pushdown a filter on source does (spark.sql.python.filterPushdown.enabled must be on then).
    The folder must be one that every executor sees.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        kind = _PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options["folder"], int(self.options.get("files_per_task", "64")), self.options.get("source"))
