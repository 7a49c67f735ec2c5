"""Python data sources over landed folders: ``feeds`` and ``sitemaps``.

Each landed file is one input partition, so reading scales with the files.
Registered by :func:`register`; folders must be visible to every executor.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FolderReader(DataSourceReader):
    """Splits a folder by file; subclasses turn one file into rows."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        names = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else [self.path]
        return [_File(n) for n in names]

    def text(self, path: str) -> str:
        with open(path, "rb") as file:
            raw = file.read()
        try:
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        except (OSError, EOFError):
            return ""
        return raw.decode("utf-8", "replace")


class _FeedReader(_FolderReader):
    def read(self, partition: _File) -> Iterator[tuple]:
        name = os.path.splitext(os.path.basename(partition.path))[0]
        yield name, self.text(partition.path)


class FeedSource(DataSource):
    """(src_id, xml) of landed feeds; the file name is the source id."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "src_id string, xml string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _SitemapReader(_FolderReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("limit", "0"))

    def read(self, partition: _File) -> Iterator[tuple]:
        text = self.text(partition.path)
        kind = "map" if re.search(r"<(\w+:)?sitemapindex\b", text) else "page" if re.search(r"<(\w+:)?urlset\b", text) else None
        if kind is None:
            return
        for n, found in enumerate(re.finditer(r"<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc\s*>", text, re.S)):
            if self.most and n >= self.most:
                return
            if found[1]:
                yield os.path.basename(partition.path), kind, found[1]


class SitemapSource(DataSource):
    """(file, kind, loc) of landed sitemaps; option ``limit`` stops each file early."""

    @classmethod
    def name(cls) -> str:
        return "sitemaps"

    def schema(self) -> str:
        return "file string, kind string, loc string"

    def reader(self, schema) -> DataSourceReader:
        return _SitemapReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(SitemapSource)
