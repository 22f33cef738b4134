"""Pages of an archive by ranges: a data source whose input partitions are stretches of a file's pages.

So a file of many pages is many tasks, files of few pages share one, and a stream of the archive reads the
files that have arrived since its checkpoint. What opens files is passed in.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marginalia.functions.text import clean_page

#: A page as it is read: its place in the file from 0; a stretch that fails is one row with the error.
ROW = "path string, place int, text string, error string"
#: Files that a stream's driver opens at a time to count their pages.
OPENERS = 16
#: Bytes of whole files that one task reads, about, and files that one task counts.
PACK_BYTES, COUNTED = 1 << 24, 256


class PageReader(Protocol):
    """Opens files by their path in the shared file system."""

    def count(self, path: str) -> int:
        """The number of a file's pages, without reading them all if the format allows."""

    def read(self, path: str, first: int, last: int) -> list[str]:
        """The texts of the pages from first up to, not including, last, counted from 0."""


@dataclass
class Stretch(InputPartition):
    """Pages of one file, or why it could not be opened."""

    path: str
    first: int
    last: int
    error: str | None = None


@dataclass
class Pack(InputPartition):
    """Stretches that one task reads."""

    stretches: list[Stretch]


def listed(root: str, pattern: str) -> list[tuple[int, str, int]]:
    """Time of change in nanoseconds, path and bytes of the files below root whose names fit, in any folder, in that order."""
    fs, folder = pa.fs.FileSystem.from_uri(root)
    found = fs.get_file_info(pa.fs.FileSelector(folder, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


def _counted(reader: PageReader, path: str) -> tuple[int, str | None]:
    """The number of a file's pages, or why it could not be opened: one bad file must not end the run."""
    try:
        return reader.count(path), None
    except Exception as e:
        return 0, f"{type(e).__name__}: {e}"


def packed(files: list[tuple[str, int, int, str | None]], task_pages: int) -> list[Pack]:
    """Files (path, bytes, pages, error) as tasks: one for task_pages pages of a file of more, else one for whole files of PACK_BYTES."""
    packs, held, size = [], [], 0
    for path, length, n, error in files:
        if n > task_pages:
            packs += [Pack([Stretch(path, at, min(n, at + task_pages))]) for at in range(0, n, task_pages)]
        elif n or error:
            if held and size + length > PACK_BYTES:
                packs.append(Pack(held))
                held, size = [], 0
            held.append(Stretch(path, 0, n, error))
            size += length
    return [*packs, *([Pack(held)] if held else [])]


class _Pages:
    def __init__(self, reader: PageReader, options: dict):
        self.reader, self.root, self.pattern, self.task_pages = reader, options["root"], options["pattern"], int(options["task_pages"])

    def read(self, partition: Pack) -> Iterator[tuple]:
        for stretch in partition.stretches:
            yield from self.pages(stretch)

    def pages(self, stretch: Stretch) -> Iterator[tuple]:
        error = stretch.error
        if error is None:
            try:
                texts = self.reader.read(stretch.path, stretch.first, stretch.last)
                yield from ((stretch.path, place, text, None) for place, text in enumerate(texts, stretch.first))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        if error is not None:
            yield stretch.path, -1, None, error


class _Batch(_Pages, DataSourceReader):
    def __init__(self, reader: PageReader, options: dict, packs: list[Pack]):
        super().__init__(reader, options)
        self.packs = packs

    def __getstate__(self) -> dict:
        return self.__dict__ | {"packs": []}  # tasks need their own only

    def partitions(self) -> list[Pack]:
        return self.packs or [Pack([])]


class _Stream(_Pages, DataSourceStreamReader):
    """An offset is time of change and path of the last file that was read."""

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        changed, path, _ = max(listed(self.root, self.pattern), default=(-1, "", 0))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        at = lambda o: (o["changed"], o["path"])
        new = [f[1:] for f in listed(self.root, self.pattern) if at(start) < f[:2] <= at(end)]
        with ThreadPoolExecutor(OPENERS) as pool:
            counts = list(pool.map(lambda f: _counted(self.reader, f[0]), new))
        return packed([(*f, *c) for f, c in zip(new, counts, strict=True)], self.task_pages)


def _source(reader: PageReader, packs: list[Pack]) -> type[DataSource]:
    called = f"pages_{uuid.uuid4().hex[:8]}"

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return ROW

        def reader(self, schema) -> DataSourceReader:
            return _Batch(reader, self.options, packs)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
            return _Stream(reader, self.options)

    return Pages


def _planned(spark: SparkSession, root: str, reader: PageReader, pattern: str, task_pages: int) -> list[Pack]:
    """The tasks of a batch; pages are counted by Spark, a row a file."""
    files = [f[1:] for f in listed(root, pattern)]
    if not files:
        return []
    tasks = max(1, min(len(files), max(spark.sparkContext.defaultParallelism, len(files) // COUNTED)))
    counted = spark.sparkContext.parallelize(files, tasks).map(lambda f: (*f, *_counted(reader, f[0]))).collect()
    return packed(counted, task_pages)


def page_rows(spark: SparkSession, root: str, reader: PageReader, pattern: str = "*.pdf", task_pages: int = 64, stream: bool = False) -> DataFrame:
    """ROW of the files below root, a task for task_pages pages of a file; with stream, of those that arrive.

    A stream takes a file for new if it was changed after those it knows, so put files in place by a write or a
    move that sets their time. The driver lists the folder; tasks count the pages, or for a stream the driver does,
    OPENERS files at a time. What a batch reads is what was there when this was called.
    """
    source = _source(reader, [] if stream else _planned(spark, root, reader, pattern, task_pages))
    spark.dataSource.register(source)
    return (spark.readStream if stream else spark.read).format(source.name()).options(root=root, pattern=pattern, task_pages=str(task_pages)).load()


def cleaned(rows: DataFrame) -> DataFrame:
    """path, page_no, text, error of page_rows: pages are cleaned, empty ones left out, those that stay counted from 1.

    Of a file of which a stretch failed there is one row with the first error and no page, so that no file is
    taken for whole that is not.
    """
    x = rows.withColumn("text", F.when(F.col("error").isNull(), clean_page("text"))).filter("error IS NOT NULL OR text <> ''")
    by = Window.partitionBy("path")
    x = x.withColumns({"wrong": F.min("error").over(by), "page_no": F.row_number().over(by.orderBy(F.col("error").isNull(), "error", "place"))})
    x = x.filter("wrong IS NULL OR (error IS NOT NULL AND page_no = 1)")
    return x.select("path", F.when(F.col("wrong").isNull(), F.col("page_no")).alias("page_no"), "text", "error")
