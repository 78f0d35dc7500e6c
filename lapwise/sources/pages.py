"""Numbered pages of a comment feed, and a streaming source that reads them.

A poll of a repository sees at most ``POLL_PAGES`` pages of ``PAGE_SIZE`` comments, in
the order of their updates.  Pages are landed in folders ``repository=NAME/pages=FIRST-LAST``
of consecutive pages, at most ``PAGES_PER_FILE``, so there are far fewer files than pages.
A line is the number of its page, a tab and a JSON document.  The source ``comment_pages``
reads every page once: its offset is the next page of every repository.  A page counts once
all pages before it are there, so one that lands late is waited for and never passed over,
and a batch that is run again reads the same pages.  Repositories are read apart; a slow
one does not hold up the others.

Offsets and the folders of a task are found by listing names; pages are read in the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lapwise.operators.numbering import number_rows
from lapwise.sources.feed import COMMENT_DOCUMENT, comment_documents, comments_of, comments_since

PAGE_SIZE = 100
POLL_PAGES = 100
# Folders of consecutive pages end at multiples of this number of pages.
PAGES_PER_FILE = 100
# Pages that a task reads. Above 200 tasks these are whole folders, file after file, as starting a task takes longer than
# reading 20 pages.
PAGES_PER_TASK, MOST_PER_TASK = 20, 1_000
SMALL_TASKS = 200
_LINES = pa.schema([("repository", pa.string()), ("page", pa.int64()), ("document", pa.string())])
_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def feed_pages(comments: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Comments with their ``page``, from 0 on in each repository."""
    numbered = number_rows(
        comments, keys=["repository"], slices=[F.date_trunc("minute", "updated_at")], order=["updated_at", "comment_id"],
        name="_number", start=0,
    )
    return numbered.withColumn("page", F.floor(F.col("_number") / page_size)).drop("_number")


def polled_pages(comments: DataFrame, starts: DataFrame, page_size: int = PAGE_SIZE, pages: int = POLL_PAGES) -> DataFrame:
    """What one poll of each repository sees from its start (``repository, since``) on."""
    return feed_pages(comments_since(comments, starts), page_size).where(F.col("page") < pages)


def land_pages(paged: DataFrame, landing: str) -> None:
    """Write comments with a ``page``, consecutive pages as one file.

    Every file costs the store and the committing driver some calls, so a file per page would
    take longer than the comments themselves.
    """
    near = ["repository", "_range"]
    place = F.dense_rank().over(Window.partitionBy(*near).orderBy("page"))
    run = Window.partitionBy(*near, "_run")
    ranged = comment_documents(paged, "page").withColumn("_range", F.floor(F.col("page") / PAGES_PER_FILE))
    named = ranged.withColumn("_run", F.col("page") - place).withColumn(
        "pages", F.concat_ws("-", F.min("page").over(run), F.max("page").over(run))
    )
    document = F.to_json(F.struct(*[f.name for f in COMMENT_DOCUMENT]), _STAMP)
    lines = named.select("repository", "pages", F.concat_ws("\t", "page", document).alias("value"))
    lines.write.mode("append").partitionBy("repository", "pages").text(landing)


def page_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Landed pages as a stream of comments with their ``page``."""
    spark.dataSource.register(CommentPages)
    lines = spark.readStream.format(CommentPages.name()).option("path", landing).load()
    document = F.from_json("document", COMMENT_DOCUMENT, _STAMP)
    return comments_of(lines.select(F.inline(F.array(document)), "page"), "page")


class CommentPages(DataSource):
    """Lines of landed pages; the option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "comment_pages"

    def schema(self) -> str:
        return "repository string, page bigint, document string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageReader(self.options["path"])


class _Pages(InputPartition):
    """Pages of one repository's folder, ``first`` to ``end - 1``, and the files that hold some of them."""

    def __init__(self, folder: str, first: int, end: int, files: list[str]):
        self.folder, self.first, self.end, self.files = folder, first, end, files


def _children(root: str, folder: str = "", recursive: bool = False) -> list[pafs.FileInfo]:
    """What lies in a folder below a root; only the root is a URI, folder names may have its signs."""
    store, inner = pafs.FileSystem.from_uri(root)
    selector = pafs.FileSelector(f"{inner}/{folder}" if folder else inner, allow_not_found=True, recursive=recursive)
    return store.get_file_info(selector)


def _is_data(info: pafs.FileInfo) -> bool:
    return info.is_file and not info.base_name.startswith(("_", "."))


def _pages_per_task(pages: int) -> int:
    if pages <= SMALL_TASKS * PAGES_PER_TASK:
        return PAGES_PER_TASK
    return min(-(-pages // (SMALL_TASKS * PAGES_PER_FILE)) * PAGES_PER_FILE, MOST_PER_TASK)


def _task_ranges(first: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Pages ``first`` to ``end - 1`` by task; tasks of whole folders end where folders do."""
    while first < end:
        stop = first + size - (first % PAGES_PER_FILE if size >= PAGES_PER_FILE else 0)
        yield first, min(stop, end)
        first = stop


class _PageReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The first page of each repository that is not there yet."""
        for folder in _children(self.path):
            if folder.base_name.startswith("repository="):
                name = folder.base_name
                self.ends[name] = self._end(name, self.ends.get(name, 0))
        return {name: end for name, end in sorted(self.ends.items()) if end}

    def _files(self, name: str) -> list[tuple[int, int, str]]:
        """First page, last page and path of a repository's files, in order."""
        found = []
        for info in _children(self.path, name, recursive=True):
            pages = re.search(r"/pages=([0-9]+)-([0-9]+)/[^/]+\Z", info.path)
            if pages and _is_data(info):
                found.append((int(pages[1]), int(pages[2]), info.path))
        return sorted(found)

    def _end(self, name: str, known: int) -> int:
        for first, last, _ in self._files(name):
            if first <= known:
                known = max(known, last + 1)
        return known

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        size = _pages_per_task(sum(last - start.get(name, 0) for name, last in end.items()))
        tasks = []
        for name, last in end.items():
            files: dict[int, list[tuple[int, int, str]]] = {}
            for file in self._files(name) if start.get(name, 0) < last else ():
                files.setdefault(file[0] // PAGES_PER_FILE, []).append(file)
            for first, stop in _task_ranges(start.get(name, 0), last, size):
                near = [f for n in range(first // PAGES_PER_FILE, (stop - 1) // PAGES_PER_FILE + 1) for f in files.get(n, ())]
                tasks.append(_Pages(name, first, stop, [path for low, high, path in near if low < stop and high >= first]))
        return tasks

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        repository = unquote(partition.folder.partition("=")[2])
        store, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.files:
            with store.open_input_stream(path) as file:
                lines = [x.partition("\t") for x in file.read().decode("utf-8").split("\n") if x]
            kept = [(int(page), line) for page, _, line in lines if partition.first <= int(page) < partition.end]
            columns = [repository] * len(kept), [page for page, _ in kept], [line for _, line in kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES)], schema=_LINES)
