"""Numbered commits: of several writers one wins each number, and readers see whole versions only.

A commit is a small file that names what belongs to a version.  What it names is
written before, into folders that no other writer uses, so a crash in between
leaves the last version as it was.  The file appears whole and only if its number
is free: by a hard link on a local file system, and by a rename that does not
replace elsewhere.  A store whose renames are not atomic needs a lock of its own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lapwise.session import folder_exists, hadoop_path, remove_folder


class CommitConflict(RuntimeError):
    """Another writer has taken the number."""


class Commits:
    """The commits of one folder, numbered from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:020d}.json"

    def numbers(self) -> list[int]:
        """All committed numbers in ascending order."""
        if not folder_exists(self.spark, self.path):
            return []
        folder, store = hadoop_path(self.spark, self.path)
        names = [status.getPath().getName() for status in store.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def read(self, number: int) -> dict | None:
        """What a commit says; None if there is none of that number."""
        if not folder_exists(self.spark, self._file(number)):
            return None
        file, store = hadoop_path(self.spark, self._file(number))
        stream = store.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        """The last commit and its number."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def commit(self, number: int, record: Mapping) -> None:
        """Take a number with a record; a conflict if it is taken already."""
        written = f"{self.path}/.{uuid.uuid4().hex}.tmp"
        file, store = hadoop_path(self.spark, written)
        stream = store.create(file, True)
        try:
            stream.write(bytearray(json.dumps(dict(record)).encode()))
        finally:
            stream.close()
        try:
            self._appear(written, self._file(number))
        finally:
            remove_folder(self.spark, written)

    def _appear(self, written: str, final: str) -> None:
        source, store = hadoop_path(self.spark, written)
        target, _ = hadoop_path(self.spark, final)
        if store.getUri().getScheme() == "file":
            try:
                os.link(source.toUri().getPath(), target.toUri().getPath())
            except FileExistsError as taken:
                raise CommitConflict(final) from taken
            return
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, none)
        except Py4JJavaError as refused:
            if folder_exists(self.spark, final):
                raise CommitConflict(final) from refused
            raise

    def forget(self, before: int) -> None:
        """Remove the commits below a number."""
        for number in self.numbers():
            if number < before:
                remove_folder(self.spark, self._file(number))
