"""State of streaming jobs: batch logs, current tables and seen ids.

A batch that is run again after a failure sees the same state and leaves the
same result: it reads only what earlier batches left, and replaces what it wrote
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapwise.session import remove_folder
from lapwise.sources.commits import CommitConflict, Commits

# Batches after which the bitmaps of the seen ids are merged.
COMPACT_EVERY = 16
_BITMAPS = "bucket bigint, bitmap binary"


class Writer:
    """A processor that writes the tables of a state, batch by batch.

    Each processor takes the next epoch; an older one fails at its next batch.
    What a batch writes lies in folders of its epoch and counts once the batch is
    committed, which one epoch can do, so neither a crash between two tables nor
    a second processor leaves a mixture.
    """

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")
        self.epochs, self.commits = Commits(spark, f"{self.state}/epochs"), Commits(spark, f"{self.state}/commits")
        self.epoch = self._next_epoch()

    def _next_epoch(self) -> int:
        while True:
            last = self.epochs.latest()
            epoch = last[0] + 1 if last else 0
            try:
                self.epochs.commit(epoch, {"epoch": epoch})
                return epoch
            except CommitConflict:
                continue

    def begin(self, batch: int) -> bool:
        """Whether the batch is still to be done; an error for a processor that another has followed."""
        if self.epochs.latest()[0] != self.epoch:
            raise CommitConflict(f"Another processor writes {self.state}")
        last = self.commits.latest()
        if last and batch < last[0]:
            raise CommitConflict(f"{self.state} is ahead of this checkpoint: batch {last[0]} is committed")
        return last is None or batch > last[0]

    def commit(self, batch: int) -> None:
        self.commits.commit(batch, {"batch": batch, "epoch": self.epoch})

    def epoch_of(self, batch: int) -> int:
        return self.commits.read(batch)["epoch"]

    def committed(self) -> DataFrame:
        """``batch`` and ``epoch`` of all commits."""
        schema = "batch bigint, epoch bigint"
        if not self.commits.numbers():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.commits.path)


def _folder_of(path: str, batch: int, epoch: int | None) -> str:
    return f"{path}/batch={batch}" if epoch is None else f"{path}/batch={batch}/epoch={epoch}"


class BatchLog:
    """A growing table with one folder per micro-batch; writing a batch replaces its folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, writer: Writer | None = None):
        self.spark, self.path, self.schema, self.writer = spark, path.rstrip("/"), schema, writer
        self._created = False

    def _folder(self, batch: int) -> str:
        return _folder_of(self.path, batch, self.writer and self.writer.epoch)

    def _create(self) -> None:
        # An empty first folder lets the log be read before the first batch.
        if not self._created:
            empty = self.spark.createDataFrame([], self.schema)
            empty.write.mode("overwrite").parquet(self._folder(-1))
            self._created = True

    def write(self, rows: DataFrame, batch: int) -> None:
        self._create()
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).write.mode("overwrite").parquet(self._folder(batch))

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all batches (of a writer: of those committed)."""
        self._create()
        places = [T.StructField("batch", T.LongType())]
        if self.writer:
            places.append(T.StructField("epoch", T.LongType()))
        schema = T.StructType([*self.schema.fields, *places])
        log = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        if self.writer:
            log = log.join(self.writer.committed(), ["batch", "epoch"], "left_semi").select(*self.schema.names, "batch")
        return log if before is None else log.where(F.col("batch") < before)

    def read_batch(self, batch: int) -> DataFrame:
        """The rows of one batch; no other folder is looked at."""
        return self.spark.read.schema(self.schema).parquet(self._folder(batch))


class CurrentTable:
    """A table that every batch replaces as a whole; the last two versions are kept.

    What a batch reads is the version of the batch before, so its cost follows
    the current rows and not the history.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, writer: Writer | None = None):
        self.spark, self.path, self.schema, self.writer = spark, path.rstrip("/"), schema, writer

    def read(self, batch: int) -> DataFrame:
        """The table as the batch before left it; empty for the first one."""
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        epoch = self.writer and self.writer.epoch_of(batch - 1)
        return self.spark.read.schema(self.schema).parquet(_folder_of(self.path, batch - 1, epoch))

    def write(self, rows: DataFrame, batch: int) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        folder = _folder_of(self.path, batch, self.writer and self.writer.epoch)
        rows.select(*columns).write.mode("overwrite").parquet(folder)
        remove_folder(self.spark, _folder_of(self.path, batch - 2, None))


class SeenIds:
    """All ids that earlier batches have seen, as bitmaps of 32,768 neighbouring ids.

    A batch adds a delta with its own ids; every ``compact_every`` batches the
    bitmaps are merged into a base, and what it replaces goes with the next
    base.  All are folders of one table, so a batch opens a base and a bounded
    number of deltas however many batches there were, and of those the rows
    whose ranges lie between its own.
    """

    def __init__(self, spark: SparkSession, path: str, writer: Writer | None = None, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.writer, self.compact_every = spark, path.rstrip("/"), writer, compact_every
        self._created = False

    def _folder(self, kind: str, batch: int) -> str:
        return _folder_of(f"{self.path}/kind={kind}", batch, self.writer and self.writer.epoch)

    def _create(self) -> None:
        if not self._created:
            self.spark.createDataFrame([], _BITMAPS).write.mode("overwrite").parquet(self._folder("delta", -1))
            self._created = True

    def _before(self, batch: int) -> DataFrame:
        """The bitmaps (``bucket``, ``bitmap``) that the batches before have left; a bucket may have several."""
        self._create()
        base = batch // self.compact_every * self.compact_every - 1
        places = "kind string, batch bigint" + (", epoch bigint" if self.writer else "")
        table = self.spark.read.schema(f"{_BITMAPS}, {places}").option("basePath", self.path).parquet(self.path)
        current = (F.col("kind") == "base") & (F.col("batch") == base)
        since = (F.col("kind") == "delta") & (F.col("batch") > base) & (F.col("batch") < batch)
        table = table.where(current | since)
        if self.writer:
            table = table.join(self.writer.committed(), ["batch", "epoch"], "left_semi")
        return table.select("bucket", "bitmap")

    def unseen(self, rows: DataFrame, batch: int, column: str = "comment_id") -> DataFrame:
        """The rows whose id no earlier batch has seen."""
        bucket, position = F.bitmap_bucket_number(column), F.bitmap_bit_position(column)
        reach = rows.agg(F.min(bucket).alias("low"), F.max(bucket).alias("high")).first()
        if reach["low"] is None:
            return rows
        known = self._before(batch).where(F.col("bucket").between(reach["low"], reach["high"]))
        placed = rows.select("*", bucket.alias("_bucket"), position.alias("_position"))
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("_position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        is_set = byte.bitwiseAND(F.pow(F.lit(2.0), F.col("_position") % 8).cast("bigint")) != 0
        same = (F.col("_bucket") == F.col("bucket")) & is_set
        return placed.join(known, same, "left_anti").drop("_bucket", "_position")

    def write(self, ids: DataFrame, batch: int, column: str = "comment_id") -> None:
        self._create()
        own = ids.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(column).alias("bucket"))
        own.agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bitmap")).write.mode("overwrite").parquet(
            self._folder("delta", batch)
        )
        if (batch + 1) % self.compact_every == 0:
            self._compact(batch)

    def _compact(self, batch: int) -> None:
        """One bitmap per bucket; a batch run again finds all that it read the first time."""
        own = self.spark.read.schema(_BITMAPS).parquet(self._folder("delta", batch))
        merged = self._before(batch).unionByName(own).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        ranged = merged.repartitionByRange("bucket").sortWithinPartitions("bucket")
        ranged.write.mode("overwrite").parquet(self._folder("base", batch))
        last = batch - self.compact_every
        remove_folder(self.spark, f"{self.path}/kind=base/batch={last - self.compact_every}")
        for old in range(last - self.compact_every + 1, last + 1):
            remove_folder(self.spark, f"{self.path}/kind=delta/batch={old}")


def latest_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest logged row per key; a struct maximum combines map-side."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    newest = F.max(F.struct("batch", *values)).alias("newest")
    return log.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"newest.{v}").alias(v) for v in values])
