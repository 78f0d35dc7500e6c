"""Paged feeds: caps of a poll, pages that land late, restarts; progress that could not be published."""

from datetime import datetime, timedelta, timezone

from conftest import rows
from lapwise.operators.jobs import progress_messages
from lapwise.sources import pages

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)
COMMENTS = "comment_id long, repository string, queue long, login string, issue_url string, body string, created_at timestamp, updated_at timestamp"

def _comments(spark, made):
    """(id, repository, minute) rows as comments."""
    full = [(i, name, 0, "user", "u", f"two\nlines of {i}", T0, T0 + timedelta(minutes=m)) for i, name, m in made]
    return spark.createDataFrame(full, COMMENTS)


def test_a_poll_sees_the_first_pages_from_its_start(spark):
    made = [(i, "o/a", i // 3) for i in range(50)] + [(100 + i, "o/b", 5) for i in range(4)]
    starts = spark.createDataFrame([("o/a", T0 + timedelta(minutes=2)), ("o/b", T0)], "repository string, since timestamp")
    found = pages.polled_pages(_comments(spark, made), starts, page_size=5, pages=3)
    expected = [("o/a", i, (i - 6) // 5) for i in range(6, 21)] + [("o/b", 100 + i, 0) for i in range(4)]
    assert rows(found, "repository", "comment_id", "page") == sorted(expected, key=lambda r: [(v is not None, str(v)) for v in r])


class _Run:
    """A stream over a landing folder that can be stopped and started again."""

    def __init__(self, spark, tmp_path):
        self.spark, self.landing, self.path = spark, f"{tmp_path}/landing", tmp_path

    def land(self, made):
        rows = self.spark.createDataFrame([(i, p) for i, _, p in made], "comment_id long, page long")
        pages.land_pages(_comments(self.spark, [(i, name, 0) for i, name, _ in made]).join(rows, "comment_id"), self.landing)

    def read(self):
        """All comments that the stream has read so far, as a list: one read twice is there twice."""
        stream = pages.page_stream(self.spark, self.landing).select("comment_id", "repository", "page", "body", "login", "updated_at")
        sink = stream.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(f"{self.path}/out").collect()


def test_every_page_is_read_once(spark, tmp_path):
    run = _Run(spark, tmp_path)
    run.land([(1, "o/a", 0), (2, "o/a", 0), (3, "o/a", 1), (5, "o/a", 3), (10, "o/b x%", 0)])
    first = run.read()
    assert sorted(r["comment_id"] for r in first) == [1, 2, 3, 10]  # page 3 waits for page 2
    assert {(r["repository"], r["body"], r["login"], r["updated_at"].astimezone(timezone.utc)) for r in first if r["comment_id"] == 10} == {
        ("o/b x%", "two\nlines of 10", "user", T0)
    }
    assert len(run.read()) == 4  # nothing new
    run.land([(4, "o/a", 2), (11, "o/b x%", 1), (20, "o/c", 1)])
    assert sorted(r["comment_id"] for r in run.read()) == [1, 2, 3, 4, 5, 10, 11]
    run.land([(19, "o/c", 0)])
    assert sorted((r["comment_id"], r["page"]) for r in run.read())[-2:] == [(19, 0), (20, 1)]


def test_offsets_are_split_into_tasks_of_bounded_size(tmp_path):
    reader = pages._PageReader(str(tmp_path))
    parts = reader.partitions({"repository=a": 5}, {"repository=a": 48, "repository=b": 1})
    assert [(p.folder, p.first, p.end) for p in parts] == [
        ("repository=a", 5, 25), ("repository=a", 25, 45), ("repository=a", 45, 48), ("repository=b", 0, 1)
    ]
    assert reader.latestOffset() == {}


def test_consecutive_pages_share_a_file(spark, tmp_path):
    run = _Run(spark, tmp_path)
    made = [(i, "o/a", i) for i in range(250) if i not in (0, 120)] + [(1_000 + i, "o/b", i) for i in range(3)]
    run.land(made)
    folders = sorted(f.relative_to(run.landing).as_posix() for f in tmp_path.glob("landing/*/*"))
    assert folders == [f"repository=o%2Fa/pages={p}" for p in ("1-99", "100-119", "121-199", "200-249")] + ["repository=o%2Fb/pages=0-2"]
    assert len(list(tmp_path.glob("landing/*/*/part-*"))) == 5
    assert sorted(r["comment_id"] for r in run.read()) == [1_000, 1_001, 1_002]  # page 0 is not there
    run.land([(0, "o/a", 0)])
    assert sorted(r["comment_id"] for r in run.read()) == [*range(120), 1_000, 1_001, 1_002]
    run.land([(120, "o/a", 120)])
    assert sorted((r["comment_id"], r["page"]) for r in run.read()) == [(i, i) for i in range(250)] + [(1_000 + i, i) for i in range(3)]


def test_many_pages_are_read_by_tasks_of_whole_folders(tmp_path):
    reader = pages._PageReader(str(tmp_path))
    parts = [(p.folder, p.first, p.end) for p in reader.partitions({"repository=a": 130}, {"repository=a": 30_000, "repository=b": 1})]
    assert parts[:2] == [("repository=a", 130, 300), ("repository=a", 300, 500)] and parts[-1] == ("repository=b", 0, 1)
    assert [(name, first) for name, first, _ in parts[1:-1]] == [(name, end) for name, _, end in parts[:-2]]
    assert parts[-2][2] == 30_000 and len(parts) == 151
    assert max(p.end - p.first for p in reader.partitions({}, {"repository=a": 1_000_000})) == 1_000


def test_failed_publications_stop_no_job(spark):
    made = [
        (1, 1, 0, "queued", None, None), (1, 2, 1, "claim", None, None), (1, 3, 2, "progress", 1, True), (1, 4, 3, "progress", 2, False),
        (1, 5, 4, "completed", None, None),
        (2, 6, 0, "queued", None, None), (2, 7, 1, "progress", 4, False), (2, 8, 2, "progress", 4, True), (3, 9, 0, "claim", None, None),
    ]
    events = [(j, e, T0 + timedelta(minutes=m), kind, step, 8, step and f"m{e}", ok) for j, e, m, kind, step, ok in made]
    schema = "job_id long, event_id long, event_ts timestamp, event string, step long, total long, message string, published boolean"
    found = progress_messages(spark.createDataFrame(events, schema))
    columns = ("job_id", "step", "message", "published", "shown_step", "failed_publications", "status")
    assert rows(found, *columns) == [
        (1, 2, "m4", False, 1, 1, "completed"), (2, 4, "m8", True, 4, 1, "pending"), (3, None, None, None, None, 0, "running")
    ]
    assert progress_messages(spark.createDataFrame([], schema)).count() == 0
