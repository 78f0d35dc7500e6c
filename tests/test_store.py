"""Stored results, manifests, catalogues, corpora and plans."""

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from lapwise.functions import names
from lapwise.operators import catalog
from lapwise.plans.compare import compare_stored
from lapwise.plans.settings import apply_settings, setting_statements
from lapwise.sources.commits import CommitConflict
from lapwise.sources import corpus, feed, results, sinks
from lapwise.sources.registry import REGISTRY
from lapwise.sources.tables import differing_files, scan_typed, schema_conformance, typed
from test_statistics import iterations, pairs


def manifest(spark, *entries):
    return spark.createDataFrame(
        [("tpch/sf1", engine, stored, p + 1, id) for engine, stored, ids in entries for p, id in enumerate(ids)],
        "dataset string, engine string, stored_at bigint, position bigint, id string",
    )


def test_stale_documents_are_ignored(spark):
    stored = iterations(spark, ("base", "q1", 10, 1), ("head", "q1", 20, 1), ("base", "q2", 10, 1), ("head", "q2", 5, 1))
    listed = manifest(spark, ("base", 1, ["q1"]), ("head", 2, ["q1"]))
    assert rows(compare_stored(stored, listed, pairs(spark)).queries, "id", "new_p50") == [("q1", 20)]


def test_missing_and_different_sets_are_errors(spark):
    stored = iterations(spark, ("base", "q1", 10, 1), ("head", "q2", 20, 1))
    with pytest.raises(ValueError, match="Stored query sets differ"):
        compare_stored(stored, manifest(spark), pairs(spark))
    with pytest.raises(ValueError, match="no document is stored.*q9"):
        results.load_results(stored, manifest(spark, ("base", 1, ["q1", "q9"])))


def test_listing_with_and_without_manifest(spark):
    stored = iterations(spark, ("a", "q10", 1, 1), ("a", "q2", 1, 1), ("b", "custom", 1, 1), ("b", "q1", 1, 1))
    listed = manifest(spark, ("b", 1, ["custom", "q1"]))
    found = rows(results.run_listing(stored, listed), "engine", "position", "id", "missing")
    assert found == [("a", 1, "q2", False), ("a", 2, "q10", False), ("b", 1, "custom", False), ("b", 2, "q1", False)]


def test_last_stored_run_is_the_previous_one(spark):
    listed = manifest(spark, ("new", 5, ["q1"]), ("old", 9, ["q1"]))
    assert rows(results.previous_runs(listed), "engine") == [("old",)]


def write(path, document):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(document if isinstance(document, str) else json.dumps(document, indent=2))


def document(**changes):
    first = {"rowCount": 3, "elapsed": 1.5, "plan": "p", "tasks": 4, "statsQErrorP50": 1.25, "other": 1}
    second = {"rowCount": 0, "elapsed": 0, "plan": "", "error": "lost"}
    return {"dataset": "tpch/sf1", "engine": "base", "id": "q1", "iterations": [first, second], **changes}


def test_result_files(spark, tmp_path):
    path = f"{tmp_path}/tpch/sf1/results/base/q1.json"
    write(path, document())
    found = results.read_result_files(spark, path)
    assert rows(found, "iteration", "elapsed", "tasks", "error", "stats_q_error_p50") == [
        (0, 1.5, 4, None, 1.25), (1, 0.0, 0, "lost", None)
    ]
    for name, changed in (
        ("q2", document()), ("q3", "{broken"), ("q4", document(id="q4", iterations=[{"elapsed": 1, "plan": ""}])),
    ):
        bad = f"{tmp_path}/tpch/sf1/results/base/{name}.json"
        write(bad, changed)
        with pytest.raises((PySparkException, Py4JJavaError)):
            results.read_result_files(spark, bad).collect()


def test_results_round_trip_and_replace_only_their_query(spark, tmp_path):
    path = f"{tmp_path}/results"
    results.write_results(iterations(spark, ("a", "q1", 1.25, 1), ("b", "q1", 2, 2, "x")), path)
    results.write_results(iterations(spark, ("a", "q1", 7, 1), ("a", "q2", 3, 1)), path)
    results.write_results(iterations(spark, ("a", "q2", 4, 1)), path)
    found = rows(results.read_results(spark, path), "engine", "id", "elapsed", "error")
    assert found == [("a", "q1", 7.0, None), ("a", "q2", 4.0, None), ("b", "q1", 2.0, "x")]


def test_long_documents_continue_in_parts(spark, monkeypatch):
    monkeypatch.setattr(results, "DOCUMENT_ROWS", 3)
    data = iterations(spark, *[("a", "q1", i, i) for i in range(8)])
    documents = results.result_documents(data)
    assert sorted(r["part"] for r in documents.collect()) == [0, 1, 2]
    back = results.documents_to_iterations(documents)
    assert rows(back, "iteration", "elapsed") == [(i, float(i)) for i in range(8)]


def manifest_text(**changes):
    return json.dumps({"version": 1, "startTime": 123, "dataset": "d/v", "engine": "e", "queryIds": ["q1", "custom"], **changes})


def test_manifest_round_trip(spark, tmp_path):
    write(f"{tmp_path}/m/one.json", manifest_text())
    entries = results.read_manifests(spark, f"{tmp_path}/m")
    assert rows(entries, "position", "id", "start_time") == [(1, "q1", 123), (2, "custom", 123)]
    back = results.manifest_documents(entries).select(F.to_json(F.struct("*"))).head()[0]
    assert json.loads(back)["queryIds"] == ["q1", "custom"]


@pytest.mark.parametrize(
    "changes",
    [{"version": 2}, {"startTime": -1}, {"extra": 1}, {"queryIds": ["q1", "q1"]}, {"queryIds": ["../q1"]},
     {"queryIds": [".."]}, {"queryIds": [""]}, {"engine": None}],
)
def test_bad_manifests_are_errors(spark, tmp_path, changes):
    write(f"{tmp_path}/m/one.json", manifest_text(**changes))
    with pytest.raises(PySparkException):
        results.read_manifests(spark, f"{tmp_path}/m").collect()


def listing(spark, *paths):
    return spark.createDataFrame([(r, p, 1) for r, p in paths], "root_idx bigint, path string, size bigint").withColumn(
        "modified_at", F.lit("2024-01-01").cast("timestamp")
    )


def test_earlier_root_provides_a_dataset(spark):
    files = listing(
        spark, (1, "tpch/queries/q1.sql"), (1, "tpch/sf1/t/a.parquet"), (0, "tpch/sf1/t/a.parquet"),
        (0, "tpch/queries/q1.sql"), (1, "tpch/sf10/t/a.parquet"), (0, "adhoc/sf1/t/a.parquet"), (0, "tpch/readme"),
    )
    assert rows(catalog.discover_datasets(files)) == [("tpch/sf1", 0), ("tpch/sf10", 1)]


def test_tables_hold_parquet_only(spark):
    files = listing(
        spark, (0, "s/v/good/a.parquet"), (0, "s/v/good/_SUCCESS"), (0, "s/v/mixed/a.parquet"), (0, "s/v/mixed/b.csv"),
        (0, "s/v/nested/x/a.parquet"), (0, "s/v/placeholder/.layout.parquet"), (0, "s/v/file.parquet"),
    )
    found = catalog.table_catalog(files, "bucket/")
    assert rows(found, "schema", "name", "path") == [
        ("s_v", "good", "s3://bucket/s/v/good/"), ("s_v", "placeholder", "s3://bucket/s/v/placeholder/")
    ]


def test_layout_errors(spark):
    files = listing(spark, (0, "d/v/customer/a"), (0, "d/v/orders/a"), (0, "d/w/bad name/a"))
    assert rows(catalog.checked_layout(spark, files, ["d/v"]), "name") == [("customer",), ("orders",)]
    for dataset in ("d/w", "d/x"):
        with pytest.raises(PySparkException):
            catalog.checked_layout(spark, files, [dataset]).collect()


def test_requested_names(spark):
    requested = spark.createDataFrame(
        list(enumerate(["tpcds/sf10", "tpch/sf1", "tpcds/sf10", "x/y"])), "pos bigint, dataset string"
    )
    available = spark.createDataFrame([("tpch/sf1",), ("tpcds/sf10",)], "dataset string")
    chosen = catalog.select_requested(available, requested).orderBy("pos")
    assert [r["dataset"] for r in chosen.collect()] == ["tpcds/sf10", "tpch/sf1"]
    assert rows(catalog.unknown_names(available, requested)) == [("x/y",)]


def test_deletion_needs_confirmation_and_valid_names(spark):
    files = listing(spark, (0, "d/v/t/a.parquet"), (0, "d/w/t/a.parquet"))
    with pytest.raises(ValueError, match="Confirm"):
        sinks.confirmed_drop_plan(spark, files, ["d/v"], confirm=False)
    with pytest.raises(PySparkException):
        sinks.confirmed_drop_plan(spark, files, ["../.."], confirm=True).collect()
    assert rows(sinks.confirmed_drop_plan(spark, files, ["d/v", "d/v"], confirm=True), "path") == [("d/v/t/a.parquet",)]


def test_empty_query_list_is_an_error(spark):
    df = spark.createDataFrame([(" , ",)], "request string")
    with pytest.raises(PySparkException, match="at least one query ID"):
        df.select(catalog.split_ids(F.col("request"))).collect()


def test_dataset_validators(spark):
    df = spark.createDataFrame([(d,) for d in ("tpch/sf1", "../..", "./sf1", "tpch/..", "tpch/.", "./.", "a/b/c", "tpch/sf1\n")], "d string")
    found = {r["d"]: (r["strict"], r["safe"]) for r in df.select(
        "d", names.is_dataset(F.col("d")).alias("strict"), names.is_below_root(F.col("d")).alias("safe")).collect()}
    assert found["tpch/sf1"] == (True, True)
    assert found["./sf1"] == (False, True) and found["tpch/."] == (False, True)
    assert all(found[d] == (False, False) for d in ("../..", "tpch/..", "./.", "a/b/c", "tpch/sf1\n"))


def test_run_labels(spark):
    df = spark.createDataFrame([("a/b/topic", "x" * 40), (None, "0123456789abcdef"), ("main", None)], "b string, c string")
    found = df.select(names.run_label(F.col("b"), F.col("c")).alias("l"))
    assert [r["l"] for r in found.collect()] == ["topic", "0123456789ab", "main"]
    neither = spark.createDataFrame([("", "")], "b string, c string").select(names.run_label(F.col("b"), F.col("c")))
    with pytest.raises(PySparkException, match="neither branch nor commit"):
        neither.collect()


def test_settings(spark):
    row = spark.range(1)
    line = lambda **o: row.select(setting_statements({k: F.lit(v) for k, v in o.items()}).alias("s")).head()["s"]
    assert line() == ""
    assert line(max_tasks_per_stage=0, dynamic_task_count=False, compression="zstd").split("\n") == [
        "SET compression=zstd;", "SET dynamic_task_count=false;", "SET max_tasks_per_stage=0;"
    ]
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    report = apply_settings(spark, {"broadcast_joins": False, "partial_reduce": True, "compression": "lz4"})
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert report == {"compression": "static", "broadcast_joins": "spark.sql.autoBroadcastJoinThreshold=-1", "partial_reduce": "unsupported"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    with pytest.raises(ValueError):
        apply_settings(spark, {"no_such": 1})


def test_corpus_files(spark, tmp_path):
    for id in ("q10", "q2", "custom"):
        write(f"{tmp_path}/s/queries/{id}.sql", f"select '{id}'\n;")
    write(f"{tmp_path}/s/queries/notes.txt", "no")
    assert corpus.corpus_queries(spark, f"{tmp_path}/s/queries") == [
        (id, f"select '{id}'\n;") for id in ("q2", "q10", "custom")
    ]
    os.makedirs(f"{tmp_path}/empty")
    with pytest.raises(ValueError):
        corpus.corpus_queries(spark, f"{tmp_path}/empty")


def test_allow_lists(spark, tmp_path):
    write(f"{tmp_path}/logins.txt", "first-user\n\n Second-user \r\n")
    assert rows(feed.read_allow_list(spark, f"{tmp_path}/logins.txt")) == [("first-user",), ("second-user",)]
    comma = spark.createDataFrame([("A, b ,,",)], "value string")
    assert rows(feed.allow_list_from_text(comma)) == [("a",), ("b",)]
    with pytest.raises(PySparkException):
        feed.allow_list_from_text(spark.createDataFrame([("-bad",)], "value string")).collect()


def test_registry(spark, sf_dir):
    assert len(REGISTRY.columns("clickbench", "hits")) == 105
    assert sum(len(REGISTRY.columns("tpch", t)) for t in REGISTRY.tables("tpch")) == 61
    with pytest.raises(ValueError, match="not registered"):
        scan_typed(spark, f"{sf_dir}/events.parquet", "tpch", "events")
    extended = REGISTRY.with_suite("lab", "runs: id bigint, took decimal(5,1)")
    assert [f.dataType.simpleString() for f in typed(spark.range(1), "lab", "runs", extended).schema] == ["bigint", "decimal(5,1)"]


def test_suites_from_a_file_report_missing_columns(spark, tmp_path):
    write(f"{tmp_path}/tpcds.txt", "store: s_store_sk integer, s_store_id varchar(16),\n  s_gmt_offset decimal(3,2)\nreason: r_reason_sk integer\n")
    registry = REGISTRY.with_suite_file(spark, "tpcds", f"{tmp_path}/tpcds.txt")
    assert registry.tables("tpcds") == ["store", "reason"]
    store = spark.createDataFrame([(1, 5.25, "x")], "s_store_sk int, s_gmt_offset double, extra string")
    found = schema_conformance(spark, "tpcds", {"store": store}, registry)
    assert rows(found, "table_name", "column_name", "outcome") == sorted([
        ("store", "s_store_sk", "match"), ("store", "s_store_id", "missing"), ("store", "s_gmt_offset", "type_differs"),
        ("store", "extra", "extra"), ("reason", "r_reason_sk", "missing"),
    ])


def test_checks_stay_whatever_is_read(spark, tmp_path):
    """A check is no column that a narrow read or a count could drop."""
    write(f"{tmp_path}/m/one.json", manifest_text(version=2))
    bad = results.read_manifests(spark, f"{tmp_path}/m")
    path = f"{tmp_path}/tpch/sf1/results/base/q2.json"
    write(path, document())
    files = results.read_result_files(spark, path)
    write(f"{tmp_path}/tpch/sf1/results/base/q1.json", document(iterations=[{"elapsed": 1, "rowCount": 1}]))
    plans = results.read_result_files(spark, f"{tmp_path}/tpch/sf1/results/base/q1.json")
    layout = catalog.checked_layout(spark, listing(spark, (0, "d/w/bad name/a")), ["d/w"])
    for df, narrow in ((bad, "id"), (files, "elapsed"), (plans, "iteration"), (layout, "dataset")):
        for action in (lambda: df.collect(), lambda: df.select(narrow).collect(), lambda: df.count()):
            with pytest.raises((PySparkException, Py4JJavaError)):
                action()


def test_ids_repeat_in_no_part_of_a_manifest(spark, monkeypatch):
    monkeypatch.setattr(results, "DOCUMENT_ROWS", 3)
    entries = lambda ids: spark.createDataFrame(
        [("d/v", "e", 1, p + 1, i) for p, i in enumerate(ids)], "dataset string, engine string, start_time bigint, position bigint, id string"
    )
    good = results.manifest_documents(entries([f"q{i}" for i in range(8)]))
    assert results.manifest_entries(good).count() == 8
    repeated = results.manifest_entries(results.manifest_documents(entries(["a", "b", "c", "d", "a"])))
    for action in (lambda: repeated.count(), lambda: repeated.select("dataset").collect()):
        with pytest.raises(PySparkException, match="more than one entry"):
            action()


def test_published_tables_are_tables_again(spark, sf_dir, tmp_path):
    sinks.publish_dataset(spark, {"nation": f"{sf_dir}/nation.parquet"}, f"{tmp_path}/d/v")
    left = [f for f in os.listdir(f"{tmp_path}/d/v/nation") if not f.endswith(".crc")]
    assert left and all(f.endswith(".parquet") for f in left)


def test_publishing_again_follows_the_plan(spark, sf_dir, tmp_path):
    source = {t: f"{sf_dir}/{t}.parquet" for t in ("nation", "region")}
    target = f"{tmp_path}/d/v"
    assert sinks.publish_dataset(spark, source, target) == {"nation": "upload", "region": "upload"}
    assert sinks.publish_dataset(spark, source, target) == {"nation": "skip", "region": "skip"}
    assert sinks.publish_dataset(spark, {"nation": source["region"]}, target) == {"nation": "upload", "region": "delete"}
    assert os.listdir(target) == ["nation"] and "r_name" in spark.read.parquet(f"{target}/nation").columns
    with pytest.raises(ValueError):
        sinks.publish_dataset(spark, {}, target)


def test_a_version_is_seen_whole_or_not_at_all(spark, sf_dir, tmp_path, monkeypatch):
    source = {t: f"{sf_dir}/{t}.parquet" for t in ("nation", "region")}
    target = f"{tmp_path}/d/v"
    assert sinks.publish_version(spark, source, target) == {"nation": "upload", "region": "upload"}
    first = sinks.published_tables(spark, target)
    assert sinks.publish_version(spark, source, target) == {"nation": "skip", "region": "skip"}
    assert sinks.published_tables(spark, target) == first
    # a crash between two tables
    changed = {"nation": source["region"], "region": source["nation"]}
    write, written = sinks._write_table, []
    with monkeypatch.context() as crash:
        crash.setattr(sinks, "_write_table", lambda s, a, b: (_ for _ in ()).throw(RuntimeError("crash")) if written else (write(s, a, b), written.append(b)))
        with pytest.raises(RuntimeError, match="crash"):
            sinks.publish_version(spark, changed, target)
    assert written and sinks.published_tables(spark, target) == first
    assert spark.read.parquet(first["nation"]).columns[0] == "n_nationkey"
    # another writer is faster
    plan = sinks._table_actions
    with monkeypatch.context() as race:
        def overtaken(*listings):
            race.undo()
            sinks.publish_version(spark, {"nation": source["nation"]}, target)
            return plan(*listings)
        race.setattr(sinks, "_table_actions", overtaken)
        with pytest.raises(CommitConflict):
            sinks.publish_version(spark, changed, target)
    assert list(sinks.published_tables(spark, target)) == ["nation"]
    assert sinks.publish_version(spark, changed, target) == {"nation": "upload", "region": "upload"}
    now = sinks.published_tables(spark, target)
    assert spark.read.parquet(now["nation"]).columns[0] == "r_regionkey"
    # what no kept version names goes, the crashed writer's folder too
    sinks.remove_old_versions(spark, target, keep=1)
    assert len(os.listdir(f"{target}/versions")) == 1 and sinks.published_tables(spark, target) == now
    assert spark.read.parquet(now["region"]).count() == 25
    with pytest.raises(ValueError, match="No version"):
        sinks.published_tables(spark, target, 0)


def test_a_file_with_other_columns_is_found(spark, tmp_path):
    for n in range(3):
        spark.range(5).withColumn("v", F.lit("x")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert differing_files(spark, {"t": f"{tmp_path}/t"}).count() == 0
    odd = spark.createDataFrame([(1.5, 2)], "id double, w int")
    odd.coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    found = differing_files(spark, {"t": f"{tmp_path}/t", "alone": f"{tmp_path}/t"})
    expected = [("id", "double", "bigint", "type_differs"), ("v", None, "string", "missing"), ("w", "int", "int", "extra")]
    for table in ("t", "alone"):
        assert rows(found.where(F.col("table_name") == table), "column_name", "file_type", "usual_type", "outcome") == expected
    assert found.select("file").distinct().count() == 1
