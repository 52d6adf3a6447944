"""Exactly-once delivery and schema drift against plain Python."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evalweave.operators import delivery, drift

SCHEMA = "delivery_id long, dataset string, model string, source_file string, row_index long, completion_index int, received_at timestamp, extra string"


def deliveries(n=600, seed=1):
    rng = random.Random(seed)
    start = datetime(2031, 1, 1)
    rows = []
    for k in range(n):
        hot = rng.random() < 0.35  # one identifier holds a third of all rows
        row = 7 if hot else rng.choice([None, *range(60)])
        rows.append((k, rng.choice(["a", None]) if not hot else "a", "m", "f", row, 0 if hot else rng.choice([None, 0, 1]), rng.choice([None, start + timedelta(minutes=rng.randint(0, 5))]), "x"))
    return rows


def expected_surplus(rows):
    best = {}
    for r in rows:
        if r[4] is None:
            continue
        key = (r[1], r[2], r[3], r[4], r[5] or 0)
        rank = (r[6] is not None, r[6] or datetime.min, r[0])
        if key not in best or rank > best[key][0]:
            best[key] = (rank, r[0])
    kept = {v for _, v in best.values()}
    return {r[0] for r in rows if r[4] is not None and r[0] not in kept}


def test_surplus_matches_plain_python(spark):
    rows = deliveries()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = delivery.surplus(df, delivery.result_key(), delivery.latest(), "delivery_id", has_key=F.col("row_index").isNotNull())
    found = [r[0] for r in got.select("delivery_id").collect()]
    assert len(found) == len(set(found)) and set(found) == expected_surplus(rows)


def test_kept_and_surplus_make_the_whole(spark):
    rows = deliveries(300, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = delivery.exactly_once(df.where("delivery_id >= 150"), delivery.result_key(), delivery.latest(), "delivery_id", stored=df.where("delivery_id < 150"), has_key=F.col("row_index").isNotNull())
    ids = [r.delivery_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r[0] for r in rows} - expected_surplus(rows)
    assert kept.columns == df.columns


def test_ties_and_empty_tables(spark):
    same = [(k, "a", "m", "f", 1, None, None, "x") for k in range(5)]
    df = spark.createDataFrame(same, SCHEMA)
    assert [r.delivery_id for r in delivery.exactly_once(df, delivery.result_key(), delivery.latest(), "delivery_id").collect()] == [4]
    empty = df.limit(0)
    assert delivery.exactly_once(empty, delivery.result_key(), delivery.latest(), "delivery_id").count() == 0
    assert delivery.surplus(empty, delivery.result_key(), delivery.latest(), "delivery_id").count() == 0


def test_rank_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame(deliveries(50), SCHEMA)
    plan = delivery.exactly_once(df, delivery.result_key(), delivery.latest(), "delivery_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "CartesianProduct" not in plan


def raw(spark, files):
    rows = [("r", "unittest", n, k, json.dumps(line) if not isinstance(line, (str, type(None))) else line) for n, lines in files.items() for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "run_id string, record_kind string, file_no int, line_no int, raw string")


FILES = {
    1: [{"status": "success", "passed": True, "harness": {"version": "1", "workers": 4}, "n": 1, "q": [1]}, None, "{broken", "null", "[1]"],
    2: [{"outcome": "success", "passed": 1, "harness": {"ver": "1", "workers": 4}, "n": 1.5, "q": [1], "gone": None}],
    3: [{"outcome": {"name": "success"}, "harness": {"ver": "1"}, "n": 2, "x": 1, "y": 2, "q": [1]}, ""],
    5: [{"other": 1}],
}


def test_changes(spark):
    df = raw(spark, FILES)
    got = {tuple(r)[2:] for r in drift.changes(drift.schemas(drift.fields(df), df)).collect()}
    assert got == {
        (2, "renamed", "status", "outcome"), (2, "type_changed", "passed", "passed"), (2, "renamed", "harness.version", "harness.ver"),
        (3, "type_changed", "outcome", "outcome"), (3, "removed", "passed", "passed"), (3, "removed", "harness.workers", "harness.workers"), (3, "added", "x", "x"), (3, "added", "y", "y"),
    }


def test_file_without_fields_counts(spark):
    df = raw(spark, {1: [{"a": 1}], 2: ["{broken"], 3: [{"a": 1}]})
    got = {tuple(r)[2:] for r in drift.changes(drift.schemas(drift.fields(df), df)).collect()}
    assert got == {(2, "removed", "a", "a"), (3, "added", "a", "a")}


def test_null_runs_and_empty_table(spark):
    df = raw(spark, FILES).withColumn("run_id", F.lit(None).cast("string"))
    assert drift.changes(drift.schemas(drift.fields(df), df)).count() == 8
    empty = df.limit(0)
    assert drift.changes(drift.schemas(drift.fields(empty), empty)).count() == 0
    assert drift.versions(drift.schemas(drift.fields(empty), empty)).count() == 0


def test_one_consistent_table(spark):
    df = raw(spark, FILES)
    found = drift.fields(df)
    routed = drift.schemas(found, df)
    rules = drift.chained(drift.changes(routed), found, drift.TARGETS)
    assert "outcome" in next(r for r in rules if r.name == "status").aliases
    rows = drift.unified(df, routed, rules, ("file_no", "line_no")).orderBy("file_no", "line_no").collect()
    assert len(rows) == sum(map(len, FILES.values()))
    assert [r.status for r in rows if r.parsed][:3] == ["success"] * 3
    assert [r.passed for r in rows if r.parsed][:2] == [True, True]
    assert {r.completion_index for r in rows} == {0}  # the default
    assert sum(not r.parsed for r in rows) == 5


def test_migration_steps(spark):
    df = raw(spark, FILES)
    found = drift.fields(df)
    routed = drift.schemas(found, df)
    rules = drift.chained(drift.changes(routed), found, (drift.Rule("status", "string"), drift.Rule("passed", "boolean"), drift.Rule("harness.version", "string")))
    got = {tuple(r)[2:] for r in drift.migration(routed, rules).collect()}
    assert {x for x in got if x[1] != "drop"} == {
        (2, "rename", "outcome", "status"), (2, "cast", "passed", "passed"), (2, "rename", "harness.ver", "harness.version"),
        (3, "rename", "outcome", "status"), (3, "cast", "outcome", "status"), (3, "rename", "harness.ver", "harness.version"), (3, "default", None, "passed"),
        (5, "default", None, "status"), (5, "default", None, "passed"), (5, "default", None, "harness.version"),
    }
    assert {x[2] for x in got if x[1] == "drop"} == {"harness.workers", "n", "q", "x", "y", "other"}


def test_versions_rise_with_each_change(spark):
    got = {r.file_no: r.version for r in drift.versions(drift.schemas(drift.fields(raw(spark, FILES)), raw(spark, FILES))).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 5: 4}


def test_files_of_one_schema_share_a_fingerprint_and_lines_take_the_steps_of_their_file(spark):
    df = raw(spark, {1: [{"passed": True, "code": "x"}], 2: [{"pass": 1, "code": ["a", "b"]}], 3: [{"passed": False, "code": "y"}], 4: [{"passed": True, "pass": False, "code": "z"}], 7: ["broken"]})
    found = drift.fields(df)
    routed = drift.schemas(found, df)
    prints = {r.file_no: r.fingerprint for r in routed.collect()}
    assert prints[1] == prints[3] and len(set(prints.values())) == 4 and drift.registry(routed).count() == 4
    rules = (drift.Rule("passed", "boolean", ("pass",)), drift.Rule("code", "string", default="-"))
    got = {r.file_no: (r.passed, r.code) for r in drift.unified(df, routed, rules, ("file_no",)).collect()}
    assert got == {1: (True, "x"), 2: (True, "a\nb"), 3: (False, "y"), 4: (True, "z"), 7: (None, "-")}
    steps = {tuple(r)[2:] for r in drift.migration(routed, rules).where("file_no in (2, 4)").collect()}
    assert (2, "rename", "pass", "passed") in steps and (2, "cast", "code", "code") in steps and (4, "drop", "pass", None) in steps


def test_empty_and_nested_objects(spark):
    df = raw(spark, {1: [{"harness": {}, "generation_metadata": {"seed": {"a": 1}, "x": None}, "other": {"k": 1}, "e": {}}]})
    got = {(r.parent, r.field_name): r.json_type for r in drift.fields(df).collect()}
    assert got == {("generation_metadata", "generation_metadata.seed"): "object", ("", "other"): "object", ("", "e"): "object"}
