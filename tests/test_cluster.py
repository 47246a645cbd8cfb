import datetime
import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import cluster
from logloom.operators.timeline import notices, timeline
from logloom.runtime import table

STATUS = "namespace string, pod string, pos int, kind string, name string, ready boolean, restart_count int, state struct<running:boolean,waiting:struct<reason:string>,terminated:struct<exit_code:int,signal:int,reason:string,message:string,finished_at:timestamp>>, last_state struct<terminated:struct<exit_code:int,signal:int,reason:string,message:string,finished_at:timestamp>>"
EVENT = "event_id bigint, namespace string, pos int, object_kind string, object_name string, type string, reason string, message string, event_time timestamp, last_ts timestamp, first_ts timestamp, created_ts timestamp, count int, series_count int"


def at(minute):
    return datetime.datetime(2026, 6, 24, 10, minute, tzinfo=datetime.UTC)


@pytest.fixture(scope="module")
def statuses(spark):
    gone = (137, 9, "OOMKilled", " out of memory ", at(5))
    rows = [
        ("n", "p", 0, "", "app", True, 2, (True, None, None), ((0, None, "", None, at(1)),)),
        ("n", "p", 1, None, "web", None, 0, (None, ("CrashLoop",), None), (None,)),
        ("n", "p", 0, "init", "setup", False, 0, (None, None, gone), (None,)),
        ("n", "p", 0, "ephemeral", "debug", False, None, None, None),
        ("n", "q", 0, "", "app", True, 0, (None, ("",), None), None),
    ]
    return spark.createDataFrame(rows, STATUS)


def test_containers(spark, statuses):
    specs = statuses.select("namespace", "pod", "pos", "kind", "name", F.lit("img:1").alias("image")).unionByName(spark.createDataFrame([("n", "p", 2, "", "new", None)], "namespace string, pod string, pos int, kind string, name string, image string"))
    got = {(r.pod, r["name"]): (r.ready, r.status, r.kind, r.image) for r in cluster.containers(specs, statuses).collect()}
    assert got[("p", "app")] == (True, "Running", "", "img:1") and got[("p", "web")] == (False, "Waiting (CrashLoop)", "", "img:1")
    assert got[("p", "setup")][1] == "Terminated (OOMKilled)" and got[("p", "debug")][1] == "Unknown" and got[("q", "app")][1] == "Waiting" and got[("p", "new")] == (False, "Unknown", "", "")
    found = cluster.containers(specs, statuses)
    assert cluster.container_list(found, "n", "p") == "\nPod: p\nNamespace: n\n\n✓ app [Running] (img:1)\n✗ web [Waiting (CrashLoop)] (img:1)\n✗ new [Unknown] ()\n✗ setup [init] [Terminated (OOMKilled)] (img:1)\n✗ debug [ephemeral] [Unknown] (img:1)\n"
    assert cluster.container_list(found, "n", "p", "posix") == "app\nweb\nnew\nsetup\ndebug"
    listed = json.loads(cluster.container_list(found, "n", "p", "json"))
    assert listed["containers"][0] == {"name": "app", "ready": True, "status": "Running", "image": "img:1"} and listed["containers"][3]["kind"] == "init"
    assert cluster.container_list(found, "n", "q", "yaml").startswith("pod: q\nnamespace: n\n")
    with pytest.raises(ValueError):
        cluster.container_list(found, "n", "p", "jsonn")
    assert [(r["name"], r.place) for r in cluster.container_order(specs).where("pod = 'p'").orderBy("place").collect()] == [("app", 1), ("web", 2), ("new", 3), ("setup", 4), ("debug", 5)]
    assert cluster.containers(specs.where("false"), statuses).count() == 0


def test_selectors_streams_and_suggestions(spark, statuses):
    pods = spark.createDataFrame([("n", "p", {"app": "a", "tier": "edge"}), ("n", "q", {"app": "b"}), ("m", "p", None)], "namespace string, pod string, labels map<string,string>")
    fits = lambda s: {(r.namespace, r.pod) for r in pods.where(cluster.selected(F.col("labels"), s)).collect()}
    p, q, m = ("n", "p"), ("n", "q"), ("m", "p")
    assert fits("app=a") == fits("app==a, tier") == {p} and fits("app!=a") == {q, m} and fits("!app") == {m} and fits("tier in (edge, core)") == {p}
    assert fits("app notin (a), app") == {q} and fits("") == {p, q, m}
    with pytest.raises(ValueError):
        fits("app in a")
    streams = spark.createDataFrame([("1", "n", "p", "app", "current"), ("2", "n", "p", "web", None), ("3", "n", "q", "app", "current"), ("4", "n", "p", "app", "previous"), ("5", "n", "q", "app", "previous")], "stream_id string, namespace string, pod string, container string, instance string")
    labels = lambda **x: {r.stream_id: r.label for r in cluster.selected_streams(pods, streams, "app", **x).collect()}
    assert labels() == {"1": "n/p/app", "2": "n/p/web", "3": "n/q"} and labels(all_namespaces=False, namespace="n", container="app") == {"1": "p", "3": "q"}
    assert labels(all_namespaces=False, namespace="m") == {}
    assert [r.stream_id for r in cluster.previous_streams(streams, statuses).collect()] == ["4"]
    named = spark.createDataFrame([("n", "worker-abc"), ("n", "worker-abd"), ("n", "x"), ("m", "worker-abc")], "namespace string, pod string")
    wanted = spark.createDataFrame([("n", "worker-abz"), ("n", "wrkr-a"), ("n", "y"), ("k", "worker-abc")], "namespace string, wanted string")
    assert {(r.namespace, r.wanted, r.suggestion, r.distance) for r in cluster.suggestions(wanted, named).collect()} == {("n", "worker-abz", "worker-abc", 1), ("n", "y", "x", 1)}


def test_timeline(spark, statuses):
    entries = spark.createDataFrame([("1", 2, 4, "boom", "text", None, None, 1_782_295_440_000_000_000), ("1", 1, 2, "no time", "text", None, None, None), ("1", 3, 3, "hi", "json", "l", {"k": "v w"}, 1_782_295_260_000_000_000), ("9", 1, 3, "other", "text", None, None, 0)], "stream_id string, line_no bigint, level int, message string, format string, logger string, fields map<string,string>, ts_ns bigint")
    streams = spark.createDataFrame([("1", "n", "p", "app", "current"), ("9", "n", "p", "app", "previous")], "stream_id string, namespace string, pod string, container string, instance string")
    rows = [(1, "n", 1, "Pod", "p", "Warning", "BackOff", " again ", at(4), at(9), None, at(0), 2, 7), (2, "n", 2, None, "p", "", "", None, None, None, at(1), at(0), None, None), (3, "n", 3, "Node", "p", "Normal", "r", "m", at(1), None, None, at(0), 1, None), (4, "n", 4, "Pod", "q", "Odd", "r", "m", None, None, None, at(2), 0, 0)]
    events = spark.createDataFrame([*rows, rows[0]], EVENT)
    got = [r.line for r in timeline(entries, streams, events, statuses, level="level").where("pod = 'p'").collect()]
    assert got == [
        "[2026-06-24 10:01:00] [LOG] [WARN] hi k=\"v w\"",
        "[2026-06-24 10:01:00] [EVENT] [Normal] p Event: Event",
        '[2026-06-24 10:01:00] [TERM] (previous) container "app" exited with code 0',
        "[2026-06-24 10:04:00] [LOG] [ERROR] boom",
        "[2026-06-24 10:04:00] [EVENT] [Warning] pod/p BackOff: again (x7)",
        '[2026-06-24 10:05:00] [TERM] container "setup" exited with code 137 (signal 9) — OOMKilled: out of memory',
        "[no timestamp] [LOG] [INFO] no time",
    ]
    kept = cluster.pod_events(events, None, 1).collect()
    assert {(r.event_id, r.truncated) for r in kept} == {(1, True), (4, False)} and [r.line for r in notices(events, None, 1).collect()] == ["[notice] event list truncated to the first 1 events"]
    pods = spark.createDataFrame([("n", "q")], "namespace string, pod string")
    assert [r.event_id for r in cluster.pod_events(events, pods).collect()] == [4]
    assert timeline(entries.where("false"), streams, events.where("false"), statuses.where("false"), level="level").count() == 0


def test_joins_are_broadcast_only_if_small(spark):
    df = spark.range(100)
    assert "ResolvedHint" in cluster.small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in cluster.small(df, 99)._jdf.queryExecution().analyzed().toString()


def test_events_of_the_tables_have_a_time(spark, small):
    assert table(spark, small, "pod_events").where(cluster.event_time().isNull()).count() == 0
