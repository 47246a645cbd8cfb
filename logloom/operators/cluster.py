"""Pods, containers, events and streams: who wrote the logs, and what happened to them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import sanitize, trim_blanks

# The order of container kinds.
KINDS = ("", "init", "ephemeral")
MAX_EVENTS = 500
#: A side of a join up to this many rows is sent to all executors; checked before.
MAX_SENT_ROWS = 1 << 16


def small(df: DataFrame, most: int = MAX_SENT_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def kind_rank(kind: Column) -> Column:
    """0 for regular, 1 for init, 2 for ephemeral containers; unknown kinds last."""
    known = F.coalesce(kind, F.lit(""))
    return F.when(known == "", 0).when(known == "init", 1).when(known == "ephemeral", 2).otherwise(3)


def state_text(state: Column) -> Column:
    """Running, Waiting (reason), Terminated (reason) or Unknown."""

    def with_reason(name: str, reason: Column) -> Column:
        return F.when(F.coalesce(reason, F.lit("")) == "", name).otherwise(F.concat(F.lit(f"{name} ("), reason, F.lit(")")))

    return (
        F.when(state["running"], "Running")
        .when(state["waiting"].isNotNull(), with_reason("Waiting", state["waiting"]["reason"]))
        .when(state["terminated"].isNotNull(), with_reason("Terminated", state["terminated"]["reason"]))
        .otherwise("Unknown")
    )


def last_status(statuses: DataFrame) -> DataFrame:
    """The status that counts for each name of a pod: the last in order of kind and place."""
    order = Window.partitionBy("namespace", "pod", "name").orderBy(kind_rank(F.col("kind")).desc(), F.col("pos").desc())
    return statuses.withColumn("_last", F.row_number().over(order)).where("_last = 1").drop("_last")


def containers(specs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Containers of each pod with readiness and state: ``namespace, pod, pos, kind, name,
    image, ready, status``. A container without status is not ready and Unknown. ``specs``
    without images have empty ones."""
    image = F.coalesce("image", F.lit("")) if "image" in specs.columns else F.lit("")
    own = specs.select("namespace", "pod", "pos", F.coalesce("kind", F.lit("")).alias("kind"), "name", image.alias("image"))
    status = last_status(statuses).select("namespace", "pod", "name", F.col("ready").alias("_ready"), state_text(F.col("state")).alias("_status"))
    out = own.join(status, ["namespace", "pod", "name"], "left")
    return out.select("namespace", "pod", "pos", "kind", "name", "image", F.coalesce("_ready", F.lit(False)).alias("ready"), F.coalesce("_status", F.lit("Unknown")).alias("status"))


def container_order(specs: DataFrame) -> DataFrame:
    """``namespace, pod, name, place``: containers of a pod in the order logs are read."""
    order = Window.partitionBy("namespace", "pod").orderBy(kind_rank(F.col("kind")), "pos")
    return specs.select("namespace", "pod", F.coalesce("kind", F.lit("")).alias("kind"), "name", F.row_number().over(order).alias("place"))


def container_row(name: Column, kind: Column, ready: Column, status: Column, image: Column) -> Column:
    """A container as a row of the table."""
    tag = F.when(kind != "", F.concat(F.lit(" ["), sanitize(kind), F.lit("]"))).otherwise("")
    return F.concat(F.when(ready, "✓").otherwise("✗"), F.lit(" "), sanitize(name), tag, F.lit(" ["), sanitize(status), F.lit("] ("), sanitize(image), F.lit(")"))


def container_list(found: DataFrame, namespace: str, pod: str, output: str = "") -> str:
    """Containers of one pod as a table, ``json``, ``yaml`` or ``posix``; ValueError for
    another format. Gathers the rows of one pod."""
    if output not in ("", "json", "yaml", "posix"):
        raise ValueError(f"unknown output format {output!r} (valid: json, yaml, posix, or none for a table)")
    own = found.where((F.col("namespace") == namespace) & (F.col("pod") == pod)).orderBy(kind_rank(F.col("kind")), "pos")
    safe = [sanitize(F.col(c)).alias(c) for c in ("name", "status", "image", "kind")]
    rows = own.select(*safe, "ready", container_row(F.col("name"), F.col("kind"), F.col("ready"), F.col("status"), F.col("image")).alias("row")).collect()
    if not output:
        return "\n".join([f"\nPod: {pod}\nNamespace: {namespace}\n", *(r.row for r in rows)]) + "\n"
    if output == "posix":
        return "\n".join(r["name"] for r in rows)
    listed = [{"name": r["name"], "ready": r.ready, "status": r.status, "image": r.image} | ({"kind": r.kind} if r.kind else {}) for r in rows]
    data = {"pod": pod, "namespace": namespace, "containers": listed}
    if output == "json":
        return json.dumps(data, indent=2, ensure_ascii=False)
    import yaml

    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


def selected(labels: Column, selector: str) -> Column:
    """Whether labels fit a selector of terms ``k=v``, ``k==v``, ``k!=v``, ``k``, ``!k``,
    ``k in (a, b)`` and ``k notin (a, b)`` joined by commas. Null labels are no labels."""
    import re

    out = F.lit(True)
    for term in (t.strip() for t in re.split(r",(?![^(]*\))", selector) if t.strip()):
        listed = re.fullmatch(r"(\S+)\s+(in|notin)\s*\(([^)]*)\)", term)
        equal = re.fullmatch(r"([^=!\s]+)\s*(==|=|!=)\s*(\S*)", term)
        bare = re.fullmatch(r"(!?)\s*([^=!\s(),]+)", term)
        if listed:
            value, values = F.try_element_at(labels, F.lit(listed[1])), [v.strip() for v in listed[3].split(",")]
            test = F.coalesce(value.isin(*values), F.lit(False))
            test = test if listed[2] == "in" else ~test
        elif equal:
            test = F.coalesce(F.try_element_at(labels, F.lit(equal[1])) == equal[3], F.lit(False))
            test = ~test if equal[2] == "!=" else test
        elif bare:
            test = F.coalesce(F.map_contains_key(labels, F.lit(bare[2])), F.lit(False))
            test = ~test if bare[1] else test
        else:
            raise ValueError(f"invalid selector {selector!r}")
        out = out & test
    return out


def selected_streams(pods: DataFrame, streams: DataFrame, selector: str, namespace: str | None = None, container: str = "", all_namespaces: bool = True) -> DataFrame:
    """Streams of the pods that a selector fits, with their ``label``.

    The label is the pod, behind the namespace if all are read, before the container if the
    pod has several. With ``container`` only that one is read; pods without it drop out.
    """
    fit = pods.where(selected(F.col("labels"), selector))
    if not all_namespaces:
        fit = fit.where(F.col("namespace") == namespace)
    current = streams.where(F.coalesce("instance", F.lit("current")) == "current")
    if container:
        current = current.where(F.col("container") == container)
    own = current.join(small(fit.select("namespace", "pod").distinct()), ["namespace", "pod"], "left_semi")
    several = F.count(F.lit(1)).over(Window.partitionBy("namespace", "pod")) > 1
    parts = ([F.col("namespace")] if all_namespaces else []) + [F.col("pod"), F.when(several, F.col("container"))]
    return own.withColumn("label", F.concat_ws("/", *parts))


def previous_streams(streams: DataFrame, statuses: DataFrame) -> DataFrame:
    """Streams of earlier instances of containers that have restarted."""
    restarted = statuses.where(F.col("restart_count") > 0).select("namespace", "pod", F.col("name").alias("container")).distinct()
    return streams.where(F.col("instance") == "previous").join(small(restarted), ["namespace", "pod", "container"], "left_semi")


def suggestions(wanted: DataFrame, pods: DataFrame) -> DataFrame:
    """For each ``namespace`` and ``wanted`` name the pod it may mean (``suggestion``): the
    first of those with the smallest edit distance, if it is below the greater of 2 and a
    third of the name's length. Names without one are left out."""
    pairs = wanted.join(small(pods.select("namespace", "pod")), "namespace")
    budget = F.greatest(F.lit(2), F.floor(F.octet_length("wanted") / 3).cast("int"))
    near = pairs.withColumn("distance", F.levenshtein("wanted", "pod")).where(F.col("distance") < budget)
    best = near.groupBy("namespace", "wanted").agg(F.min(F.struct("distance", "pod")).alias("_best"))
    return best.select("namespace", "wanted", F.col("_best.pod").alias("suggestion"), F.col("_best.distance").alias("distance"))


def event_time(prefix: str = "") -> Column:
    """First time of an event that is filled."""
    return F.coalesce(*[F.col(prefix + name) for name in ("event_time", "last_ts", "first_ts", "created_ts")])


def event_count() -> Column:
    """How often an event happened: of its series if above 0, else its own."""
    return F.when(F.col("series_count") > 0, F.col("series_count")).otherwise(F.coalesce("count", F.lit(0)))


def pod_events(events: DataFrame, pods: DataFrame | None = None, limit: int | None = MAX_EVENTS) -> DataFrame:
    """Events of pods with ``truncated``: those of kind Pod or of no kind, the first
    ``limit`` (by place) of each pod; re-delivered rows count once. With ``pods``, only of
    the pods there. ``truncated`` tells that a pod has more."""
    own = events.where(F.coalesce("object_kind", F.lit("")).isin("", "Pod")).dropDuplicates(["namespace", "event_id"])
    if pods is not None:
        own = own.join(small(pods.select("namespace", F.col("pod").alias("object_name")).distinct()), ["namespace", "object_name"], "left_semi")
    if limit is None:
        return own.withColumn("truncated", F.lit(False))
    # The first limit + 1 of each pod are found before rows are shuffled to one place.
    each = Window.partitionBy("namespace", "object_name")
    first = own.withColumn("_place", F.row_number().over(each.orderBy("pos", "event_id"))).where(F.col("_place") <= limit + 1)
    told = first.withColumn("truncated", F.max("_place").over(each) > limit)
    return told.where(F.col("_place") <= limit).drop("_place")


def normal_event(events: DataFrame) -> DataFrame:
    """Events with their defaults filled in: ``ts``, ``type``, ``object``, ``reason``,
    ``message`` and ``n``."""
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("Event"))
    kind, name = F.lower(F.coalesce("object_kind", F.lit(""))), F.coalesce("object_name", F.lit(""))
    return events.select(
        "namespace",
        "object_name",
        "event_id",
        "pos",
        event_time().alias("ts"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("Normal")).alias("type"),
        F.when((kind != "") & (name != ""), F.concat(kind, F.lit("/"), name)).otherwise(F.concat(kind, name)).alias("object"),
        reason.alias("reason"),
        F.coalesce(F.nullif(trim_blanks(F.col("message")), F.lit("")), reason).alias("message"),
        event_count().alias("n"),
    )


def terminations(statuses: DataFrame) -> DataFrame:
    """Ends of containers: of the instance before and of the present one, in that order."""
    fields = ["exit_code", "signal", "reason", "message", "finished_at"]

    def ended(state: Column, previous: bool) -> DataFrame:
        rows = statuses.where(state["terminated"].isNotNull())
        return rows.select("namespace", "pod", "name", kind_rank(F.col("kind")).alias("kind_rank"), "pos", F.lit(previous).alias("previous"), *[state["terminated"][f].alias(f) for f in fields])

    return ended(F.col("last_state"), True).unionByName(ended(F.col("state"), False))
