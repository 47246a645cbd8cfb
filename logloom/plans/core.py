"""Queries for the operators of the reference, each over its whole tables.

Names begin with the operator's id in the inventory. Log queries decode the raw lines of
``log_lines``; field, predicate, digest and rendering queries read the archive ``entries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import fields, levels, text, times
from logloom.operators import cluster, digest, render
from logloom.operators.decode import decode
from logloom.operators.grouping import query_lines
from logloom.operators.predicates import parse_predicate, where_column
from logloom.operators.timeline import event_items, log_items, notices, termination_items, timeline
from logloom.options import QueryOptions
from logloom.runtime import materialize, scratch, table
from logloom.sources import lines as sources
from logloom.streaming.follow import follow, start

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The instant that queries take for now: 2026-06-01 00:00:00 UTC.
NOW_NS = 1_780_272_000_000_000_000
SELECTOR = "tier in (edge, core), app!=quota"
ENTRY_KEYS = ["stream_id", "line_no"]


def query(make: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[make.__name__] = make
    return make


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Re-delivered rows count once."""
    return df.dropDuplicates(list(keys))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines as the bounded reader gives them."""
    return table(spark, sf_dir, "log_lines").withColumn("raw", text.bounded_line(F.col("raw")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived entries, each once."""
    return once(table(spark, sf_dir, "entries"), *ENTRY_KEYS)


def archived(e: DataFrame) -> dict[str, Column]:
    """Columns that predicates and projections look at; the archive keeps no raw text."""
    return {"level": F.col("level"), "message": F.col("message"), "raw_line": F.lit(None).cast("string"), "logger": F.col("logger"), "fields": F.col("fields"), "ts_ns": F.col("ts_ns")}


# --- A: scans -----------------------------------------------------------------


@query
def a1_text_files(spark, sf_dir):
    """Lines written to text files and read back: lines and bytes of each stream. Line
    feeds separate, carriage returns go."""
    own = once(table(spark, sf_dir, "log_lines").where(F.col("raw").isNotNull()), *ENTRY_KEYS)
    path = f"{scratch(spark, 'text')}/lines"
    own.select("raw").write.text(path, lineSep="\n")
    read = sources.read_lines(spark, path)
    return read.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"))


@query
def a2_bounded_lines(spark, sf_dir):
    """Lines without their carriage return, bounded."""
    return once(lines(spark, sf_dir), *ENTRY_KEYS).select(*ENTRY_KEYS, "raw")


@query
def a3_container_lines(spark, sf_dir):
    """Lines of one container: the app of the hot pod."""
    own = sources.one_container(lines(spark, sf_dir), table(spark, sf_dir, "streams"), "harbor", "gate-hotpath-0", "app")
    return once(own, *ENTRY_KEYS).select(*ENTRY_KEYS)


@query
def a5_previous_instances(spark, sf_dir):
    """Streams of earlier instances of containers that have restarted."""
    return cluster.previous_streams(table(spark, sf_dir, "streams"), table(spark, sf_dir, "container_statuses")).select("stream_id")


@query
def a6_container_order(spark, sf_dir):
    """Containers of every pod in the order their logs are read."""
    return cluster.container_order(table(spark, sf_dir, "container_statuses"))


@query
def a7_selected_lines(spark, sf_dir):
    """Lines of the pods that a selector fits, by stream."""
    own = sources.labelled_lines(once(lines(spark, sf_dir), *ENTRY_KEYS), table(spark, sf_dir, "pods"), table(spark, sf_dir, "streams"), SELECTOR)
    return own.groupBy("stream_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def a8_event_scan(spark, sf_dir):
    """Events of every pod, at most 500 of each, and whether there are more."""
    return cluster.pod_events(table(spark, sf_dir, "pod_events"), table(spark, sf_dir, "pods")).select("event_id", "namespace", "object_name", "truncated")


def _misspelt(spark, sf_dir):
    pods = table(spark, sf_dir, "pods")
    return pods.select("namespace", F.concat(F.expr("left(pod, length(pod) - 1)"), F.lit("zz")).alias("wanted"))


@query
def a9_did_you_mean(spark, sf_dir):
    """What misspelt pod names may mean."""
    return cluster.suggestions(_misspelt(spark, sf_dir), table(spark, sf_dir, "pods"))


@query
def a12_since(spark, sf_dir):
    """Lines of the last 480 hours and half a second."""
    return once(sources.since(table(spark, sf_dir, "log_lines"), "480h0.5s", NOW_NS), *ENTRY_KEYS).select(*ENTRY_KEYS)


@query
def a13_stamped_lines(spark, sf_dir):
    """Lines with their ingest time in front."""
    return sources.stamped(once(lines(spark, sf_dir), *ENTRY_KEYS)).select(*ENTRY_KEYS, "raw")


# --- B: grammars --------------------------------------------------------------


def decoded(spark, sf_dir) -> DataFrame:
    """Decoded lines, each once, blank ones left out."""
    own = once(lines(spark, sf_dir), *ENTRY_KEYS)
    return decode(own.where(~text.is_blank(F.col("raw"))).select(*ENTRY_KEYS, "raw"))


_SHOWN = [*ENTRY_KEYS, "level", "level_detected", "message", "logger", "ts_ns"]
#: Patterns of the line behind a collector's time that tell grammars of format text apart.
_KLOG = r"\A[IWEF][0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+[\t ]+[0-9]+[\t ]+\S+:[0-9]+\]"
_SYSLOG = r"\A<[0-9]{1,3}>"
_ACCESS = r'"(?:GET|HEAD|POST|PUT|DELETE|PATCH|OPTIONS|CONNECT|TRACE) [^"]*HTTP/[0-9.]+"[\t ]+[0-9]{3}'
_CSV = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?,"


def _payload() -> Column:
    return F.regexp_replace(F.col("raw"), r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z[\t\n\f\r ]+", "")


def _grammar(form: str, *like: str, unlike: tuple[str, ...] = (), json: bool | None = None) -> Query:
    """Rows of a format whose payload fits the patterns of ``like`` and none of ``unlike``."""

    def run(spark, sf_dir):
        rows = decoded(spark, sf_dir).where(F.col("format") == form)
        for pattern in like:
            rows = rows.where(_payload().rlike(pattern))
        for pattern in unlike:
            rows = rows.where(~_payload().rlike(pattern))
        if json is not None:
            rows = rows.where(F.try_parse_json(_payload()).isNotNull() == json)
        return rows.select(*_SHOWN)

    return run


QUERIES["b2_json"] = _grammar("json", json=True)
QUERIES["b3_yaml_flow"] = _grammar("json", json=False)
QUERIES["b4_bracketed"] = _grammar("bracketed")
QUERIES["b5_logfmt"] = _grammar("logfmt")
QUERIES["b6_klog"] = _grammar("text", _KLOG)
QUERIES["b7_syslog"] = _grammar("text", _SYSLOG)
QUERIES["b8_access"] = _grammar("text", _ACCESS)
QUERIES["b9_xml"] = _grammar("xml")
QUERIES["b10_csv"] = _grammar("text", _CSV)
QUERIES["b11_plain"] = _grammar("text", unlike=(_KLOG, _SYSLOG, _ACCESS, _CSV))


@query
def b1_collector_time(spark, sf_dir):
    """Entries whose time a collector put in front of the line."""
    prefixed = F.col("raw").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z[\t\n\f\r ]+")
    return decoded(spark, sf_dir).where(prefixed).select(*ENTRY_KEYS, "ts_ns")


@query
def b12_bag_fields(spark, sf_dir):
    """Fields of the bags of all grammars that have them."""
    return decoded(spark, sf_dir).where(F.col("fields").isNotNull()).select(*ENTRY_KEYS, F.explode("fields").alias("key", "value")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query
def b_formats(spark, sf_dir):
    """Lines of each format, by level: the detection order at work."""
    return decoded(spark, sf_dir).groupBy("format", "level", "level_detected").agg(F.count(F.lit(1)).alias("n"))


# --- C: fields ----------------------------------------------------------------


@query
def c1_key_kinds(spark, sf_dir):
    """What keys mean, and the text that each means for every entry."""
    e = entries(spark, sf_dir)
    own = archived(e)
    return e.select(*ENTRY_KEYS, *[fields.resolve(k, **own).alias(n) for k, n in (("Severity", "as_level"), ("msg", "as_message"), ("Component", "as_logger"), ("@timestamp", "as_time"), ("SHARD", "as_field"))])


@query
def c2_field_lookup(spark, sf_dir):
    """A field by name whatever its case, and how it is missed exactly (C3)."""
    e = entries(spark, sf_dir)
    return e.select(*ENTRY_KEYS, fields.field(F.col("fields"), "Shard").alias("folded"), fields.field_exact(F.col("fields"), "Shard").alias("exact"), fields.first_field(F.col("fields"), ("no", "SHARD")).alias("first_of"))


@query
def c6_trailing_fields(spark, sf_dir):
    """Fields that bracketed lines end with."""
    own = decoded(spark, sf_dir).where((F.col("format") == "bracketed") & F.col("fields").isNotNull())
    return own.select(*ENTRY_KEYS, "message", F.explode("fields").alias("key", "value"))


@query
def c7_leading_meta(spark, sf_dir):
    """Messages of plain lines that begin with a time, a level or both."""
    own = decoded(spark, sf_dir).where((F.col("format") == "text") & _payload().rlike(r"\A(?:[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9:]+ |(?i:debug|info|warn|warning|error|fatal|trace) [0-9]{4}-)"))
    return own.select(*ENTRY_KEYS, "message", "ts_ns")


_PROJECTED = ("level", "ts", "shard", "Logger", "msg")


@query
def c8_project_text(spark, sf_dir):
    """Projections as text; entries that have none of the fields are dropped."""
    e = entries(spark, sf_dir)
    own = render.render(e, QueryOptions.of(fields=("shard", "logger")), "level")
    return own.select(*ENTRY_KEYS, "line")


@query
def c8_project_text_all(spark, sf_dir):
    """Projections of level, time, a field, logger and message as text."""
    return render.render(entries(spark, sf_dir), QueryOptions.of(fields=_PROJECTED), "level").select(*ENTRY_KEYS, "line")


@query
def c9_project_json(spark, sf_dir):
    """Projections as flat JSON objects with sorted keys."""
    return render.render(entries(spark, sf_dir), QueryOptions.of(fields=("shard", "level", "logger"), output="json"), "level").select(*ENTRY_KEYS, "line")


@query
def c10_extra_fields(spark, sf_dir):
    """Fields of decoded lines that the entry's own columns do not show."""
    own = decoded(spark, sf_dir).select(*ENTRY_KEYS, F.explode(fields.extra_fields(F.col("fields"))).alias("key", "value"))
    return own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def c11_aliases(spark, sf_dir):
    """Messages of logfmt lines if ``shard`` were a name for the message field."""
    from logloom.functions.names import DEFAULT_NAMES

    own = decode(once(lines(spark, sf_dir), *ENTRY_KEYS).where(F.col("raw").contains("shard=")).select(*ENTRY_KEYS, "raw"), names=DEFAULT_NAMES.with_aliases(message=("shard",), level=("shard",)))
    return own.where(F.col("format") == "logfmt").groupBy("level", "level_detected").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message").alias("n_messages"))


# --- D: scalar functions ------------------------------------------------------


@query
def d1_parse_level(spark, sf_dir):
    """Levels of words and numbers."""
    words = entries(spark, sf_dir).select(F.col("level_name").alias("word")).unionByName(table(spark, sf_dir, "pod_events").select(F.col("type").alias("word"))).unionByName(table(spark, sf_dir, "events").select((F.col("user_id") % 71).cast("string").alias("word")))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", levels.parse_level(F.col("word")).alias("level"), levels.is_level_word(F.col("word")).alias("is_word"))


@query
def d4_status_level(spark, sf_dir):
    """Levels of HTTP statuses, with D12's class, of access lines."""
    status = F.regexp_extract("raw", r'HTTP/[0-9.]+" ([0-9]{3})', 1).try_cast("int")
    own = once(lines(spark, sf_dir), *ENTRY_KEYS).select(status.alias("status")).where(F.col("status").isNotNull())
    bag = F.create_map(F.lit("path"), F.lit("/"), F.lit("Status"), F.col("status").cast("string"))
    return own.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", "n", levels.level_of_status(F.col("status")).alias("level"), fields.status_class(bag).alias("status_class"), fields.shows_request(bag).alias("is_request"))


@query
def d8_parse_time(spark, sf_dir):
    """Instants of time texts in the layouts of log lines, and of time fields (D7, D9)."""
    own = table(spark, sf_dir, "json_entries").select("rec_id", "time").distinct()
    return own.select("rec_id", times.parse_time(F.col("time")).alias("layout_ns"), times.time_field(F.col("time")).alias("field_ns"))


@query
def d9_epoch(spark, sf_dir):
    """Instants of epoch numbers by their magnitude."""
    own = table(spark, sf_dir, "timeline_items").where(F.col("stamp").rlike(r"\A[0-9]{9,19}\z")).select("rec_id", "stamp").distinct()
    return own.select("rec_id", times.epoch_ns(F.col("stamp")).alias("ts_ns"))


@query
def d10_logger(spark, sf_dir):
    """Logger labels of structured lines, named or guessed."""
    return decoded(spark, sf_dir).where(F.col("format").isin("json", "logfmt", "bracketed", "xml")).groupBy("format", "logger").agg(F.count(F.lit(1)).alias("n"))


@query
def d11_template(spark, sf_dir):
    """Templates of messages."""
    return entries(spark, sf_dir).where(F.col("message").isNotNull()).select(*ENTRY_KEYS, text.message_template(F.col("message")).alias("template"))


@query
def d13_sanitize(spark, sf_dir):
    """Lines with unsafe characters spelt out, and values in quotes where needed (D14)."""
    own = once(table(spark, sf_dir, "log_lines"), *ENTRY_KEYS).where(F.col("raw").isNotNull())
    return own.select(*ENTRY_KEYS, text.sanitize(F.col("raw")).alias("safe"), text.quoted(F.col("raw")).alias("shown"), text.needs_attention(F.col("raw")).alias("attention"))


@query
def d16_display_time(spark, sf_dir):
    """Times as shown and as RFC 3339."""
    return entries(spark, sf_dir).select(*ENTRY_KEYS, times.display_time(F.col("ts_ns")).alias("shown"), times.rfc3339(F.col("ts_ns")).alias("machine"))


@query
def d17_line_tests(spark, sf_dir):
    """Which lines are indented (D17), bounds of a trace (D18) or blank (D19)."""
    own = once(table(spark, sf_dir, "log_lines"), *ENTRY_KEYS)
    return own.select(*ENTRY_KEYS, text.is_indented(F.col("raw")).alias("indented"), text.is_trace_boundary(F.col("raw")).alias("boundary"), text.is_blank(F.col("raw")).alias("blank"))


@query
def d20_edit_distance(spark, sf_dir):
    """Edit distances of misspelt names to their pods."""
    own = table(spark, sf_dir, "pods")
    return own.select("namespace", "pod", F.levenshtein(F.col("pod"), F.reverse("pod")).alias("distance"))


@query
def d21_container_state(spark, sf_dir):
    """Container states as text."""
    return table(spark, sf_dir, "container_statuses").select("namespace", "pod", "name", cluster.state_text(F.col("state")).alias("status"))


@query
def d22_normal_events(spark, sf_dir):
    """Events with defaults, their time (D23) and count."""
    own = cluster.normal_event(once(table(spark, sf_dir, "pod_events"), "event_id"))
    return own.select("event_id", F.unix_micros("ts").alias("ts_us"), "type", "object", "reason", "message", "n")


@query
def d25_stream_labels(spark, sf_dir):
    """Labels of the streams that a selector fits."""
    return cluster.selected_streams(table(spark, sf_dir, "pods"), table(spark, sf_dir, "streams"), SELECTOR).select("stream_id", "label")


@query
def d26_whole_numbers(spark, sf_dir):
    """Field values that are whole numbers."""
    own = entries(spark, sf_dir).select(*ENTRY_KEYS, F.explode("fields").alias("key", "value"))
    return own.select(*ENTRY_KEYS, "key", fields.whole_number(F.col("value")).alias("number"))


# --- E: filters, F: groups ----------------------------------------------------


def kept(**options) -> Query:
    def run(spark, sf_dir):
        made = query_lines(lines(spark, sf_dir), QueryOptions.of(**options), bags=False)
        return made.select(*ENTRY_KEYS, "eff_level", "is_cont")

    return run


def wheres(*tests: str) -> Query:
    def run(spark, sf_dir):
        e = entries(spark, sf_dir)
        return e.where(where_column(tuple(map(parse_predicate, tests)), archived(e))).select(*ENTRY_KEYS)

    return run


QUERIES["e1_level_floor"] = kept(level="WARN")
QUERIES["e2_grep"] = kept(level="TRACE", grep=("amber", r"timed out after \d+", "RelayHub"))
QUERIES["e3_exclude"] = kept(level="TRACE", exclude=("amber", r"timed out after \d+", "RelayHub"))
QUERIES["e4_where"] = wheres("level>=warn", "shard>=8", "logger!=sync")
QUERIES["e6_where_level"] = wheres("severity>info")
QUERIES["e6_where_level_name"] = wheres("level~=^(WARN|ERR)")
QUERIES["e7_where_time"] = wheres("ts>=2026-05-01", "time<2026-06-01T12:30")
QUERIES["e8_where_equal"] = wheres("shard==7.0")
QUERIES["e8_where_padded"] = wheres("shard==07")
QUERIES["e9_where_order"] = wheres("shard>7", "shard<=1.2e1")
QUERIES["e10_where_regex"] = wheres(r"message~=^(job|request) [0-9a-f]+", "logger~=e")
QUERIES["e11_where_missing"] = wheres("shard!=7")
QUERIES["f1_groups"] = kept(level="TRACE")
QUERIES["f2_group_filter"] = kept(level="INFO", grep=("price", "Error:", "table"), exclude=("wharf", "opal"), where=("level>=ERROR",))
QUERIES["f2_group_where"] = kept(level="DEBUG", where=("logger~=e", "level>=INFO"), exclude=("amber",))
QUERIES["f3_tail"] = kept(level="INFO", tail=3)
QUERIES["f3_tail_filtered"] = kept(level="WARN", grep=("price|timed",), tail=2)


@query
def e12_not_blank(spark, sf_dir):
    """Lines that are neither null nor blank."""
    return once(table(spark, sf_dir, "log_lines").where(~text.is_blank(F.col("raw"))), *ENTRY_KEYS).select(*ENTRY_KEYS)


@query
def f4_tail_digest(spark, sf_dir):
    """Levels of the last 5 entries of every stream."""
    return digest.level_counts(query_lines(lines(spark, sf_dir), QueryOptions.of("TRACE", tail=5), bags=False)).select("level", "level_name", "n")


# --- G: digest ----------------------------------------------------------------


@query
def g1_totals(spark, sf_dir):
    """Total of kept lines and their span (G4)."""
    return digest.totals(entries(spark, sf_dir))


@query
def g2_levels(spark, sf_dir):
    """Kept lines by level."""
    return digest.level_counts(entries(spark, sf_dir), "level")


@query
def g3_status_classes(spark, sf_dir):
    """Lines by HTTP status class, over access lines with their status as a field."""
    status = F.regexp_extract("raw", r'HTTP/[0-9.]+" ([0-9]{3})', 1)
    own = once(lines(spark, sf_dir), *ENTRY_KEYS).select(F.when(status != "", F.create_map(F.lit("status"), status)).alias("fields"))
    return digest.status_counts(own)


@query
def g5_top_templates(spark, sf_dir):
    """The five most frequent templates (a top-k report)."""
    return digest.top_templates(entries(spark, sf_dir))


@query
def g6_digest_lines(spark, sf_dir):
    """Levels of all raw lines with inherited levels, over all streams."""
    return digest.level_counts(query_lines(lines(spark, sf_dir), QueryOptions.of("TRACE"), bags=False)).select("level", "level_name", "n")


@query
def g11_sorted_fields(spark, sf_dir):
    """Fields of bags in order of keys."""
    own = decoded(spark, sf_dir).where(F.col("format") == "logfmt")
    pairs = F.transform(fields.sorted_pairs(F.col("fields")), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return own.select(*ENTRY_KEYS, F.array_join(pairs, "|").alias("pairs"))


# --- H, I: joins and unions ---------------------------------------------------


@query
def h1_containers(spark, sf_dir):
    """Containers with readiness and state."""
    own = table(spark, sf_dir, "container_statuses")
    return cluster.containers(own.select("namespace", "pod", "pos", "kind", "name"), own)


@query
def h2_events_of_pods(spark, sf_dir):
    """Events of pods that exist, without a limit."""
    return cluster.pod_events(table(spark, sf_dir, "pod_events"), table(spark, sf_dir, "pods"), None).select("event_id")


@query
def h4_selected_streams(spark, sf_dir):
    """Streams of the pods of one selector."""
    return cluster.selected_streams(table(spark, sf_dir, "pods"), table(spark, sf_dir, "streams"), "tier=edge").select("stream_id")


@query
def i1_merged_streams(spark, sf_dir):
    """Kept lines of all selected streams behind their labels."""
    own = sources.labelled_lines(lines(spark, sf_dir), table(spark, sf_dir, "pods"), table(spark, sf_dir, "streams"), SELECTOR)
    shown = query_lines(own, QueryOptions.of("ERROR"))
    return shown.where(F.col("format") == "text").select(*ENTRY_KEYS, sources.prefixed(F.col("label"), render.text_line(shown)).alias("line"))


@query
def i2_timeline(spark, sf_dir):
    """Logs, events and ends of containers of every pod in time."""
    own = timeline(entries(spark, sf_dir), table(spark, sf_dir, "streams"), table(spark, sf_dir, "pod_events"), table(spark, sf_dir, "container_statuses"), table(spark, sf_dir, "pods"), "level")
    return own.select("namespace", "pod", "ts_ns", "src_rank", "line")


@query
def i3_terminations(spark, sf_dir):
    """Ends of containers of the three kinds."""
    return cluster.terminations(table(spark, sf_dir, "container_statuses")).select("namespace", "pod", "name", "kind_rank", "previous", "exit_code")


# --- K: lines -----------------------------------------------------------------


@query
def k1_text_lines(spark, sf_dir):
    """Entries as text lines, with details by format (K2)."""
    return render.render(entries(spark, sf_dir), QueryOptions.of("TRACE"), "level").select(*ENTRY_KEYS, "line")


@query
def k3_ndjson(spark, sf_dir):
    """Entries as NDJSON."""
    return render.render(entries(spark, sf_dir), QueryOptions.of("TRACE", output="json"), "level").select(*ENTRY_KEYS, "line")


@query
def k4_digest(spark, sf_dir):
    """The digest as text."""
    said = digest.digest_text(entries(spark, sf_dir), "level")
    return spark.createDataFrame([(said,)], "digest string")


@query
def k5_event_lines(spark, sf_dir):
    """EVENT lines of all pods, without a limit."""
    return event_items(table(spark, sf_dir, "pod_events"), table(spark, sf_dir, "pods"), None).select("namespace", "pod", "ts_ns", "line")


@query
def k5_log_lines(spark, sf_dir):
    """LOG lines of all pods."""
    return log_items(entries(spark, sf_dir), table(spark, sf_dir, "streams"), "level").select("namespace", "pod", "ts_ns", "line")


@query
def k5_term_lines(spark, sf_dir):
    """TERM lines of all pods."""
    return termination_items(table(spark, sf_dir, "container_statuses")).select("namespace", "pod", "ts_ns", "line")


@query
def k5_notices(spark, sf_dir):
    """Notices of pods with more events than are read."""
    return notices(table(spark, sf_dir, "pod_events"), table(spark, sf_dir, "pods"))


@query
def k6_container_rows(spark, sf_dir):
    """Containers as rows of the table."""
    own = table(spark, sf_dir, "container_statuses")
    found = cluster.containers(own, own)
    return found.select("namespace", "pod", "pos", cluster.container_row(F.col("name"), F.col("kind"), F.col("ready"), F.col("status"), F.col("image")).alias("row"))


# --- L: following -------------------------------------------------------------


@query
def l1_follow(spark, sf_dir):
    """Kept lines of all streams as they arrive: the same rows as in a batch."""
    own = materialize(once(lines(spark, sf_dir), *ENTRY_KEYS).select(*ENTRY_KEYS, "raw"), "arriving")
    place = scratch(spark, "follow")
    arriving = spark.readStream.schema(own.schema).parquet(own.inputFiles()[0].rpartition("/")[0])
    start(follow(arriving, QueryOptions.of("WARN", exclude=("amber",))), f"{place}/out", f"{place}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{place}/out").select(*ENTRY_KEYS, "eff_level", "is_cont")
