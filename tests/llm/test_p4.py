import re
from collections import defaultdict
from datetime import UTC, datetime

import __spark_entry__ as driver
from logloom.runtime import table


def said(text):
    words = [w for w in re.split(r"\s+", text.lower()) if w and not re.search(r"\d", w)]
    return " ".join(words)


def micros(at):
    d = at.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def runs(src, seqs):
    """seqs: key -> rows (order, number, what it says or None, microseconds or None, weight)."""
    for key, rows in seqs.items():
        rows, i = sorted(set(rows), key=lambda r: r[:2]), 0
        while i < len(rows):
            j = i + 1
            while rows[i][2] is not None and j < len(rows) and rows[j][2] == rows[i][2]:
                j += 1
            times = [r[3] for r in rows[i:j] if r[3] is not None]
            if j - i > 1:
                yield (src, key, rows[i][1], rows[j - 1][1], j - i, sum(r[4] for r in rows[i:j]), times[-1] - times[0] if times else 0)
            i = j


def test_p4_gives_the_runs_of_both_sources(spark, small):
    streams, objects = defaultdict(list), defaultdict(list)
    for r in table(spark, small, "entries").collect():
        says = said(r.message) if r.message and r.message.strip() else None
        streams[r.stream_id].append((r.line_no, r.line_no, says, micros(r.ts) if r.ts else None, 1))
    for r in table(spark, small, "pod_events").collect():
        at = micros(next(t for t in (r.event_time, r.last_ts, r.first_ts, r.created_ts) if t))
        says = ((r.reason or "").lower(), said(r.message)) if r.message and r.message.strip() else None
        times = r.series_count if (r.series_count or 0) > 0 else r["count"] if (r["count"] or 0) > 0 else 1
        objects[f"{r.namespace}/{r.object_name}"].append((at, r.event_id, says, at, times))
    want = sorted([*runs("entry", streams), *runs("event", objects)])
    got = driver.queries()["p4_found"](spark, small)
    assert got.columns == ["src", "seq_key", "first_no", "last_no", "n_rows", "n_total", "duration_us"]
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"entry", "event"}
