import json
import re

import pytest
from pyspark.sql import functions as F

from logloom.operators.digest import digest_text
from logloom.operators.grouping import query_lines
from logloom.operators.render import color_mode, colored_line, highlighted, render, theme
from logloom.options import QueryOptions
from logloom.version import version_text

T = "2026-06-24T10:00:00Z"
LINES = [
    '{"level":"error","msg":"disk full","ts":"%s","logger":"store","pct":99.50,"n":12345678901234567890123,"ok":true,"gone":null,"at":{"b":1,"a":"x y"},"l":[1,"z"]}' % T,
    '{"level":"info","n":1}',
    "{level: warn, msg: hi, n: 1.5}",
    f'time={T} level=warn msg="a b" path="/x y" empty= k=v',
    f"[{T}] [ERROR] [web] failed to bind port=80",
    '<log level="info" message="hi" user="a,b"/>',
    f"{T} ERROR boom \x1b[31m",
    "plain",
    '{"msg":"<a> & b","level":"info"}',
    "level=info k=1",
]
TEXT = [
    "[2026-06-24 10:00:00] [ERROR] [store] disk full at={a=\"x y\" b=1} gone=null l=[1 z] n=12345678901234567890123 ok=true pct=99.50",
    "[INFO] n=1",
    "[WARN] [logrus] hi n=1.50",
    '[2026-06-24 10:00:00] [WARN] a b empty="" k=v path="/x y"',
    "[2026-06-24 10:00:00] [ERROR] failed to bind port=80",
    '[INFO] hi user="a,b"',
    "[2026-06-24 10:00:00] [ERROR] boom \\x1B[31m",
    "[DEBUG] plain",
    "[INFO] [logrus] <a> & b",
    "[INFO] k=1",
]


@pytest.fixture(scope="module")
def kept(spark):
    df = spark.createDataFrame([("s", i, line) for i, line in enumerate(LINES)], "stream_id string, line_no bigint, raw string")
    return query_lines(df, QueryOptions.of("TRACE")).cache()


def shown(kept, **options):
    return [r.line for r in render(kept, QueryOptions.of("TRACE", **options)).orderBy("line_no").collect()]


def test_text_lines(kept):
    assert shown(kept) == TEXT


def test_ndjson(kept):
    lines = shown(kept, output="json")
    made = [json.loads(x) for x in lines]
    assert lines[0] == '{"time":"%s","level":"ERROR","logger":"store","message":"disk full","format":"json","fields":{"at":{"a":"x y","b":1},"gone":null,"l":[1,"z"],"logger":"store","n":12345678901234567890123,"ok":true,"pct":99.50}}' % T
    assert made[3]["fields"] == {"empty": "", "k": "v", "path": "/x y"} and made[7] == {"level": "DEBUG", "message": "plain", "format": "text"}
    assert "\\u003ca\\u003e \\u0026 b" in lines[8] and made[6]["message"] == "boom \\x1B[31m"


def test_projections(kept):
    assert shown(kept, fields=("n", "msg", "k")) == ['n=12345678901234567890123 msg="disk full"', 'n=1 msg="{""level"":""info"",""n"":1}"'.replace('""', '"'), "n=1.50 msg=hi", 'msg="a b" k=v', 'msg="failed to bind"', "msg=hi", 'msg="boom \\x1B[31m"', "msg=plain", 'msg="<a> & b"', 'msg="level=info k=1" k=1']
    assert shown(kept, fields=("k", "port")) == ["k=v", "port=80", "k=1"]
    assert shown(kept, fields=("pct", "level", "at.a"), output="json")[0] == '{"at.a":"x y","level":"ERROR","pct":99.50}'
    assert shown(kept, fields=("nothing",)) == [] == shown(kept, fields=("nothing",), output="json")
    texts, objects = shown(kept, fields=("level", "ts")), shown(kept, fields=("level", "ts"), output="json")
    assert len(texts) == len(objects) == len(LINES) and texts[0] == "level=ERROR ts=2026-06-24 10:00:00" and objects[0] == '{"level":"ERROR","ts":"%s"}' % T


def test_digest(kept):
    said = digest_text(kept, raw_line=F.col("raw_line")).splitlines()
    assert said[1] == "lines: 10   span: 2026-06-24 10:00:00 → 2026-06-24 10:00:00" and said[2] == "levels: ERROR 3  WARN 2  INFO 4  DEBUG 1"
    assert said[3] == "top messages:" and said[4] == "      2  hi" and len(said) == 9
    assert digest_text(kept.where("false")) == "── stats ──\nlines: 0\n"


def test_colors_only_add_escapes(kept):
    lines = [r.line for r in kept.withColumn("line", colored_line(kept)).orderBy("line_no").collect()]
    assert [re.sub("\x1b\\[[0-9;]*m", "", x) for x in lines] == TEXT and all("\x1b[" in x for x in lines)
    assert theme("LIGHT")["value"] == "30" and theme("auto") == theme("dark") and color_mode(" on ") == "always" and color_mode("none") == "never" and color_mode("") == "auto"
    for bad in (lambda: theme("blue"), lambda: color_mode("maybe")):
        with pytest.raises(ValueError):
            bad()


def test_highlights():
    on, off = "\x1b[7m", "\x1b[27m"
    mark = lambda text, *p: highlighted(text, [re.compile(x) for x in p])
    assert mark("abcd", "bc") == f"a{on}bc{off}d" and mark("abcd", "ab", "bc", "d") == f"{on}abcd{off}" and mark("abc", "x*") == "abc"
    assert mark("\x1b[36mm36\x1b[0m", "36", "m") == f"\x1b[36m{on}m36{off}\x1b[0m"


def test_highlighted_query(kept):
    assert shown(kept, grep=["boom"], highlight=True)[6].count("\x1b[7mboom\x1b[27m") == 1


def test_version():
    assert version_text(short=True) in version_text() and json.loads(version_text("json"))["version"] == version_text(short=True) and version_text("yaml").startswith("version: ")
    with pytest.raises(ValueError):
        version_text("xml")
