import pytest
from pyspark.sql import functions as F

from logloom.operators.predicates import parse_predicate
from logloom.options import Config, QueryOptions, Target, load_config, output_format, since_start


@pytest.mark.parametrize(
    ("text", "want"),
    [("a==1", ("a", "==", "1")), ("a = b=c", ("a", "=", "b=c")), ("a>=b~=c", ("a", ">=", "b~=c")), ("msg~=x=>y", ("msg", "~=", "x=>y")), ("a!=", ("a", "!=", "")), ("a<b>c", ("a", "<", "b>c")), ("a = >5", ("a", "=", ">5"))],
)
def test_left_most_operator_longest_first(text, want):
    p = parse_predicate(text)
    assert (p.key, p.op, p.value) == want


@pytest.mark.parametrize("text", ["", "a", "==1", " ==1", "a~=(", "a~=(?=b)", "a~=a++", "<==5", "!~=x"])
def test_what_is_no_predicate(text):
    with pytest.raises(ValueError):
        parse_predicate(text)


ENTRY = {"level": 4, "message": "job 42 failed", "raw_line": "raw", "logger": "pay", "ts_ns": 1_782_295_200_000_000_000, "fields": {"status": "0500", "n": "500", "f": "5.0e2", "big": "9007199254740993", "Name": "x", "NAME": "y", "nan": "NaN", "a.b": "1", "empty": "", "neg": "-3", "word": "abc"}}
TRUTH = {
    "level==error": True, "level>=warn": True, "level>error": False, "severity!=info": True, "lvl==4": False, "level==50": True, "level==bogus": False, "level!=bogus": True, "level>bogus": False, "level~=^ERR": True,
    "msg~=^job [0-9]+": True, "message==job 42 failed": True, "log!=x": True, "logger==pay": True, "component==pay": True, "source~=p.y": True,
    "status==500": False, "status==0500": True, "n==500": True, "n==500.0": True, "n==5e2": True, "n=0500": False, "f==500": True, "big==9007199254740993": True, "big==9007199254740992": False,
    "n>499": True, "n>=500": True, "n<500": False, "n<=500": True, "word>1": False, "word<1": False, "n>abc": False, "status>499": True, "neg<0": True,
    "name==x": False, "NAME==y": True, "Name==x": True, "nAmE==y": True, "a.b==1": True, "A.B==1": False, "nan==NaN": True, "nan>0": False, "nan!=1": True, "n==nan": False, "n>nan": False,
    "missing==1": False, "missing!=1": True, "missing>1": False, "missing~=.*": False, "empty==": True, "empty!=x": True, "empty~=^$": True,
    "ts>=2026-06-24": True, "ts<2026-06-24T10:00": False, "time==2026-06-24T10:00:00Z": True, "timestamp!=2026-06-24 10:01": True, "@timestamp~=^2026-06-24T10:00:00Z$": True, "ts>noon": False, "ts==2026-06-24T12:00:00+02:00": True,
}


def test_truth_table(spark):
    df = spark.createDataFrame([ENTRY], "level int, message string, raw_line string, logger string, ts_ns bigint, fields map<string,string>")
    own = {k: F.col(k) for k in ENTRY}
    got = df.select(*[parse_predicate(t).column(own).alias(str(i)) for i, t in enumerate(TRUTH)]).first()
    assert {t: got[i] for i, t in enumerate(TRUTH)} == TRUTH


def test_missing_columns_of_an_entry(spark):
    df = spark.createDataFrame([(1, None, "raw", None, None, None)], "level int, message string, raw_line string, logger string, ts_ns bigint, fields map<string,string>")
    own = {c: F.col(c) for c in df.columns}
    truth = {"msg==raw": True, "logger==x": False, "logger!=x": True, "ts>2026-01-01": False, "ts!=2026-01-01": True, "ts==2026-01-01": False, "k==1": False, "k!=1": True}
    got = df.select(*[parse_predicate(t).column(own).alias(str(i)) for i, t in enumerate(truth)]).first()
    assert {t: got[i] for i, t in enumerate(truth)} == truth


def test_patterns_are_those_of_re2(spark):
    from logloom.operators.patterns import matches_any

    rows = ["a\n", "é12345678", "x\x0by", "a&b", "z", "x" * 400_000, None]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    found = lambda *p: [r.m for r in df.select(matches_any(df.r, p).alias("m")).collect()]
    assert found("^a$") == [False] * 7 and found(r"\b[0-9]{8}\b")[1] and not found(r"x\sy")[2]
    assert found("[a&&b]")[3] and found("[[:alpha:]]")[4] and found("x{1000}", "q")[5] and found("(?P<n>z)")[4]
    assert found() == [False] * 7


def test_options_that_contradict_each_other():
    with pytest.raises(ValueError):
        QueryOptions.of(stats=True, output="json")
    with pytest.raises(ValueError):
        QueryOptions.of(stats=True, fields=("a",))
    for bad in (dict(level="loud"), dict(grep=["("]), dict(exclude=["a++"]), dict(where=["a"]), dict(output="xml")):
        with pytest.raises(ValueError):
            QueryOptions.of(**bad)
    assert output_format(" NDJSON ") == "json" and output_format("plain") == "text"
    for bad in (
        {}, {"pod": "p", "selector": "s"}, {"pod": "p", "all_namespaces": True}, {"pod": "p", "all_containers": True, "container": "c"}, {"pod": "p", "timeline": True, "follow": True},
        {"pod": "p", "timeline": True, "all_containers": True}, {"selector": "s", "timeline": True}, {"pod": "p", "timeline": True, "stats": True}, {"pod": "p", "timeline": True, "fields": ("a",)},
        {"pod": "p", "timeline": True, "output": "json"}, {"pod": "p", "previous": True, "all_containers": True}, {"selector": "s", "previous": True}, {"pod": "p", "max_concurrency": 0},
    ):
        with pytest.raises(ValueError):
            Target(**bad).validate()
    assert Target(pod="p", timeline=True).validate().pod == "p" and Target(selector="a=b", all_namespaces=True).validate()


def test_since():
    assert since_start("", 5) is None and since_start("1h0.5s", 10**13) == 10**13 - 3601 * 10**9
    assert since_start("2026-06-24T10:00:00Z", 0) == 1_782_295_200_000_000_000
    for bad in ("-5m", "0s", "2026-06-24", "soon", "2026-06-24T10:00:00"):
        with pytest.raises(ValueError):
            since_start(bad, 0)


def test_config(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text("level: warn\ntheme: light\nfields:\n  level: [sev]\n  timestamp: [at]\n")
    config = load_config(str(path))
    assert config == Config(level="warn", theme="light", level_fields=("sev",), time_fields=("at",))
    assert config.level_or(None) == "warn" and config.level_or("info") == "info" and Config().level_or(None) == "DEBUG"
    assert config.names().json_level[-1] == "sev"
    assert load_config() == load_config(default=str(tmp_path / "none")) == Config()
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none"))
    for text in ("colour: x\n", "fields:\n  msg: [a]\n", "- a\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            load_config(str(path))
