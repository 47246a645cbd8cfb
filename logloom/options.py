"""What a query over log lines asks for, and which requests contradict themselves."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from logloom.functions.levels import word_level
from logloom.functions.names import DEBUG, DEFAULT_NAMES, FieldNames
from logloom.functions.times import since_seconds, text_time
from logloom.operators.patterns import check_pattern
from logloom.operators.predicates import Predicate, parse_predicate


def level_floor(text: str | int) -> int:
    """Level of a word or number; ValueError if it names none."""
    level = word_level(str(text))
    if level is None:
        raise ValueError(f"invalid level {text!r}")
    return level


def output_format(text: str) -> str:
    """``text`` or ``json`` of a name of an output format."""
    name = text.strip().lower()
    if name in ("", "text", "plain"):
        return "text"
    if name in ("json", "ndjson"):
        return "json"
    raise ValueError(f"unknown output format {text!r} (valid: text, json)")


@dataclass(frozen=True)
class QueryOptions:
    """Filters, projection and output of one query over log lines.

    ``tail`` counts entries after all filters; negative means no tail. Patterns are RE2;
    ``where`` holds predicates that all must hold. ``highlight`` marks include matches.
    """

    min_level: int = DEBUG
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    where: tuple[Predicate, ...] = ()
    project: tuple[str, ...] = ()
    output: str = "text"
    stats: bool = False
    highlight: bool = False
    tail: int = -1
    names: FieldNames = field(default=DEFAULT_NAMES)

    @staticmethod
    def of(level: str | int = "DEBUG", grep=(), exclude=(), where=(), fields=(), output="text", stats=False, highlight=False, tail=-1, names=DEFAULT_NAMES) -> QueryOptions:
        """Options from texts as a user writes them; ValueError for what is invalid."""
        made = QueryOptions(
            level_floor(level), tuple(map(check_pattern, grep)), tuple(map(check_pattern, exclude)), tuple(map(parse_predicate, where)),
            tuple(f.strip() for f in fields if f.strip()), output_format(output), stats, highlight, tail, names,
        )
        if made.stats and made.output != "text":
            raise ValueError("stats cannot be combined with another output than text: the digest is a text summary")
        if made.stats and made.project:
            raise ValueError("fields cannot be combined with stats: the digest replaces the lines")
        return made


@dataclass(frozen=True)
class Target:
    """Whose logs are asked for, and in which way."""

    pod: str = ""
    selector: str = ""
    container: str = ""
    namespace: str = ""
    all_namespaces: bool = False
    all_containers: bool = False
    previous: bool = False
    timeline: bool = False
    follow: bool = False
    stats: bool = False
    fields: tuple[str, ...] = ()
    output: str = "text"
    max_concurrency: int = 10

    def validate(self) -> Target:
        """Itself; ValueError for combinations that contradict each other."""
        rules = (
            (not self.pod and not self.selector, "provide a pod name or a selector"),
            (bool(self.pod and self.selector), "provide either a pod name or a selector, not both"),
            (self.all_namespaces and not self.selector, "all_namespaces requires a selector"),
            (bool(self.all_containers and self.container), "all_containers cannot be combined with container"),
            (self.timeline and self.follow, "timeline cannot be used with follow"),
            (self.timeline and self.all_containers, "all_containers cannot be combined with timeline"),
            (bool(self.timeline and self.selector), "selector cannot be combined with timeline"),
            (self.timeline and self.stats, "stats cannot be combined with timeline"),
            (bool(self.timeline and self.fields), "fields cannot be combined with timeline"),
            (self.timeline and self.output not in ("", "text"), f"output {self.output} cannot be combined with timeline"),
            (self.previous and self.all_containers, "previous cannot be combined with all_containers; select one container"),
            (bool(self.previous and self.selector), "previous cannot be combined with selector; select one pod and container"),
            (self.max_concurrency < 1, "max_concurrency must be at least 1"),
        )
        for broken, why in rules:
            if broken:
                raise ValueError(why)
        return self


def since_start(since: str, now_ns: int) -> int | None:
    """Earliest instant (ns) that ``since`` lets through: a duration before ``now_ns``, or an
    RFC 3339 time; None for an empty text."""
    if not since:
        return None
    try:
        return now_ns - since_seconds(since) * 10**9
    except ValueError:
        if (ts := text_time(since)) is not None and "T" in since and since[-1] in "Z0123456789" and ("Z" in since or since[-6:-5] in ("+", "-")):
            return ts
        raise ValueError(f"invalid since {since!r}: want a duration such as 5m, above 0, or an RFC 3339 time") from None


@dataclass(frozen=True)
class Config:
    """Defaults from a configuration file."""

    level: str = ""
    theme: str = ""
    color: str = ""
    level_fields: tuple[str, ...] = ()
    message_fields: tuple[str, ...] = ()
    time_fields: tuple[str, ...] = ()

    def names(self) -> FieldNames:
        """Field names with the aliases of the configuration."""
        return DEFAULT_NAMES.with_aliases(self.level_fields, self.message_fields, self.time_fields)

    def level_or(self, given: str | None, default: str = "DEBUG") -> str:
        """A level that was given, else the configured one, else the default."""
        return given or self.level or default


_ALIASES = {"level": "level_fields", "message": "message_fields", "timestamp": "time_fields"}


def load_config(path: str | None = None, default: str | None = None) -> Config:
    """Read a YAML configuration. A missing ``path`` is an error, a missing ``default`` is
    an empty configuration; so are unknown keys an error."""
    where = Path(path or default or "")
    if not path and (not default or not where.exists()):
        return Config()
    import yaml

    data = yaml.safe_load(where.read_text(encoding="utf-8")) or {}
    plain = {f.name for f in fields(Config)} - set(_ALIASES.values())
    if not isinstance(data, dict) or set(data) - plain - {"fields"} or set(data.get("fields") or {}) - set(_ALIASES):
        raise ValueError(f"parsing config {where}: unknown key")
    aliases = {_ALIASES[k]: tuple(map(str, v or ())) for k, v in (data.get("fields") or {}).items()}
    return Config(**{k: str(v or "") for k, v in data.items() if k in plain}, **aliases)
