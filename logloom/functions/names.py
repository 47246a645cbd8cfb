"""Fixed values of the log vocabulary: field names, level words, time layouts' parts.

Field lists are in order of priority. ``FieldNames`` carries them as a parameter, so a
caller can add names of its own without touching global state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

LEVEL_NAMES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(6)

# Names of the level, message and time fields of JSON objects.
JSON_LEVEL = ("level", "severity", "log_level", "loglevel", "log.level", "severity_text", "severityText", "@level", "levelname", "LEVEL")
JSON_MESSAGE = ("message", "msg", "log", "text", "body", "@message", "MESSAGE")
JSON_TIME = ("time", "timestamp", "@timestamp", "ts", "Time", "TIME", "datetime")
# The same for logfmt lines, and their logger names.
LOGFMT_LEVEL = ("level", "severity", "log_level", "lvl")
LOGFMT_MESSAGE = ("msg", "message", "log")
LOGFMT_LOGGER = ("component", "logger", "logger_name", "source")
LOGFMT_TIME = ("time", "timestamp", "ts", "@timestamp")
# Attribute names of XML elements.
XML_LOGGER = ("logger", "name", "source", "category")
XML_TIME = ("time", "timestamp", "ts", "date")
XML_MESSAGE = ("message", "msg")
# Fields that show an HTTP request, and those that hold its status.
HTTP_CONTEXT = (
    "method", "path", "route", "uri", "url", "request", "request.method", "request.path", "requestMethod", "requestPath",
    "controller", "action", "http.method", "http.route", "http.target", "http.url",
)
HTTP_STATUS = ("status", "status_code", "statusCode", "http.status_code", "response.status", "response.status_code", "responseStatusCode")
# Keys of predicates and projections that mean a column of the entry.
MESSAGE_KEYS = ("message", "msg", "log")
LOGGER_KEYS = ("logger", "component", "source")
TIME_KEYS = ("timestamp", "ts", "time", "@timestamp")
LEVEL_KEYS = ("level", "lvl", "severity")
# Words that a CSV column must be to be its level.
LEVEL_WORDS = ("TRACE", "VERBOSE", "FINEST", "DEBUG", "FINE", "INFO", "INFORMATION", "NOTICE", "WARN", "WARNING", "ERROR", "ERR", "CRITICAL", "CRIT", "FATAL", "PANIC")


def _longer(base: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*base, *(m for m in more if m)]))


@dataclass(frozen=True)
class FieldNames:
    """Names under which level, message and time are looked up."""

    json_level: tuple[str, ...] = JSON_LEVEL
    json_message: tuple[str, ...] = JSON_MESSAGE
    json_time: tuple[str, ...] = JSON_TIME
    logfmt_level: tuple[str, ...] = LOGFMT_LEVEL
    logfmt_message: tuple[str, ...] = LOGFMT_MESSAGE
    logfmt_time: tuple[str, ...] = LOGFMT_TIME

    def with_aliases(self, level: tuple[str, ...] = (), message: tuple[str, ...] = (), time: tuple[str, ...] = ()) -> FieldNames:
        """These names and, after them, those of a team's own; built-in ones come first."""
        return replace(
            self,
            json_level=_longer(self.json_level, level),
            json_message=_longer(self.json_message, message),
            json_time=_longer(self.json_time, time),
            logfmt_level=_longer(self.logfmt_level, level),
            logfmt_message=_longer(self.logfmt_message, message),
            logfmt_time=_longer(self.logfmt_time, time),
        )

    @property
    def shown_elsewhere(self) -> tuple[str, ...]:
        """Fields, in small letters, that the entry's own columns already show."""
        return tuple(dict.fromkeys(n.lower() for n in self.json_level + self.json_time + self.json_message))


DEFAULT_NAMES = FieldNames()
