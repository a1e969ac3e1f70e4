"""Names of change scripts: patterns to regular expressions, parsing and making names, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMPS = {"YYYY": r"\d{4}", "MM": r"\d{2}", "DD": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "SS": r"\d{2}"}


@dataclass(frozen=True)
class Naming:
    """How scripts are named: `pattern` of {prefix}, {timestamp} and {description}; `timestamp` a date format or `NNNN`."""

    pattern: str = "{timestamp}__{description}.sql"
    timestamp: str = "YYYYMMDD_HHMMSS"
    prefix: str = ""

    @property
    def is_serial(self) -> bool:
        return re.fullmatch("N+", self.timestamp) is not None

    def timestamp_regex(self) -> str:
        if self.is_serial:
            return rf"\d{{{len(self.timestamp)}}}"
        out = re.escape(self.timestamp)
        for token, digits in _STAMPS.items():
            out = out.replace(token, digits)
        return out

    def regex(self) -> str:
        """A whole name; groups: prefix, timestamp, description."""
        groups = {"{prefix}": f"({re.escape(self.prefix)})", "{timestamp}": f"({self.timestamp_regex()})", "{description}": "(.+)"}
        parts = re.split(r"(\{prefix\}|\{timestamp\}|\{description\})", self.pattern)
        return "^" + "".join(groups.get(p, re.escape(p)) for p in parts) + "$"

    def _group(self, name: str) -> int:
        order = re.findall(r"\{(prefix|timestamp|description)\}", self.pattern)
        return order.index(name) + 1 if name in order else 0

    def parsed(self, name: Column) -> Column:
        """A struct of full_name, prefix, timestamp, description, sort_key; null where the name doesn't fit."""
        part = lambda group: F.regexp_extract(name, self.regex(), self._group(group)) if self._group(group) else F.lit("")
        fields = [name.alias("full_name"), part("prefix").alias("prefix"), part("timestamp").alias("timestamp"), part("description").alias("description"), part("timestamp").alias("sort_key")]
        return F.when(name.rlike(self.regex()), F.struct(*fields))

    def stamp(self, at: Column) -> Column:
        """A timestamp's text; in date formats the second MM is the minute."""
        return F.date_format(at, self.timestamp.replace("YYYY", "yyyy").replace("DD", "dd").replace("HHMMSS", "HHmmss").replace("SS", "ss"))

    def name(self, timestamp: Column, description: Column) -> Column:
        """A file name from its parts: no leading underscores, and no more than two in a row."""
        template = self.pattern.replace("{prefix}", self.prefix)
        out = F.replace(F.replace(F.lit(template), F.lit("{timestamp}"), timestamp), F.lit("{description}"), description)
        return F.regexp_replace(F.regexp_replace(out, "^_+", ""), "_{3,}", "__")


def next_serial(stamps: Column, width: int) -> Column:
    """An aggregate: the serial after the largest, padded with zeros and never cut."""
    following = (F.coalesce(F.max(stamps.try_cast("bigint")), F.lit(0)) + 1).cast("string")
    return F.lpad(following, F.greatest(F.lit(width), F.length(following)), "0")


def short_name(name: Column) -> Column:
    """A file name without its time and its ending."""
    return F.regexp_replace(F.regexp_replace(name, r"\.sql$", ""), r"^\d{8}_\d{6}__", "")


def padded(label: Column, width: int) -> Column:
    """A label with spaces up to a width, never cut."""
    return F.rpad(label, F.greatest(F.lit(width), F.length(label)), " ")
