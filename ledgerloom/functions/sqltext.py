"""SQL text: one lexer for fingerprints and statements, and directives in comments.

Fingerprints ignore comments and the amount of white space, but nothing inside quotes. The lexer follows PostgreSQL:
`--` and nested `/* */` comments, 'x' with doubled quotes, "x" likewise, E'x' with backslashes, $tag$x$tag$. What is not
closed runs to the end. A quirk kept on purpose: any e or E just before a quote starts an escape string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.storage import importable

_SPACE = re.compile(r"[\s﻿]+")
#: What begins at a place: each kind a group, tried in this order. Text outside quotes comes in runs, semicolons alone.
_TOKEN = re.compile(
    r"""(?P<comment>--[^\n]*|/\*)
    |(?P<quoted>'(?:[^']|'')*+(?:'|\Z)|"(?:[^"]|"")*+(?:"|\Z)|[eE]'(?:[^'\\]|\\.|'')*+(?:'|\\?\Z)|(?P<tag>\$[A-Za-z0-9_]*\$)(?:.*?(?P=tag)|.*\Z))
    |(?P<space>[\s﻿]+)
    |(?P<other>(?:[^\s﻿'"$/;eE-]|[eE](?!')|-(?!-)|/(?!\*)|\$(?![A-Za-z0-9_]*\$))+|.)""",
    re.S | re.X,
)
_NESTED = re.compile(r"/\*|\*/")


def tokens(sql: str) -> Iterator[tuple[str, str]]:
    """(kind, text) in order; kinds: comment, quoted, space, other (runs of text; semicolons one by one)."""
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        kind, end = m.lastgroup if m.lastgroup != "tag" else "quoted", m.end()
        if m["comment"] == "/*":  # comments nest
            depth = 1
            for mark in _NESTED.finditer(sql, end):
                depth += 1 if mark[0] == "/*" else -1
                end = mark.end()
                if not depth:
                    break
            if depth:
                end = len(sql)
        yield kind, sql[at:end]
        at = end


def normalize(sql: str | None) -> str:
    """Without comments, white space outside quotes as single spaces, none at the ends."""
    out: list[str] = []
    for kind, text in tokens(sql or ""):
        if kind in ("comment", "space"):
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(text)
    return _SPACE.sub(" ", "".join(out)[:1]).lstrip() + "".join(out)[1:].rstrip() if out else ""


@F.pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


def normalized(sql: Column) -> Column:
    """Texts without quotes, comment marks and dollars need no lexer: those stay on the JVM, and the lexer gets nulls."""
    if session := SparkSession.getActiveSession():
        importable(session)
    plain = F.trim(F.regexp_replace(sql, r"[\s\p{Z}\x{FEFF}]+", " "))
    marked = sql.rlike(r"--|/\*|['\"$]")
    return F.when(marked, _normalized(F.when(marked, sql))).otherwise(plain)


def checksum(sql: Column) -> Column:
    return F.sha2(normalized(sql), 256)


def allowed_rules(sql: Column, tool: str = "loom") -> Column:
    """Rule ids from `-- <tool>:allow a, b` comments, one array."""
    lines = F.regexp_extract_all(sql, F.lit(rf"(?m)^--\s*{tool}:allow\s+(.+)$"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"[,\s]+"))), lambda x: x != ""))


def declared_dependencies(sql: Column, tool: str = "loom") -> Column:
    """File names from `-- <tool>:depends-on file` comments, one array."""
    return F.regexp_extract_all(sql, F.lit(rf"(?m)^--\s*{tool}:depends-on\s+(\S+)"), F.lit(1))
