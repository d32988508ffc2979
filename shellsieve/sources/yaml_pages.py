"""Documents in YAML: a stream cut at its ``---`` lines, or the front matter of pages.

Read are block mappings and sequences, plain and quoted scalars and literal or folded
blocks. All else (flow collections, anchors, tags, tabs as indent, repeated keys, text
over several lines without a block sign) is a reject with its reason, never a guess.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters and levels above which a document is a reject.
LONGEST, DEEPEST = 1_000_000, 40
_ENTRY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#&*!|>%@`\[\]{},?-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")
_BLOCK = re.compile(r"([|>])([+-]?)\s*(?:#.*)?$")


class Reject(ValueError):
    """Why a document is not read."""


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _idle(line: str) -> bool:
    return not line.strip() or line.lstrip().startswith("#")


def _scalar(raw: str) -> str | None:
    value = raw.strip()
    if value[:1] == '"' or value[:1] == "'":
        m = re.fullmatch(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?""", value)
        if not m:
            raise Reject("open quote")
        if value[0] == "'":
            return m[1][1:-1].replace("''", "'")
        try:
            return json.loads(m[1], strict=False)
        except ValueError:
            raise Reject("escape") from None
    value = re.split(r"(?:^|\s)#", value, maxsplit=1)[0].rstrip()
    if value[:1] and value[0] in "[{&*!|>%@`":
        raise Reject("unread form")
    if re.search(r":(\s|$)", value):
        raise Reject("mapping in a value")
    if re.match(r"[-?](\s|$)", value):
        raise Reject("item in a value")
    return None if value in ("", "~", "null") else value


class Lines:
    """A document's lines and the one to be read next."""

    def __init__(self, text: str) -> None:
        self.lines, self.i = re.split(r"\r?\n", text), 0
        if not self.lines[-1]:
            self.lines.pop()

    def peek(self) -> str | None:
        while self.i < len(self.lines) and _idle(self.lines[self.i]):
            self.i += 1
        if self.i == len(self.lines):
            return None
        if "\t" in self.lines[self.i][:len(self.lines[self.i]) - len(self.lines[self.i].lstrip())]:
            raise Reject("tab as indent")
        return self.lines[self.i]

    def body(self, sign: str, chomp: str, parent: int) -> str:
        """The literal or folded block below a line that is indented by ``parent``."""
        taken: list[str] = []
        while self.i < len(self.lines) and (not self.lines[self.i].strip() or _indent(self.lines[self.i]) > parent):
            taken.append(self.lines[self.i])
            self.i += 1
        margin = min((_indent(x) for x in taken if x.strip()), default=0)
        text = "\n".join(x[margin:] for x in taken)
        kept = text.rstrip("\n")
        if sign == ">":
            kept = re.sub(r"(?<!\n)\n(?=[^\n ])", " ", kept)
        return kept if chomp == "-" or not kept else kept + "\n" * (1 + len(text) - len(text.rstrip("\n")) if chomp == "+" else 1)

    def value(self, raw: str | None, indent: int, depth: int):
        """What follows a ``key:`` or ``-`` that is indented by ``indent``."""
        if raw and (m := _BLOCK.match(raw)):
            return self.body(m[1], m[2], indent)
        if raw and not raw.startswith("#"):
            found = _scalar(raw)
            below = self.peek()
            if below is not None and _indent(below) > indent:
                raise Reject("value over several lines")
            return found
        below = self.peek()
        if below is not None and _indent(below) > indent:
            return self.node(_indent(below), depth + 1)
        return None

    def node(self, indent: int, depth: int = 0):
        """The mapping, list or scalar whose lines are indented by ``indent``."""
        if depth > DEEPEST:
            raise Reject("too deep")
        out = None
        while (line := self.peek()) is not None and _indent(line) == indent:
            text = line.strip()
            dash = re.match(r"-(?:(\s+)(.*))?$", text)
            if dash and not isinstance(out, dict):
                out = [] if out is None else out
                inner = indent + 1 + len(dash[1] or "")
                if dash[2] and (_ENTRY.match(dash[2]) or re.match(r"-\s", dash[2])):
                    self.lines[self.i] = " " * inner + dash[2]
                    out.append(self.node(inner, depth + 1))
                else:
                    self.i += 1
                    out.append(self.value(dash[2], indent, depth))
                continue
            entry = _ENTRY.match(text)
            if not entry or dash or isinstance(out, list):
                if dash is None and isinstance(out, list) and entry:
                    break  # a list at the indent of its key ends at the next key
                raise Reject("neither entry nor item")
            out = {} if out is None else out
            key = _scalar(entry[1]) if entry[1][0] in "\"'" else entry[1]
            if key in out:
                raise Reject("repeated key")
            self.i += 1
            below = self.peek() if not entry[2] else None
            listed = below is not None and _indent(below) == indent and re.match(r"-(\s|$)", below.strip())
            out[key] = self.node(indent, depth + 1) if listed else self.value(entry[2], indent, depth)
        if line is not None and _indent(line) > indent:
            raise Reject("indent")
        return out


def front_part(text: str) -> str:
    """What stands between the first two ``---`` lines of a page; the text itself where it begins with none."""
    m = re.match(r"\ufeff?---[ ]*\r?\n(.*?)(?:^(?:---|\.\.\.)[ ]*\r?$|\Z)", text, re.S | re.M)
    return m[1] if m else text


def to_json(text: str | None) -> tuple[str | None, str | None]:
    """(JSON of the document's mapping, reason of its rejection); one of both is None."""
    if text is None or not text.strip():
        return None, "empty"
    if len(text) > LONGEST:
        return None, "too long"
    lines = Lines(front_part(text))
    try:
        first = lines.peek()
        out = lines.node(_indent(first)) if first is not None else None
        if lines.peek() is not None:
            raise Reject("indent")
    except Reject as e:
        return None, str(e)
    return (json.dumps(out, ensure_ascii=False), None) if isinstance(out, dict) else (None, "no mapping")


def yaml_json(text: Column) -> Column:
    """Struct (value, reject) of ``to_json``; scalars stay text."""
    @F.pandas_udf("value string, reject string")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([to_json(t) for t in texts], columns=["value", "reject"])

    return read(text)


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """``_source_file, text``: the documents of YAML streams; Spark cuts long files at their ``---`` lines."""
    return spark.read.option("lineSep", "\n---\n").text(path).select(F.col("_metadata.file_path").alias("_source_file"), F.col("value").alias("text"))
