"""Fuzzy search for short licence notices.

A notice with ``k`` allowed edits is cut into ``k + 1`` pieces: wherever it occurs
with at most ``k`` edits, one piece is there unchanged. One automaton finds all
pieces of all notices; around each hit the ``regex`` library looks for the whole
notice with at most ``k`` errors and tells span and edits. Exact phrases, counted
at every place, are the base that the fuzzy part adds to.

The search sees the words of the whole text (``common.words``) joined by one blank.
"""


from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import free_name, words


@dataclass(frozen=True)
class Notice:
    """``fixed`` phrases tell the licence from its siblings, so they must stand there word for word, in this order."""
    label: str
    text: str
    edits: int
    fixed: tuple[str, ...] = ()


#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices searched with errors; edits are inserted, deleted or replaced characters outside of the fixed phrases.
NOTICES = (
    Notice("mit", "released under the mit license", 3, ("mit",)),
    Notice("mit", "licensed under the mit license", 3, ("mit",)),
    Notice("mit", "distributed under the mit license", 3, ("mit",)),
    Notice("apache-2", "licensed under the apache license version 2 0", 4, ("apache", "2 0")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, ("cc by nc 4",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2, ("cc by sa 4",)),
    Notice("gpl-3", "licensed under the gnu general public license version 3", 5, ("gnu general public", "3")),
    Notice("lgpl", "licensed under the gnu lesser general public license", 5, ("lesser",)),
    Notice("mpl-2", "subject to the terms of the mozilla public license", 5, ("mozilla",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7, ("redistribution", "source", "binary")),
    Notice("isc", "permission to use copy modify and or distribute this software", 6, ("permission to use", "distribute")),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6, ("unencumbered",)),
)

#: Spans on either side that may overlap one: those of all notices at each place of it.
NEAR = 1_000
SPAN = "label string, start int, end int, edits int, text string"
RESULT = (f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          f"score double, spans array<struct<{SPAN}>>")


def pieces(notice: Notice) -> list[tuple[str, int]]:
    """The notice in ``edits + 1`` nearly equal parts, each with its offset."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(notice.text[a:b], a) for a, b in zip(cuts, cuts[1:])]


def pattern_of(notice: Notice) -> str:
    """The notice as a pattern of the ``regex`` library: fixed phrases as whole words, errors between them."""
    import regex
    out, rest = ["(?b)"], notice.text
    for phrase in notice.fixed:
        before, found, rest = rest.partition(phrase)
        if not found:
            raise ValueError(f"{phrase!r} is not in this place of {notice.text!r}")
        out.append(f"(?:{regex.escape(before)}){{e<={notice.edits}}}(?<![^ ]){regex.escape(phrase)}(?![^ ])")
    return "".join(out) + (f"(?:{regex.escape(rest)}){{e<={notice.edits}}}" if rest else "")


class Searcher:
    """Compiled phrases and notices; one per task."""

    def __init__(self, phrases=PHRASES, notices=NOTICES) -> None:
        import ahocorasick
        import regex
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        self.notices = list(notices)
        found: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for piece, offset in pieces(notice):
                found.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(pattern_of(n)) for n in self.notices]

    def places(self, line: bytes) -> list[tuple[int, str]]:
        """(first word, label) of every exact phrase; ``line`` starts and ends with a blank."""
        out = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                out.append((line.count(b" ", 0, at), label))
                at = line.find(phrase, at + 1)
        return out

    def windows(self, line: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the windows in which an occurrence may lie, none longer than a few notices."""
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.seeds.iter(line):
            for i, offset in uses:
                starts.setdefault(i, set()).add(end + 1 - size - offset)
        out: dict[int, list[tuple[int, int]]] = {}
        for i, found in starts.items():
            k, n = self.notices[i].edits, len(self.notices[i].text)
            first = last = None
            for at in sorted(found):
                if first is not None and at - first <= 2 * k:
                    last = at
                    continue
                if first is not None:
                    out.setdefault(i, []).append((first, last))
                first = last = at
            out.setdefault(i, []).append((first, last))
            out[i] = [(max(0, a - k), b + n + k) for a, b in out[i]]
        return out

    def spans(self, line: str) -> list[tuple[str, int, int, int, str]]:
        """(label, start, end, edits, text, score) of the best match in every window; of overlapping ones the labels with fewest edits."""
        out = {}
        for i, windows in self.windows(line).items():
            notice, pattern = self.notices[i], self.patterns[i]
            for a, b in windows:
                m = pattern.search(line, a, min(b, len(line)))
                edits = sum(m.fuzzy_counts) if m else 0
                if m and edits <= notice.edits:  # each part may have them all, together they may not
                    span = (notice.label, m.start(), m.end())
                    if span not in out or edits < out[span][0]:
                        out[span] = (edits, m.group(), 1 - edits / len(notice.text))
        rows = [(*span, edits, text, score) for span, (edits, text, score) in sorted(out.items(), key=lambda x: x[0][1:])]
        longest = max((r[2] - r[1] for r in rows), default=0)

        def beaten(i: int) -> bool:
            label, start, end, edits = rows[i][:4]
            near = [*takewhile(lambda o: o[1] > start - longest, reversed(rows[max(0, i - NEAR):i])), *takewhile(lambda o: o[1] < end, rows[i + 1:i + 1 + NEAR])]
            return any(o[0] != label and o[3] < edits and o[2] > start for o in near)

        return [r for i, r in enumerate(rows) if not beaten(i)]

    def __call__(self, text: str | None) -> tuple:
        found = words(text)
        line = b" ".join(found)
        base = sorted(self.places(b" " + line + b" "))
        spans = self.spans(line.decode("utf-8"))
        own = {label for _, label in base}
        score = 1.0 if base else max((s[-1] for s in spans), default=0.0)
        return (len(found), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), max(0.0, score),
                [s[:-1] for s in spans])


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES, out: str = "licence") -> DataFrame:
    """``docs`` with one struct column ``out`` (fields of ``RESULT``), named so that it clashes with no column.

    Row by row, nothing is shuffled; other columns stay in the JVM. A text of any
    length is searched whole, in windows of a few notices. Null text
    counts as empty: no words, no places, empty labels, score 0. ``first_word``
    and ``last_word`` are null without a base phrase. Repeated rows get equal results.
    """
    names = [x.split()[0] for x in RESULT.split(", spans")[0].split(", ")] + ["spans"]

    @F.pandas_udf(RESULT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(phrases, notices)
        for series in batches:
            rows = [searcher(t) for t in series]
            yield pd.DataFrame({
                name: pd.Series([r[i] for r in rows], dtype="Int64" if i < 4 else "float64" if i == 6 else "object")
                if name != "spans" else pd.Series([[dict(zip(("label", "start", "end", "edits", "text"), s)) for s in r[i]] for r in rows], dtype="object")
                for i, name in enumerate(names)})

    return docs.withColumn(free_name(docs, out), search(F.col(text)))
