"""Text expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: everything Python's str.split()/strip() counts as whitespace,
# the blank itself apart. Java's \\s is narrower, so the set is spelled out.
OTHER_WS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Without the four separators that only Python counts: Unicode White_Space.
UNICODE_WS = OTHER_WS.translate(dict.fromkeys(range(0x1C, 0x20)))
# The first set inside a regex class.
WS_CLASS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CLASS}]"

# The three masking patterns and their replacements, in order.
MASKS = (
    (rf"(?iu)https?://[^{WS_CLASS}'\"`;|)]+", "http://example.com"),
    (r"(?U)(?=\d)(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?!\w)", "1.1.1.1"),
    (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/])", "BASE64"),
)

# Fixed value: ASCII punctuation that splits tokens.
PUNCT = r"!-/:-@\[-`{-~"
# The same signs and blanks for long scans: Java looks signs below 256 up in one bit set, but tries each range and each other sign in turn.
_SIGNS = "".join(f"\\x{c:02x}" for c in range(0x21, 0x7F) if not chr(c).isalnum())
_BLANKS = "".join(f"\\x{{{ord(c):x}}}" for c in " " + UNICODE_WS if not "\u2000" <= c <= "\u200a") + r"\x{2000}-\x{200a}"


def strip(c: Column) -> Column:
    """Trim both ends of every character Python's ``strip()`` would remove."""
    return F.btrim(c, F.lit(" " + OTHER_WS))


def squeeze(c: Column) -> Column:
    """``" ".join(s.split())``: one blank between words, none at the ends.

    Mapping every whitespace to a blank first leaves a regex that only has to
    touch runs of blanks, which is about twice as fast as a class of them all.
    """
    return F.trim(F.regexp_replace(F.translate(c, OTHER_WS, " " * len(OTHER_WS)), "  +", " "))


def python_regex(pattern: str, ignore_case: bool = True) -> str:
    r"""A pattern with Python's meaning of ``.``, ``\s``, ``\w`` and ignore-case.

    ``d`` lets only a line feed end a line; ``U`` makes the classes Unicode.
    """
    flags = "(?idU)" if ignore_case else "(?dU)"
    return flags + pattern.replace(r"\s", WS).replace(r"\S", f"[^{WS_CLASS}]")


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c, F.lit("")).rlike(python_regex(pattern, ignore_case))


def mask(c: Column) -> Column:
    """Replace URLs, IPv4 addresses and long base64 runs by fixed placeholders."""
    for pattern, replacement in MASKS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def basic_tokens(c: Column) -> Column:
    """Words and single ASCII punctuation marks; only ASCII letters are lowered."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate(c, upper + UNICODE_WS, lower + " " * len(UNICODE_WS))
    spaced = F.regexp_replace(plain, f"([{PUNCT}])", " $1 ")
    return F.array_remove(F.split(spaced, " "), "")


def token_chunks(c: Column) -> Column:
    """The original text cut at the starts of its basic tokens: each part is a token with the blanks after it."""
    word = f"(?:[0-9A-Za-z]++|[^{_SIGNS}{_BLANKS}])++"
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?:[{_SIGNS}]|{word})[{_BLANKS}]*+"), F.lit(0))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n")


def all_lines(c: Column) -> Column:
    """Lines ended by any line end that Unicode knows, as ``str.splitlines`` cuts them."""
    return F.split(c, "\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]")


def json_object_text(c: Column) -> Column:
    """The outermost ``{...}`` of a chatty or fenced answer, null without one.

    A text that starts with a fence is narrowed to the first fenced part.
    """
    body = strip(c)
    fenced = F.when(body.startswith("```"), F.split(body, "```").getItem(1)).otherwise(body)
    found = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    return F.when(F.length(found) > 0, found)


def lenient_json(c: Column, schema: str) -> Column:
    """Parse the object found by ``json_object_text``; anything else is null."""
    return F.from_json(json_object_text(c), schema, {"mode": "PERMISSIVE"})


def fingerprint(c: Column) -> Column:
    """sha1 of the stripped text: the key of every leakage check."""
    return F.sha1(strip(c))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
