"""Text and markdown functions.  All are built from JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that end a line.
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
#: Fixed value: a word in any script.
WORD_CHAR = "[\\p{L}\\p{N}_]"
TOKEN = WORD_CHAR + "+"
#: Fixed value: white space that is trimmed.
BLANK = "[\\s\\u000b\\u001c-\\u001f\\u0085\\u00a0\\u2028\\u2029]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}+$", "")


def tokens(text: Column) -> Column:
    """All words in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def count_of(text: Column, word: str) -> Column:
    """How often a word in lower case is one of the ``tokens`` of the text; no list of them is built."""
    return F.regexp_count(F.lower(text), F.lit(f"{word}(?<!{WORD_CHAR}{word})(?!{WORD_CHAR})"))


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, an empty text has none."""
    parts = F.split(text, LINE_END)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def slugify(text: Column, default: str = "item") -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(default))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (gone / F.length(needle)).cast("long")


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with ``old`` replaced if it is there exactly once, else unchanged."""
    return F.when(occurrences(text, old) == 1, F.replace(text, old, new)).otherwise(text)


def append_markdown(text: Column, addition: Column) -> Column:
    """Joined by one blank line; a blank side leaves the other."""
    body, more = rtrim(text), trim(addition)
    return F.when(trim(text) == "", more).when(more == "", text).otherwise(F.concat(body, F.lit("\n\n"), more))


def percent(share: Column) -> Column:
    """0.125 -> 12%, half to even."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def page_range(spec: Column) -> Column:
    """'1-3,7' -> [1, 2, 3, 7]; distinct and sorted; parts that are no numbers are left out."""
    part = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike("^\\d+(\\s*-\\s*\\d+)?$"))
    bounds = F.transform(part, lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int")))
    spans = F.transform(
        F.filter(bounds, lambda b: F.element_at(b, 1) <= F.element_at(b, -1)),
        lambda b: F.sequence(F.element_at(b, 1), F.element_at(b, -1)),
    )
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def shorten(text: Column, limit: int, mark: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def escape_label(text: Column) -> Column:
    """Markup characters as references, line ends as breaks: for labels in diagrams."""
    # Fixed values, in the order of replacement.
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br/>")]
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _glob_parts(pattern: str) -> list[tuple[str, str]]:
    """The characters, wildcards and sets of a shell pattern, each with its regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2)
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(("[]", "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"))
            i = end
        else:
            out.append((c, {"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() and ord(c) < 128 else c)))
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` also crosses slashes."""
    return f"(?s)^{''.join(r for _, r in _glob_parts(pattern))}$"


def glob_fixed(pattern: str) -> tuple[tuple, tuple]:
    """What every text that fits a shell pattern has: lengths and places (least length, head, tails as (back, size), inner), and what stands there.

    The head ends at the first wildcard; tails are the pieces without wildcards behind
    the last star, each beginning ``back`` characters before the end.  If there are none, inner is the
    longest piece between two stars, which stands anywhere; else its length is 0.
    """
    signs = [c for c, _ in _glob_parts(pattern)]
    kinds = "".join("*" if c == "*" else "?" if c in ("?", "[]") else "x" for c in signs)
    head = len(kinds) - len(kinds.lstrip("x"))
    # without a star all places count from both ends
    last = max(kinds.rfind("*"), head)
    tails = [m.span() for m in re.finditer("x+", kinds) if m.start() >= last]
    between = [m.span() for m in re.finditer("x+", kinds) if kinds.find("*") < m.start() < kinds.rfind("*")]
    a, b = max(between, key=lambda s: s[1] - s[0], default=(0, 0)) if not tails else (0, 0)
    text = lambda a, b: "".join(signs[a:b])
    shape = len(kinds) - kinds.count("*"), head, [(len(kinds) - x, y - x) for x, y in tails], b - a
    return shape, (text(0, head), [text(*t) for t in tails], text(a, b))


def strip_html(html: Column) -> Column:
    """Text of a page by expressions only: scripts, styles and comments go, tags become line ends, five references are decoded."""
    steps = [("(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^>]+>", "\n")]
    for pattern, new in steps:
        html = F.regexp_replace(html, pattern, new)
    for old, new in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        html = F.replace(html, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(html, "[ \\t]*\\n[ \\t\\n]*", "\n"), "^\\s+|\\s+$", "")


def fenced_json(text: Column) -> Column:
    """The JSON text inside a fence, or the outermost braces."""
    fence = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    return F.nullif(F.coalesce(F.nullif(fence, F.lit("")), F.regexp_extract(text, "(?s)\\{.*\\}", 0)), F.lit(""))


def highlight(text: Column, query: Column, mark: str = "**") -> Column:
    """Every occurrence of the query, without regard to case, between marks."""
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace(query, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(query == "", text).otherwise(F.regexp_replace(text, quoted, F.lit(f"{mark}$0{mark}")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
