"""Operator 13, fill-in-the-middle transformation: big integers as bit rows of a text.

A text of L code points becomes bytes of one code point each; ``bytes.translate``
makes a row of 0 and 1 from them, which is read as one integer: bit i tells
whether code point i is white space.  A unit begins where white space follows
something else, and at the beginning: one shift and two boolean operations mark
all of them, ``bit_count`` gives n, and the begin of unit k is the set bit of
rank k, found by halving the integer: the half that holds it is kept, so that the work
of one selection is about twice the length in bits and nothing is listed.

Defined results: a null text counts as empty; an empty text is plain with n = 0; a
null id counts as an empty text where the split is drawn; repeated rows have equal
results; texts of any length are one integer of as many bits; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import spread

from .common import table

SEED, PLAIN_FROM, SPM_BELOW = 42, 50, 80
#: The marks before prefix, suffix and middle.
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Fixed value: the white space that divides units.
BLANKS = b" \t\n\x0b\x0c\r"
_CLASS = bytes(0x31 if c in BLANKS else 0x30 for c in range(256))
#: Texts of one Arrow batch that leaves a task.
ROWS = 200


def unit_starts(text: str) -> int:
    """The set bits are the code points at which a unit begins, bit 0 the first of the text."""
    n = len(text)
    if not n:
        return 0
    # one byte a code point: what does not fit becomes a question mark, which is no white space either
    blank = int(text.encode("latin-1", "replace").translate(_CLASS)[::-1], 2)
    filled = blank ^ ((1 << n) - 1)
    return blank & (filled << 1) | 1


def select(bits: int, rank: int) -> int:
    """The place of the set bit with ``rank`` set bits below it."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """n, form, length of prefix and middle (None if plain), output."""
    starts = unit_starts(text)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    place = [select(starts, k) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = text[: place[0]], text[place[0] : place[1]], text[place[1] :]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, text -> doc_id, n, form, prefix_chars, middle_chars, output."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [transform(d, t or "", seed) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from output and form: a transformed text holds no mark, so the output has exactly three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    place = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, order in place.items():
        out = out.when(form == name, F.concat(*[F.get(parts, F.lit(k)) for k in order]))
    return out


def op13_bit_parallel_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256(concat('42:', cast(doc_id as varchar))) as h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u
  from documents),
k as (
  select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from k),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', pre, '<S>', suf, '<M>', mid) else concat('<S>', suf, '<P>', pre, '<M>', mid) end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
