"""Operator 12, spelling variant grouping: a positional q-gram index with a count filter.

One edit leaves either the first or the last half of a word as it is, so the index is
divided into shards: all words of like length that have one half in common.  In a shard the
other halves are indexed by their positional q-grams (Q letters, with an edge before and
after); for each word the posting lists of its grams are merged by a heap, those of words
of its own length at the same place, those of words one longer at the same place or the
next.  One edit spoils at most Q grams, so words that do not come up as often as the longer
half has grams, less Q, are out; the rest is verified letter by letter.

1. Words are counted in each task and then over all documents.
2. Every word goes to the shards of both its halves, as one of their length and as one that is
   longer by one.  A shard of more than BLOCK words is dealt into blocks of its index; its
   words are looked up in every block.
3. Pairs give each word its near words and its form, the commonest of those that are at
   least twice as common as itself.
4. Roots are found by pointer jumping.  Counts at least double along the way, so there are
   no more than 62 steps, and six rounds of jumps at most.

Defined results: a null or empty text has no words; a null id counts as an empty text before
the colon; repeated rows count each; of words that are as common, the first in the order of code
points is the form; runs and texts of any length are taken whole; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import eq
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import spread

from .common import SMALL, clearing, materialise, table

#: Which runs lose a letter, which words count, and what a run is made of (those too short for a word are not taken).
EVERY, LETTERS, LEAST, TIMES = 97, 5, 3, 2
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LETTERS)
Q, BLOCK = 2, 4_000
#: Words that a task remembers, pairs of one Arrow batch that leaves a task.
REMEMBER, PAIRS = 200_000, 20_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text as they are counted, summed up to REMEMBER different ones; a word can come more than once."""
    found: dict[bytes, int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            start = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                word = run.encode().lower()
                h = crc32(word, start)
                if not h % EVERY:
                    at = h % len(run)
                    if len(run) == LETTERS:
                        continue
                    word = (run[:at] + run[at + 1 :]).encode().lower()
                found[word] += n
            if len(found) >= REMEMBER:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, text -> word, n: words of LETTERS code points or more that occur LEAST times or more."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def _shards(words: DataFrame) -> DataFrame:
    """long, last, half and word, n, other: each word in its four shards; ``other`` is the half that is not shared.

    A shard is named by the length of its shorter words.  ``longer`` words have one letter more.
    """
    size = F.length("word")
    roles = []
    for longer in (0, 1):
        base = size - longer
        first = F.floor(base / 2).cast("int")
        for last in (False, True):
            # the shared half is the last one: begins behind the first half of the shorter word, one later in the longer
            cut = first + longer if last else first
            head, tail = F.left("word", cut), F.substring("word", cut + 1, size)
            half, other = (tail, head) if last else (head, tail)
            roles.append(F.struct(base.cast("int").alias("size"), F.lit(last).alias("last"), half.alias("half"), F.lit(longer).alias("longer"), other.alias("other")))
    rows = words.select("word", "n", F.explode(F.array(*roles)).alias("r"))
    return rows.select("r.*", "word", "n").filter(F.col("size") >= LETTERS)


def _blocks(rows: DataFrame) -> DataFrame:
    """Shards of more than BLOCK words in blocks: each word is indexed in one, and looked up in all (``indexed`` tells which row is which)."""
    key = ["size", "last", "half"]
    large = materialise(rows.groupBy(*key).agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select(*key, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "large")
    few = large.count() <= SMALL  # no more than a row in BLOCK rows
    rows = rows.join(F.broadcast(large) if few else large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    looks = F.when(F.col("longer") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    rows = rows.select(*key, "longer", "other", "word", "n", home.alias("home"), F.explode(looks).alias("block"))
    return rows.withColumn("indexed", F.col("home") == F.col("block")).drop("home")


def grams(part: str) -> list[str]:
    """The q-grams of a half with an edge before and after it, by place."""
    padded = f"\x00{part}\x01"
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Exactly one letter replaced (equal lengths), or inserted into ``a`` (``b`` is longer by one)."""
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def near_in(rows: Iterator[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of rows (longer, other, word, n, indexed) of a block whose other halves are one edit apart.

    The indexed rows come first and are held; the words that are only looked up pass by.
    """
    shard, passing = [], iter(())
    for row in rows:
        if not row[4]:
            passing = chain([row], rows)
            break
        shard.append(row)
    made = [grams(r[1]) for r in shard]
    index: dict[tuple, list[int]] = defaultdict(list)
    for i, row in enumerate(shard):
        for at, gram in enumerate(made[i]):
            index[row[0], at, gram].append(i)
    for row in chain((r for r in shard if not r[0]), passing):
        found = grams(row[1])
        same = [x for at, g in enumerate(found) if (x := index.get((0, at, g)))]
        # a letter inserted before a gram moves it by one place
        longer = [x for at, g in enumerate(found) if (x := sorted({*index.get((1, at, g), ()), *index.get((1, at + 1, g), ())}))]
        # one edit spoils Q grams of the longer of two halves, which has one gram more if it is longer
        for lists, least, shift in ((same, len(found) - Q, 0), (longer, len(found) + 1 - Q, 1)):
            # what comes up in ``least`` lists comes up in one of the others too: the longest are not merged but counted
            lists.sort(key=len)
            last = None
            for i in heapq.merge(*lists[: max(0, len(lists) - least + 1)]):
                if i != last:
                    last, there = i, made[i]
                    overlap = sum(map(eq, found, there)) + (sum(map(eq, found, there[1:])) if shift else 0)
                    if overlap >= least and one_edit(row[1], shard[i][1]):
                        yield row, shard[i]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of all shards of a task; the rows come sorted by shard, and only one block of one shard is held."""

    def rows() -> Iterable[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("size", "last", "half", "block", "longer", "other", "word", "n", "indexed")), strict=True)

    def pairs() -> Iterator[tuple]:
        for (size, last, _, _), shard in groupby(rows(), key=lambda r: r[:4]):
            first = size // 2
            for a, b in near_in(r[4:] for r in shard):
                # equal words of a shard's own length are found from both sides and in both halves: once is enough
                if (b[0] or a[2] < b[2]) and not (last and a[2][:first] == b[2][:first]):
                    yield a[2], a[3], b[2], b[3]

    held: list[tuple] = []
    for pair in pairs():
        held.append(pair)
        if len(held) >= PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["a", "na", "b", "nb"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["a", "na", "b", "nb"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n -> a, na, b, nb: every pair of words one edit apart, once."""
    key = ["size", "last", "half", "block"]
    rows = _blocks(_shards(words)).select(*key, "longer", "other", "word", "n", "indexed")
    # the work of a part is not in its bytes: parts are not put together
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *key).sortWithinPartitions(*key, F.desc("indexed")).mapInArrow(_pairs, "a string, na long, b string, nb long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: pointer jumping over the written table."""
    steps = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialise(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = jumped.select("word", "root")
        if not jumped.filter("moved").limit(1).count():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """doc_id, text -> word, form, root, n, n_near, form_n."""
    with clearing(docs.sparkSession):
        words = materialise(vocabulary(docs), "words")
        pairs = materialise(near_words(words), "near")
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
        best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
        told = words.join(both.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
        most = -F.col("best.less")
        leads = most >= TIMES * F.col("n")
        told = materialise(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, most).alias("form_n")), "forms")
        roots = _roots(told.filter("form is not null"))
        out = told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialise(out, "variants", keep=True)


def op12_gram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _four_bits(b: int) -> int:
    """The crc32 of four bits, for the SQL, which has no such function."""
    for _ in range(4):
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return b


_STEP = "xor({0} >> 4, %s[({0} & 15) + 1])" % [_four_bits(b) for b in range(16)]
SQL = """
with recursive r as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
d as (select doc_id, run, count(*) as n from r group by all),
x as (select *, hex(encode(concat(doc_id, ':', run))) as bytes from d),
b as (select doc_id, run, n, list_transform(generate_series(1, len(bytes), 2), lambda i: cast('0x' || bytes[i:i + 1] as bigint)) as bytes from x),
h as (select doc_id, run, n, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, b: {step})) as h from b),
e as (select case when h % 97 = 0 then concat(left(run, cast(h % length(run) as bigint)), substr(run, cast(h % length(run) as bigint) + 2)) else run end as word, n from h),
v as (select word, sum(n) as n from e where length(word) >= 5 group by word having sum(n) >= 3),
k as (select word, n, i, concat(left(word, i - 1), substr(word, i + 1)) as rest from (select word, n, unnest(generate_series(1, length(word))) as i from v) y),
p as (
  select a.word, b.word as near, b.n as near_n from k a join k b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select k.word, v.word, v.n from k join v on v.word = k.rest
  union select v.word, k.word, k.n from k join v on v.word = k.rest),
f as (select word, count(*) as n_near, min(row(-near_n, near)) as best from p group by word),
o as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best[1] >= 2 * v.n then best[2] end as form, case when -best[1] >= 2 * v.n then -best[1] end as form_n from v left join f on f.word = v.word),
g(word, root) as (select word, word from o where form is null union all select o.word, g.root from g join o on o.form = g.word)
select o.word, o.form, g.root, cast(o.n as bigint) as n, o.n_near, cast(o.form_n as bigint) as form_n from o join g on g.word = o.word
""".replace("{step}", _STEP.format(_STEP.format("xor(c, b)")))
