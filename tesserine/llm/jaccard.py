"""Operator 10, n-gram Jaccard join: T-occurrence search in the manner of DivideSkip.

A document is the set of its distinct five-word shingles.  Two documents link
when 100 * intersection >= 80 * union, so they share at least T = 80 % of the
larger set.  Shingles have one global order; in it every set is divided into a
short part (its first |x| - T + k shingles) and a long part (the rest).  Linked
documents meet in at least k inverted lists of short shingles.  These lists are
merged by a shuffle on the shingle, the long ones are skipped, and candidates
are probed by binary search in the partner's sorted set.

1. Equal sets are folded into one representative.
2. With the shingles ordered by hash, a set none of whose partners can reach k
   common short shingles is dropped: this leaves few sets, without shuffling
   all shingles.
3. What is left is ordered by list length, rare shingles first, so that common
   passages stand in the long part.  Sets that differ only in shingles of their
   own are folded again.
4. Every list first meets its most shared member only (its hub).  Members of one
   component need no more comparisons, and what two members can have in common
   is bounded by what each has in common with the hub; only the pairs of a list
   that are still in different components and within that bound are compared.

No link between different sets is lost by this: the steps drop only pairs that
provably miss the threshold, or that are connected already.  Shingles are compared
by 64-bit hashes and equal sets by two sums of 64 bits: two different shingles of
one pair of sets of 1,000 shingles would have to have one hash, one chance in
10^13, for its overlap to be wrong by one.

Defined results: a null, empty or blank text has 0 shingles and links with
nothing; a text of fewer than five words is one shingle; repeated rows are rows
of their own with equal results; a row with a null id belongs to the component of
the rows with an equal set, null if there is none; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import spread

from .common import clearing, materialise, small_or_shuffled
from .components import components

SHINGLE, PERCENT = 5, 80
#: Words, and sets, that a task remembers.
REMEMBER = 200_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


class Words(dict):
    """Words -> their 64-bit hashes; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; only A-Z are lower-cased, only ASCII blanks divide words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n, size = len(w), min(SHINGLE, len(w))
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : n - size + 1 + i]) * _M + (h >> np.uint64(32))
    return np.unique(_mix(h, 0xD6E8FEB86659FD93))


def required(n: int) -> int:
    """T: what a set of n shares with any set that it links with, at least."""
    return (PERCENT * n + 99) // 100


def _keys(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell it from others."""
    return tuple(int(_mix(s, by).sum(dtype=np.uint64).view(np.int64)) for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and keys of each set, and its first shingles by hash; a set that the task has met has none."""
    words, met = Words(), set()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            sizes, keys, short = [], [], []
            for t in batch.column("text").slice(at, 500).to_pylist():
                s = shingles(t, words)
                key = _keys(s)
                sizes.append(len(s))
                keys.append(key)
                if not len(s) or key in met:
                    short.append(None)
                    continue
                if len(met) >= REMEMBER:
                    met.clear()
                met.add(key)
                short.append(s[: len(s) - required(len(s)) + (len(s) + 9) // 10].view(np.int64))
            one, two = zip(*keys, strict=True)
            columns = [batch.column("doc_id").slice(at, 500), *(pa.array(x, pa.int64()) for x in (sizes, one, two)), pa.array(short, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "short"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            sets = [shingles(t, words) for t in batch.column("text").slice(at, 200).to_pylist()]
            one, two = zip(*map(_keys, sets), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(at, 200), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["rep", "k1", "k2", "found"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact overlap of each candidate pair: binary search of one set's shingles in the other's sorted set."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
            x, y = (v.values.to_numpy() for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
        rest = [c for c in batch.schema.names if c not in ("xa", "xb")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.int64())], [*rest, "overlap"])


def _may_link(a: str, b: str) -> Column:
    """Sizes that allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b (classes) -> and na, nb, overlap."""
    side = lambda k: sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("shared").alias(f"x{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return both.mapInArrow(_probe, "a long, b long, na long, nb long, overlap long")


def _linked(na: str = "na", nb: str = "nb", overlap: str = "overlap") -> Column:
    return F.col(overlap) * (100 + PERCENT) >= PERCENT * (F.col(na) + F.col(nb))


def _rest(members: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs of classes that met the same hub, are not yet connected, and can still reach the threshold.

    members: hub, cls, n, ``i`` (overlap with the hub) and ``e`` (shared
    shingles beside those).  Linked classes have a short list in common and so
    the hub of that list; two members of a hub have at most least(i) + least(e)
    shingles in common.  One of the two is not connected with the hub: only those
    are held against the members of the hub, and only where the sizes are alike
    (in the same range of sizes or the next, each 100 / PERCENT times the last).
    """
    now = members.join(state, "cls").join(state.select(F.col("cls").alias("hub"), F.col("comp").alias("main")), "hub")
    band = F.floor(F.log("n") / float(np.log(100 / PERCENT))).cast("int")
    now = materialise(now.withColumn("band", band), "members")
    outside = now.filter("comp <> main")
    inside = now.join(outside.select("hub").distinct(), "hub", "left_semi")
    left, right = (d.select("hub", "band", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "comp", "i", "e")]) for d, x in ((outside, "a"), (inside, "b")))
    left = left.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    able = (F.least("i_a", "i_b") + F.least("e_a", "e_b")) * (100 + PERCENT) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    met = left.join(right, ["hub", "band"]).filter((F.col("comp_a") != F.col("comp_b")) & _may_link("n_a", "n_b") & able)
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def similar_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with clearing(docs.sparkSession):
        rows, by_set = _by_set(docs)
    key = ["k1", "k2", "n"]
    out = rows.join(by_set, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _by_set(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, k1, k2 of all rows, and k1, k2, n -> component, the smallest id of the sets that links reach."""
    described = materialise(docs.mapInArrow(_describe, "doc_id long, n long, k1 long, k2 long, short array<long>"), "described")
    rows = materialise(described.drop("short"), "fingerprints", keep=True)
    key = ["k1", "k2", "n"]
    reps = rows.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))

    # sets that can have a partner, by the first shingles in the order of their hashes: lists are
    # told by their ends, which combine before the shuffle, and a common shingle is one row of a join
    short = described.select("k1", F.explode("short").alias("shingle"))
    shared = short.groupBy("shingle").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("shingle")
    hits = short.join(shared, "shingle", "left_semi").distinct().groupBy("k1").agg(F.count("*").alias("hits"))
    least = F.floor((F.floor((F.col("n") * PERCENT + 99) / 100) + 9) / 10)
    able = reps.filter("rep is not null").join(hits, "k1").filter(F.col("hits") >= least)
    named = materialise(able.select(F.monotonically_increasing_id().alias("set"), "rep", *key), "able")
    # from here on a set goes by its number, so that an id may stand on several texts
    able = named.select(F.col("set").alias("rep"), "n")

    # their whole sets, rare shingles first
    texts = small_or_shuffled(docs.withColumnRenamed("doc_id", "rep"), named.select("rep").distinct(), "rep")
    found = texts.mapInArrow(_sets, "rep long, k1 long, k2 long, found array<long>").join(named.select("set", "rep", "k1", "k2"), ["rep", "k1", "k2"])
    found = materialise(found.select(F.col("set").alias("rep"), "found").dropDuplicates(["rep"]), "sets")
    each = found.select("rep", F.explode("found").alias("shingle"))
    lengths = each.groupBy("shingle").agg(F.count("*").alias("length")).filter("length > 1")
    listed = each.join(lengths, "shingle").groupBy("rep").agg(F.collect_list(F.struct("length", "shingle")).alias("found"))
    n, s = F.col("n"), F.size("found")
    sets = listed.join(able, "rep").filter(s * 100 >= n * PERCENT)
    # the shingles of its own (lists of one) come first in the order, then what is shared
    sets = sets.select("rep", "n", F.array_sort("found").alias("ordered"), F.array_sort(F.transform("found", lambda x: x["shingle"])).alias("shared"))
    sets = materialise(sets.withColumn("mark", F.xxhash64("n", "shared")).withColumn("mark2", F.xxhash64(F.lit(3), "shared", "n")), "ordered")
    folded = sets.groupBy("mark", "mark2").agg(F.min("rep").alias("cls"), F.count("*").alias("members"))
    member = materialise(sets.select("rep", "mark", "mark2", "n", F.size("shared").alias("s")).join(folded, ["mark", "mark2"]).select("rep", "cls", "members", (100 * F.col("s") >= PERCENT * (2 * F.col("n") - F.col("s"))).alias("alike")), "classes")
    classes = sets.join(member.filter("rep = cls").select("cls"), F.col("rep") == F.col("cls"), "left_semi").withColumnRenamed("rep", "cls")

    # inverted lists of the short parts: every list meets its hub
    own = n - F.size("shared")
    take = F.greatest(F.lit(0), n - F.floor((n * PERCENT + 99) / 100) + 1 - own).cast("int")
    lists = classes.select("cls", n, F.size("shared").alias("s"), F.explode(F.slice("ordered", 1, take)).alias("x")).select("cls", "n", "s", F.col("x.shingle").alias("shingle"))
    lists = materialise(lists, "lists")
    hub = lists.groupBy("shingle").agg(F.max(F.struct(F.col("s") / F.col("n"), "n", "cls")).alias("h"), F.count("*").alias("m")).filter("m > 1").select("shingle", F.col("h.cls").alias("hub"))
    met = materialise(lists.join(hub, "shingle").groupBy("cls", "hub").agg(F.first("n").alias("n"), F.first("s").alias("s")), "met")
    narrow = materialise(classes.select("cls", "n", "shared"), "probed")
    tried = materialise(_overlaps(met.filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")), narrow), "tried")
    links = tried.filter(_linked()).select("a", "b")
    state = met.select("cls").distinct().join(components(links).withColumnRenamed("id", "cls"), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))
    known = tried.select(F.col("a").alias("cls"), F.col("b").alias("hub"), "overlap")
    i = F.coalesce("overlap", "s")  # the hub itself has all of its own
    members = met.join(known, ["cls", "hub"], "left").select("hub", "cls", "n", i.alias("i"), (F.col("s") - i).alias("e"))
    rest = _overlaps(_rest(members, state), narrow).filter(_linked())
    links = materialise(links.unionByName(rest.select("a", "b")), "links")

    # back to documents; a folded class without any link holds sets that are not alike among themselves
    comp = components(links).withColumnRenamed("id", "cls")
    by_rep = member.join(comp, "cls", "left").select("rep", F.coalesce("comp", F.when(F.col("alike"), F.col("cls")), "rep").alias("component"))
    of_set = reps.join(named.select(*key, F.col("set").alias("rep_set")), key, "left").join(by_rep.withColumnRenamed("rep", "rep_set"), "rep_set", "left")
    lowest = of_set.filter("component is not null").groupBy("component").agg(F.min("rep").alias("lowest"))
    of_set = of_set.join(lowest, "component", "left").select(*key, F.coalesce("lowest", "rep").alias("component"))
    return rows, materialise(of_set, "components", keep=True)


def op10_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from w where len(w) > 0) x),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
r(doc_id, root) as (
  select a, a from e union select e.b, r.root from r join e on e.a = r.doc_id),
m as (select doc_id, min(root) as root from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.root, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""
