"""Which documents hold which quotes, of any length, in two passes over the texts.

Words are what stands between single blanks.  A quote's words between its first and its last
are whole words of the text; the first may be the end of a longer word and the last
its beginning.  So a quote is looked for by two neighbouring words around its rarest one; where
it is too short to have two whole words, the words of the corpus that the open end fits stand for it.
Quotes and texts meet on the hashes of these pairs, and each pair of a text and a quote that
met is compared once, letter by letter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.sinks import stored

#: Rows of a hash and an id that a broadcast may hold: about 20 MB.  Beyond it the texts' pairs are shuffled.
SMALL = 500_000
WHOLE, END, BEGIN, WITHIN = range(4)


def _pieces(quotes: DataFrame) -> DataFrame:
    """claim_id, q, at, piece, kind: the words that a quote can be looked for by.

    Of quotes of four words and more these are the inner ones; shorter ones need their
    open ends, of which an empty one (a blank before or behind the quote) asks for nothing.
    """
    n = F.size("w")
    rows = quotes.select("claim_id", "q", n.alias("n"), F.posexplode("w").alias("at", "piece"))
    first, last = F.col("at") == 0, F.col("at") == F.col("n") - 1
    kind = F.when(first & last, WITHIN).when(first, END).when(last, BEGIN).otherwise(WHOLE)
    rows = rows.withColumn("kind", kind)
    return rows.filter((F.col("kind") == WHOLE) | ((F.col("n") < 4) & (F.col("piece") != ""))).select("claim_id", "q", "at", "piece", "kind")


def _parts(word: str, kind: int, sizes: list[int]) -> Column:
    """All pieces of a word of one kind, for the lengths that are asked for."""
    w, n = F.col(word), F.length(word)
    if kind == WITHIN:
        every = lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.substr(w, i, F.lit(s)))
        cut = [every(s) for s in sizes]
    else:
        cut = [F.array(F.left(w, F.lit(s)) if kind == BEGIN else F.right(w, F.lit(s))) for s in sizes]
    fits = [F.when(n >= s, c).otherwise(F.array().cast("array<string>")) for s, c in zip(sizes, cut, strict=True)]
    return F.array_distinct(F.flatten(F.array(*fits)))


def _fitting(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """kind, piece, word, texts: the words of the corpus that fit each piece, and in how many texts they stand."""
    words = texts.select(F.explode(F.array_distinct("w")).alias("word"))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("texts"))
    asked = pieces.select("kind", "piece").distinct()
    open_ends = asked.filter(F.col("kind") != WHOLE)
    # how many pieces of each kind, and the lengths of open ends: a few numbers, whatever the number of quotes
    lengths = F.collect_set(F.when(F.col("kind") != WHOLE, F.length("piece"))).alias("s")
    told = {r["kind"]: (r["n"], sorted(r["s"])) for r in asked.groupBy("kind").agg(F.count("*").alias("n"), lengths).collect()}
    sizes = {k: s for k, (_, s) in told.items() if k != WHOLE}
    inner = asked.filter(F.col("kind") == WHOLE).select(F.col("piece").alias("word"))
    # a few words asked for are picked out before the corpus is counted, many afterwards
    few = told.get(WHOLE, (0,))[0] <= SMALL
    counted = words.join(F.broadcast(inner), "word", "left_semi").groupBy("word").agg(F.count("*").alias("texts")) if few else vocabulary.join(inner, "word", "left_semi")
    whole = counted.select(F.lit(WHOLE).alias("kind"), F.col("word").alias("piece"), "word", "texts")
    cut = [vocabulary.select(F.lit(k).alias("kind"), F.explode(_parts("word", k, s)).alias("piece"), "word", "texts") for k, s in sizes.items()]
    return reduce(DataFrame.unionByName, [c.join(open_ends, ["kind", "piece"], "left_semi") for c in cut], whole)


def _keys(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """claim_id, q, key: the hashes that a quote is looked for by; a quote with a word that no text has is left out."""
    pieces = _pieces(quotes)
    fitting = stored(_fitting(texts, pieces), "fitting")
    weights = fitting.groupBy("kind", "piece").agg(F.sum("texts").alias("weight"))
    found = pieces.join(weights, ["kind", "piece"], "left")
    each = found.groupBy("claim_id", "q").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "kind", "weight"))).alias("p"), F.count_if(F.col("weight").isNull()).alias("nowhere")).filter("nowhere = 0")
    # neighbours of which one is a whole word, by the rarer of the two; else the rarest piece alone
    p, one = F.col("p"), lambda x: F.struct(x["weight"].alias("least"), x.alias("a"), x.alias("b"))
    pairs = F.transform(F.filter(p, lambda x, i: (i > 0) & (F.get(p, i - 1)["at"] == x["at"] - 1) & ((x["kind"] == WHOLE) | (F.get(p, i - 1)["kind"] == WHOLE))), lambda x: x["at"])
    at = lambda k: F.element_at(F.filter(p, lambda y: y["at"] == k), 1)
    pairs = F.transform(pairs, lambda k: F.struct(F.least(at(k)["weight"], at(k - 1)["weight"]).alias("least"), at(k - 1).alias("a"), at(k).alias("b")))
    best = each.select("claim_id", "q", F.array_min(F.when(F.size(pairs) > 0, pairs).otherwise(F.transform(p, one))).alias("k")).select("claim_id", "q", "k.a", "k.b")
    side = lambda k: fitting.select(F.col("kind").alias(f"_{k}"), F.col("piece").alias(f"_p{k}"), F.col("word").alias(f"w{k}"))
    for k in ("a", "b"):
        best = best.join(side(k), (F.col(f"{k}.kind") == F.col(f"_{k}")) & (F.col(f"{k}.piece") == F.col(f"_p{k}")))
    alone = F.col("a.at") == F.col("b.at")
    # a piece alone stands on both sides
    best = best.filter(~alone | (F.col("wa") == F.col("wb")))
    return best.select("claim_id", "q", F.when(alone, F.xxhash64(F.lit(1), "wa")).otherwise(F.xxhash64("wa", "wb")).alias("key"), alone.alias("alone"))


def contained(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, claim_id: documents (doc_id, text) whose text holds a whole quote (claim_id, quote).

    Null and empty quotes, and those of blanks only, are held by nothing.  Neither the
    quotes nor anything that grows with them passes through the driver.
    """
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", F.split("text", " ").alias("w"))
    # a claim may come with several quotes: each is told by its hash besides
    asked = quotes.filter(F.trim("quote") != "").select("claim_id", F.xxhash64("quote").alias("q"), "quote").distinct()
    wanted = asked.select("claim_id", "q", F.split("quote", " ").alias("w"))
    keys = stored(_keys(wanted, texts), "quote-keys")
    size = keys.agg(F.count("*").alias("n"), F.count_if("alone").alias("alone")).first()
    keys = keys.select("claim_id", "q", "key")
    # the two words of a pair stand side by side in one row: hashing them stays in generated code
    n = F.greatest(F.size("w") - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice("w", F.lit(1), n).alias("w0"), F.slice("w", F.lit(2), n).alias("w1"))
    met = texts.select("doc_id", F.inline(zipped)).select("doc_id", F.xxhash64("w0", "w1").alias("key"))
    if size["alone"]:
        met = met.unionByName(texts.select("doc_id", F.explode(F.array_distinct("w")).alias("w0")).select("doc_id", F.xxhash64(F.lit(1), "w0").alias("key")))
    pairs = met.join(F.broadcast(keys) if size["n"] <= SMALL else keys, "key").select("doc_id", "claim_id", "q").distinct()
    pairs = stored(pairs, "quote-pairs")  # their size tells whether texts have to be shuffled to them
    both = pairs.join(documents.select("doc_id", "text"), "doc_id").join(asked, ["claim_id", "q"])
    return both.filter(F.contains("text", "quote")).select("doc_id", "claim_id").distinct()
