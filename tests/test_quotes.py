"""Quotes of every length in texts, against a search for each in each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tesserine.operators import quotes

TEXTS = [(1, "Widget is important. And more of it stands here for long."), (2, "no such thing"), (3, "xWidget is important.y"), (4, None), (5, "w0 a b c d e f gh"), (6, ""), (7, "a  b "), (8, " x"), (9, "suchlike no"), (9, "no such")]
QUOTES = [(7, "Widget is important."), (8, "such"), (9, "0 a b c d e f g"), (10, ""), (11, None), (12, "of it stands here for longer"), (13, "o s"), (14, " x"), (15, "a  b"), (16, "b "), (17, "no such"), (18, "   "), (19, "such thing"), (19, "is"), (20, " such "), (21, "ß")]


def plain(texts, wanted):
    return sorted({(d, c) for d, t in texts for c, q in wanted if t and q and q.strip(" ") and q in t})


def found(spark, texts, wanted):
    got = quotes.contained(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(wanted, "claim_id long, quote string"))
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("small", [500_000, 0])
def test_quotes_of_any_length(spark, small, monkeypatch):
    monkeypatch.setattr(quotes, "SMALL", small)
    assert found(spark, TEXTS, QUOTES) == plain(TEXTS, QUOTES)


def test_pieces_of_random_texts(spark):
    r = random.Random(2)
    texts = [(i, " ".join("".join(r.choice("ab") for _ in range(r.randrange(0, 5))) for _ in range(r.randrange(0, 30)))) for i in range(60)]
    wanted = []
    for i in range(150):
        t = r.choice(texts)[1]
        at, size = r.randrange(len(t) + 1), r.randrange(1, 25)
        q = t[at : at + size]
        wanted.append((i, q if r.random() < 0.8 else q.replace("a", "b", 1)))
    got = found(spark, texts, wanted)
    assert got == plain(texts, wanted) and len(got) > 200


def test_a_hundred_thousand_short_quotes(spark):
    """Three words each, of which many are common: no list of quotes on the driver, one meeting with the texts."""
    word = lambda c: F.concat(F.lit("w"), F.pmod(F.xxhash64(c), F.lit(3000)).cast("string"))
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: word(F.col("id") * 1000 + i)), " the ").alias("text"))
    wanted = spark.range(100_000).select(F.col("id").alias("claim_id"), F.concat(word(F.col("id") * 7), F.lit(" the "), word(F.col("id") * 7 + 1)).alias("quote"))
    began = time.time()
    got = quotes.contained(texts, wanted)
    pairs = {tuple(x) for x in got.collect()}
    took = time.time() - began
    have = {r["doc_id"]: r["text"] for r in texts.collect()}
    asked = {r["claim_id"]: r["quote"] for r in wanted.collect()}
    assert len(pairs) > 10_000 and all(asked[c] in have[d] for d, c in pairs)
    # every third neighbour pair of a text that is a quote is found there
    by_quote = {}
    for c, q in asked.items():
        by_quote.setdefault(q, []).append(c)
    for d in range(0, 2000, 97):
        w = have[d].split(" ")
        for i in range(0, len(w) - 2, 2):
            for c in by_quote.get(" ".join(w[i : i + 3]), []):
                assert (d, c) in pairs
    assert took < 120
