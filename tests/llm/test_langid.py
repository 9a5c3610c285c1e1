"""Operator 7: sums over segmentations against their enumeration, words and letters of all scripts."""

import time

import numpy as np

from tesserine.llm import langid

VOCABULARY = [" a", " ab", " abca", "a", "ab", "abc", "b", "bc", "c", "caa", "cabcabcabcabc"]
LATTICE = langid.Lattice(VOCABULARY)
NUMBER = {p: i + 2 for i, p in enumerate(VOCABULARY)}


def segmentations(word):
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        k = NUMBER.get(word[:j], 1 if j == 1 else 0)
        if k:
            for rest in segmentations(word[j:]):
                yield [k, *rest]


def plain(word, prob):
    total, counts = 0.0, np.zeros(LATTICE.size)
    for s in segmentations(word):
        p = np.prod(prob[s])
        total += p
        np.add.at(counts, s, p)
    return total, counts / total


def random_words():
    rng = np.random.default_rng(0)
    prob = rng.random((LATTICE.size, 3))
    prob[0], prob[1] = 0, 1e-9
    return [" " + "".join(rng.choice(list("abcz"), n)) for n in (0, 1, 2, 3, 5, 8, 9, 12) for _ in range(4)] + [" cabcabcabcabca"], prob


def test_forward_sums_are_those_of_all_segmentations():
    words, prob = random_words()
    for word, got in zip(words, langid.word_scores(LATTICE, words, prob), strict=True):
        assert np.allclose(got, [np.log(plain(word, prob[:, k])[0]) for k in range(3)])


def test_expected_counts_are_those_of_all_segmentations():
    words, prob = random_words()
    weights = np.arange(1.0, len(words) + 1)
    got = langid.Counted(LATTICE, words, weights).expected(prob[:, 0])
    assert np.allclose(got, sum(n * plain(w, prob[:, 0])[1] for w, n in zip(words, weights, strict=True)))


def test_long_words_count_whole():
    _, prob = random_words()
    began = time.time()
    rare, one, two = langid.word_scores(LATTICE, [" " + "z" * 5000, " " + "abcz" * 2000, " " + "abcz" * 1000], prob)
    assert time.time() - began < 10
    assert np.allclose(rare, 5001 * np.log(1e-9))
    assert len(set(one.round(3))) == 3 and np.allclose(one, 2 * two, rtol=1e-3)
    counts = langid.Counted(LATTICE, [" " + "z" * 900 + "ab", " ab"], np.ones(2)).expected(prob[:, 0])
    assert np.isclose(counts[1], 901) and np.isfinite(counts).all()


def test_letters_of_all_scripts():
    assert langid.words_of("हिन्दी में ½ ² Ⅷ ① 12_3") == [" हिन्दी", " में"]
    assert langid.words_of("½ ² Ⅷ ① 12 ...") == []
    assert langid.words_of("Größe d'été") == [" größe", " d", " été"]


def test_vocabulary_pieces_of_any_length():
    import public_tokenizers

    found = langid.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, found)) > 12 and len(found) > 20_000


def test_und_ties_and_no_training_rows(spark, tmp_path):
    rows = [(0, None, "en"), (1, "½ ² Ⅷ", "en"), (2, "a few words", None), (3, "a few words", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op7_marginal_unigram_langid(spark, str(tmp_path)).collect()}
    assert got == {k: ("und", 0.0) for k in range(4)}
    one = langid.Scorer(LATTICE, ["de", "en"], np.full((LATTICE.size, 2), 0.1))
    assert one([[" abc"], []])[0] == ["de", "und"] and np.isclose(one([[" abc"]])[1][0], 0.5)
