"""Operator 7, language identification: segmentation-marginalised unigrams.

Over a fixed public vocabulary of pieces each language gets a probability for
every piece.  The probability of a word is the sum over all its segmentations
into pieces of any length, found by a forward recursion that is scaled as it goes,
so words of any length count whole; texts are scored by the sum of the logarithms
over their words.  The piece probabilities come from a few rounds of expectation
maximisation (forward and backward sums over all segmentations) on the word counts
of a bounded sample of labelled documents per language; the bounds are the
parameters SAMPLE_DOCS, documents of about that expected number are taken per
language by a hash of the id, and FIT_CHARS, longer words of the sample are not
fitted.  Every text is predicted whole.

A word is a run of letters with their marks and joiners.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a letter outside the vocabulary counts as an unknown piece; repeated rows get
equal predictions; of languages with equal scores the first by code point is
given; without training rows every text with a letter is ``und``; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import spread

from .common import SMALL, fold, materialise

FOLDS, HELD = 4, 2
SAMPLE_DOCS = 600
FIT_CHARS = 1000
ROUNDS = 3
UNKNOWN = 1e-9
SMOOTH = 0.02
#: Words, of at most so many characters, whose scores a task remembers.
REMEMBER, SHORT = 500_000, 64
#: Characters of words that are scored together; positions whose pieces are looked up together.
TOGETHER, SLAB = 200_000, 512
WORD = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")
PIECE = regex.compile(r" ?[\p{L}\p{M}\u200c\u200d]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def pieces(model_path: str) -> list[str]:
    """Letter pieces of the vocabulary in lower case, word starts marked by a leading blank; sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            p = model.id_to_piece(i).replace("▁", " ").lower()
            if PIECE.fullmatch(p):
                found.add(p)
    return sorted(found)


class Lattice:
    """All segmentations of words into pieces, as tables of piece numbers.

    ``spans`` gives for each word a grid [start, length] of piece numbers; the
    number 0 stands for no such piece, 1 for an unknown single character.  The
    table has the hashes of all beginnings of pieces, so that the search for the
    pieces at a place ends where no piece goes on.
    """

    def __init__(self, vocabulary: list[str]):
        self.size, self.longest = len(vocabulary) + 2, max(map(len, vocabulary), default=1)
        codes, lengths = self._codes(vocabulary)
        h, keys, numbers = np.zeros(len(codes), np.uint64), [], []
        for k in range(codes.shape[1]):
            h = self._step(h, codes[:, k])
            inside = k < lengths
            keys.append(h[inside])
            numbers.append(np.where(k + 1 == lengths, np.arange(2, self.size), 0)[inside])
        keys, numbers = np.concatenate([*keys, [np.uint64(0)]]), np.concatenate([*numbers, [0]])
        order = np.lexsort((-numbers, keys))  # of equal hashes that of a whole piece first
        self._keys, first = np.unique(keys[order], return_index=True)
        self._numbers = numbers[order][first]

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points as a matrix padded with zeros, and the lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        rows = np.repeat(np.arange(len(words)), lengths)
        codes[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return codes, lengths

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ c.astype(np.uint64)) * _MULTIPLY + (h >> np.uint64(29))

    def spans(self, codes: np.ndarray, lengths: np.ndarray, low: int, high: int) -> np.ndarray:
        """The grid for the starts from ``low`` to ``high``."""
        width = high - low
        grid = np.zeros((len(codes) * width, self.longest), np.int32)
        start = np.tile(np.arange(low, high), len(codes))
        row = np.repeat(np.arange(len(codes)), width)
        at = np.flatnonzero(start < lengths[row])
        grid[at, 0] = 1
        h = np.zeros(len(at), np.uint64)
        for k in range(self.longest):
            inside = start[at] + k < lengths[row[at]]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = self._step(h, codes[row[at], start[at] + k])
            found = np.minimum(np.searchsorted(self._keys, h), len(self._keys) - 1)
            hit = self._keys[found] == h
            at, h, found = at[hit], h[hit], self._numbers[found[hit]]
            grid[at, k] = np.where((found == 0) & (k == 0), 1, found)
        return grid.reshape(len(codes), width, self.longest)


def _batches(words: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of words of like length, in order of length, up to about TOGETHER characters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        step = max(1, TOGETHER // max(1, int(sizes[order[at]])))
        to = min(len(order), at + step)
        while to > at + 1 and sizes[order[to - 1]] > 2 * sizes[order[at]] + 8:
            to = at + (to - at) // 2
        yield order[at:to]
        at = to


def word_scores(lattice: Lattice, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, all segmentations summed."""
    out = np.zeros((len(words), prob.shape[1]))
    for rows in _batches(words):
        out[rows] = _forward_logs(lattice, [words[i] for i in rows], prob)
    return out


def _forward_logs(lattice: Lattice, words: list[str], prob: np.ndarray) -> np.ndarray:
    """The sums over all segmentations of words in order of length: only those that may still be reached are held."""
    codes, lengths = lattice._codes(words)
    n, width, most = len(words), codes.shape[1], lattice.longest
    sums = np.zeros((most + 1, n, prob.shape[1]))
    sums[0] = 1.0
    logs, out = np.zeros((n, prob.shape[1])), np.zeros((n, prob.shape[1]))
    grid, low = None, 0
    for at in range(width + 1):
        slot = at % (most + 1)
        here, done = np.searchsorted(lengths, at), np.searchsorted(lengths, at, "right")
        if done > here:
            out[here:done] = np.log(sums[slot, here:done]) + logs[here:done]
        if at == width:
            break
        if grid is None or at - low == grid.shape[1]:
            low = at
            grid = lattice.spans(codes, lengths, low, min(width, low + SLAB))
        now = sums[slot, done:].copy()
        sums[slot] = 0.0
        for k in range(most):
            piece = grid[done:, at - low, k]
            some = np.flatnonzero(piece)
            if k and not len(some):
                continue
            if len(some) == len(piece):
                sums[(at + k + 1) % (most + 1), done:] += now * prob[piece]
            else:
                sums[(at + k + 1) % (most + 1), done + some] += now[some] * prob[piece[some]]
        if at % 8 == 7:
            top = sums[:, done:].max(axis=0)
            top[(top > 1e-60) | (top == 0)] = 1.0
            sums[:, done:] /= top
            logs[done:] += np.log(top)
    return out


class Counted:
    """Words of one language with their counts; ``expected`` counts pieces by forward and backward sums over all segmentations."""

    def __init__(self, lattice: Lattice, words: list[str], counts: np.ndarray):
        self._size, self._parts = lattice.size, []
        for rows in _batches(words):
            codes, lengths = lattice._codes([words[i] for i in rows])
            self._parts.append((lattice.spans(codes, lengths, 0, codes.shape[1]), lengths, counts[rows]))

    def expected(self, prob: np.ndarray) -> np.ndarray:
        total = np.zeros(self._size)
        for grid, lengths, counts in self._parts:
            total += self._of(grid, lengths, counts, prob)
        return total

    def _of(self, grid: np.ndarray, lengths: np.ndarray, counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        n, width, most = grid.shape
        rows = np.arange(n)
        alpha, beta = np.zeros((n, width + 1)), np.zeros((n, width + 1))
        la, lb = np.zeros((n, width + 1)), np.zeros((n, width + 1))  # logarithms that were taken out of the sums
        alpha[:, 0] = 1.0
        for end in range(1, width + 1):
            # the last sums in the scale of the newest of them
            la[:, end] = la[:, end - 1]
            for k in range(min(most, end)):
                begin = end - k - 1
                alpha[:, end] += alpha[:, begin] * np.exp(la[:, begin] - la[:, end]) * prob[grid[:, begin, k]]
            alpha[:, end], la[:, end] = _scaled(alpha[:, end], la[:, end])
        past = np.arange(width + 1) > lengths[:, None]
        beta[rows, lengths] = 1.0
        for start in range(width - 1, -1, -1):
            inside = start < lengths
            lb[:, start] = np.where(inside, lb[:, start + 1], 0.0)
            for k in range(min(most, width - start)):
                end = start + k + 1
                beta[:, start] += np.where(past[:, end] | ~inside, 0.0, prob[grid[:, start, k]] * beta[:, end] * np.exp(lb[:, end] - lb[:, start]))
            beta[:, start], lb[:, start] = _scaled(beta[:, start], lb[:, start], start == lengths)
        whole = np.log(alpha[rows, lengths]) + la[rows, lengths]
        total = np.zeros(self._size)
        for start in range(width):
            for k in range(min(most, width - start)):
                piece, end = grid[:, start, k], start + k + 1
                some = np.flatnonzero((piece > 0) & ~past[:, end])
                if len(some):
                    share = np.exp(la[some, start] + lb[some, end] - whole[some])
                    total += np.bincount(piece[some], alpha[some, start] * prob[piece[some]] * beta[some, end] * share * counts[some], self._size)
        return total


def _scaled(sums: np.ndarray, logs: np.ndarray, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Small sums times a factor, and the logarithm of what was taken out; ``end``: where the sum is one."""
    small = (sums > 0) & (sums < 1e-60)
    if end is not None:
        sums = np.where(end, 1.0, sums)
        logs = np.where(end, 0.0, logs)
        small &= ~end
    factor = np.where(small, sums, 1.0)
    return sums / factor, logs + np.log(factor)


def words_of(text: str) -> list[str]:
    """The words in lower case with the word-start mark."""
    return [" " + w for w in WORD.findall(text.lower())]


#: One table of segmentations per Python worker, for all tasks that it runs.
_LATTICES: dict[str, Lattice] = {}


def lattice_of(model_path: str) -> Lattice:
    if model_path not in _LATTICES:
        _LATTICES[model_path] = Lattice(pieces(model_path))
    return _LATTICES[model_path]


def fit_pieces(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language."""
    counted = Counted(lattice, words, counts)
    prob = np.full(lattice.size, 1.0 / lattice.size)
    prob[0], prob[1] = 0.0, UNKNOWN
    for _ in range(rounds):
        got = counted.expected(prob)
        got[0] = got[1] = 0.0
        got += SMOOTH
        prob = got / got.sum()
        prob[0], prob[1] = 0.0, UNKNOWN
    return prob


def train(docs: DataFrame, model_path: str, sample: int = SAMPLE_DOCS, fit_chars: int = FIT_CHARS) -> tuple[list[str], np.ndarray]:
    """Languages and the piece probabilities [piece, language] from doc_id, text, lang.

    Counting and taking the sample are Spark aggregations; one task per language
    fits its probabilities from the sample's word counts.
    """
    known = docs.filter((fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = materialise(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share")), "shares")
    draw = (F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)) < F.col("share")
    sampled = known.select("doc_id", "text", "lang").join(F.broadcast(share) if share.count() <= SMALL else share, "lang").filter(draw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text) if len(w) <= fit_chars)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = sampled.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")  # sums add up to the same in every run
        prob = fit_pieces(lattice_of(model_path), rows["word"].tolist(), rows["n"].to_numpy(np.float64))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "prob": [prob.tolist()]})

    fitted = sorted(counted.groupBy("lang").applyInPandas(fit, "lang string, prob array<double>").collect(), key=lambda r: r["lang"])
    if not fitted:
        return [], np.zeros((0, 0))
    return [r["lang"] for r in fitted], np.array([r["prob"] for r in fitted]).T


class Scorer:
    """Texts -> best language and its posterior; scores of short words are remembered."""

    def __init__(self, lattice: Lattice, langs: list[str], prob: np.ndarray):
        self._lattice, self._langs, self._prob = lattice, langs, prob
        self._seen: dict[str, int] = {}
        self._scores = np.zeros((0, len(langs)))

    def __call__(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        fresh = list({w for words in texts for w in words if w not in self._seen and len(w) <= SHORT})
        if len(self._seen) + len(fresh) > REMEMBER:
            self._seen, self._scores = {}, np.zeros((0, len(self._langs)))
            fresh = list({w for words in texts for w in words if len(w) <= SHORT})
        if fresh:
            self._seen.update(zip(fresh, range(len(self._seen), len(self._seen) + len(fresh)), strict=True))
            self._scores = np.concatenate([self._scores, word_scores(self._lattice, fresh, self._prob)])
        best, sure = ["und"] * len(texts), np.zeros(len(texts))
        for i, words in enumerate(texts):
            if words:
                short = [self._seen[w] for w in words if len(w) <= SHORT]
                total = self._scores[short].sum(axis=0)
                if len(short) < len(words):
                    total = total + word_scores(self._lattice, [w for w in words if len(w) > SHORT], self._prob).sum(axis=0)
                odds = np.exp(total - total.max())
                k = int(total.argmax())
                best[i], sure[i] = self._langs[k], odds[k] / odds.sum()
        return best, sure


def predict(docs: DataFrame, model_path: str, langs: list[str], prob: np.ndarray) -> DataFrame:
    """doc_id -> lang_pred, score (the posterior of the best language)."""
    # languages x pieces: its size is fixed by the vocabulary, not by the corpus
    sent = docs.sparkSession.sparkContext.broadcast((langs, prob.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        score = Scorer(lattice_of(model_path), names, table.astype(np.float64)) if names else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids = batch.column("doc_id").slice(at, 1000)
                texts = [words_of(t or "") for t in batch.column("text").slice(at, 1000).to_pylist()]
                best, sure = score(texts) if score else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))


def op7_marginal_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    out = predict(docs, path, *train(docs, path))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
