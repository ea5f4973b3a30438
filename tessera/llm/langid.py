"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by a forward algorithm; a
text's is the product over its words. The piece probabilities are fitted by expectation
maximisation over the same segmentations, on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._joins import join_checked
from tessera.llm._sampling import smallest
from tessera.llm._storage import saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled texts of each language that the model is fitted on at most: those with the smallest hash of the text.
SAMPLE_DOCS = 600
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Longer words are gone through one by one, with numbers kept in range. They are scored, but teach nothing.
_LONG = 64
_BEGIN = "▁"
#: Words whose probabilities a worker keeps.
_KEPT = 400_000


def pieces_of(vocabulary: str = VOCABULARY) -> list[str]:
    """Pieces of letters of a public vocabulary file, the word-begin mark included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted({p.lower() for p in found if (q := p.removeprefix(_BEGIN)) and q.isalpha()} | {_BEGIN})


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # numbers that are no digits (fractions, Roman numerals) are word characters, but no letters
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def prefix_table(pieces: Sequence[str]) -> dict[str, int]:
    """Number of each piece, and -1 for each beginning of a piece that is none itself."""
    table = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
    table.update((p, i) for i, p in enumerate(pieces))
    return table


class Lattice:
    """All segmentations of words: edges (word, begin, end, piece), in the order of their ends.

    ``unseen`` is the number of the piece that stands for a letter that the vocabulary lacks.
    """

    def __init__(self, words: list[str], table: dict[str, int], unseen: int) -> None:
        places, pieces, counts = [], [], []
        find, place, take = table.get, places.append, pieces.append
        for w in words:
            w = _BEGIN + w
            size, before = len(w), len(pieces)
            for i in range(size):
                k = find(w[i])
                if k is None or k < 0:
                    place(i << 8 | i + 1), take(unseen)
                else:
                    place(i << 8 | i + 1), take(k)
                if k is None:
                    continue
                for j in range(i + 2, size + 1):
                    k = find(w[i:j])
                    if k is None:
                        break
                    if k >= 0:
                        place(i << 8 | j), take(k)
            counts.append(len(pieces) - before)
        self.n, self.sizes = len(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
        word, at, piece = np.repeat(np.arange(self.n), counts), np.array(places, np.int64), np.array(pieces, np.int64)
        # edges come by word: a stable sort by end keeps that order
        order = np.argsort(at & 255, kind="stable")
        self.word, self.begin, self.end, self.piece = word[order], at[order] >> 8, at[order] & 255, piece[order]

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """(words, places, languages) sums over the segmentations of each beginning."""
        most = int(self.sizes.max(initial=0))
        alpha = np.zeros((self.n, most + 1, probs.shape[1]))
        alpha[:, 0] = 1
        cuts = np.searchsorted(self.end, np.arange(most + 2))
        for j in range(1, most + 1):
            s = slice(cuts[j], cuts[j + 1])
            if cuts[j + 1] > cuts[j]:
                w = self.word[s]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                alpha[w[first], j] = np.add.reduceat(alpha[w, self.begin[s]] * probs[self.piece[s]], first, axis=0)
        return alpha

    def backward(self, probs: np.ndarray) -> np.ndarray:
        most = int(self.sizes.max(initial=0))
        beta = np.zeros((self.n, most + 1, probs.shape[1]))
        beta[np.arange(self.n), self.sizes] = 1
        order = np.lexsort((self.word, -self.begin))
        word, begin, end, piece = (x[order] for x in (self.word, self.begin, self.end, self.piece))
        cuts = np.searchsorted(-begin, np.arange(-most, 2))
        for k, i in enumerate(range(most, -1, -1)):
            s = slice(cuts[k], cuts[k + 1])
            if cuts[k + 1] > cuts[k]:
                w = word[s]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                beta[w[first], i] = np.add.reduceat(beta[w, end[s]] * probs[piece[s]], first, axis=0)
        return beta

    def totals(self, probs: np.ndarray) -> np.ndarray:
        return self.forward(probs)[np.arange(self.n), self.sizes]


def log_total(word: str, table: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all segmentations of one word of any length, for each language."""
    word, longest, unseen = _BEGIN + word, max(map(len, table), default=1), len(probs) - 1
    sums, scale = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for j in range(1, len(word) + 1):
        k = table.get(word[j - 1])
        new = sums[-1] * probs[unseen if k is None or k < 0 else k]
        for n in range(2, min(longest, j) + 1):
            k = table.get(word[j - n : j])
            if k is not None and k >= 0:
                new = new + sums[-n] * probs[k]
        sums = [*sums[1 - longest :], new] if longest > 1 else [new]
        if new.min() < 1e-100:
            sums, scale = [x / new for x in sums], scale + np.log(new)
    return np.log(sums[-1]) + scale


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probs: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Word scores of one worker, kept for words that come again."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pieces = prefix_table(model.pieces)
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 14, len(model.languages)))

    def of_words(self, words: list[str]) -> np.ndarray:
        """(words, languages) natural logs of the words' probabilities."""
        out = np.empty((len(words), len(self.model.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= _LONG]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            out[part] = np.log(np.maximum(Lattice([words[i] for i in part], self.pieces, len(self.model.pieces)).totals(self.model.probs), 1e-300))
        for i, w in enumerate(words):
            if len(w) > _LONG:
                out[i] = log_total(w, self.pieces, self.model.probs)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior probability); no letter: ("und", 0)."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = [Counter(words_of(t or "")) for t in texts]
        new = list({w for c in counts for w in c if w not in self.place})
        if len(self.place) + len(new) > _KEPT:
            self.place = {}
            new = list({w for c in counts for w in c})
        if new:
            n = len(self.place)
            while len(self.table) < n + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = self.of_words(new)
            self.place.update(zip(new, range(n, n + len(new))))
        place = self.place
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            sums = np.fromiter(c.values(), float, len(c)) @ self.table[[place[w] for w in c]]
            best = int(sums.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(np.minimum(sums - sums[best], 0)).sum())))
        return out


def fit(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = 4, smoothing: float = 0.02) -> Model:
    """Model from (language, word, count), by expectation maximisation on this process."""
    languages = tuple(sorted({c[0] for c in counts}))
    table = prefix_table(pieces)
    probs = np.zeros((len(pieces) + 1, len(languages)))
    for k, language in enumerate(languages):
        own = [(w, n) for a, w, n in counts if a == language and len(w) <= _LONG]
        p = np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1))
        lattices = [(Lattice([w for w, _ in own[at : at + 5000]], table, len(pieces)), np.array([n for _, n in own[at : at + 5000]], float)) for at in range(0, len(own), 5000)]
        for _ in range(rounds):
            expected = np.zeros(len(p))
            for lattice, n in lattices:
                a, b = lattice.forward(p)[..., 0], lattice.backward(p)[..., 0]
                z = b[:, 0]
                share = a[lattice.word, lattice.begin] * p[lattice.piece, 0] * b[lattice.word, lattice.end] * (n / np.maximum(z, 1e-300))[lattice.word]
                expected += np.bincount(lattice.piece, weights=share, minlength=len(p))
            p = ((expected + smoothing) / (expected.sum() + smoothing * len(p)))[:, None]
        probs[:, k] = p[:, 0]
    return Model(languages, tuple(pieces), probs)


def word_counts(sample: DataFrame) -> list[tuple[str, str, int]]:
    """(language, word, count) of the sample (lang, text); its size is bounded by that of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    found[lang, w] += n
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    return sorted((r["lang"], r["word"], r["n"]) for r in rows)


def held_out(key: str):
    """Whether the crc32 of the key as text is divisible by 5; a row without a key isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, sample: int = SAMPLE_DOCS) -> Model:
    """Model from the rows of ``docs`` that aren't held out and have text and language; equal texts of a language count once."""
    usable = docs.where(~held_out(key) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    usable = usable.select(F.xxhash64(text).alias("mark"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = saved(smallest(usable.select("mark", "lang").distinct(), "mark", sample, "lang"))
    texts = join_checked(usable, chosen, ["mark", "lang"], "left_semi").groupBy("mark", "lang").agg(F.min("text").alias("text"))
    return fit(word_counts(texts), pieces_of(vocabulary))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row of ``docs``; reads nothing but key and text."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = given.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(key, held_out, lang_pred, score) for each row of ``docs``; learned from the rows not held out.

    lang_pred: the likeliest learned language, ``und`` if the text is null or has no letter;
    score: its posterior probability (equal priors), 0 with ``und``.

    Ties go to the first language by name; repeated rows get the same result each; rows without
    a key are learned from, and rows that share a key or a text don't crowd others out; words and texts of
    any length are scored whole; with no labelled text at all every row is ``und``; an empty table
    gives an empty result. The model sees at most ``sample`` texts of each language.
    """
    found = predict(docs, train(docs, key, text, lang, vocabulary, sample), key, text)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
