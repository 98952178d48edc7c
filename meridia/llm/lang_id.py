"""Operator 1: language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of
a word is the sum, over all its segmentations into pieces, of the product of the pieces'
probabilities: a forward algorithm, run for many words at once. A text's score is the sum of
its words' logarithms, and the languages' scores make a posterior under equal priors.

Training is expectation-maximisation with the forward-backward algorithm on the words of a
bounded sample: at most ``sample_rows`` documents of each language, those with the least hash of
their ids among the rows with a language that are not held out, and words of at most TRAIN_CHARS. Prediction reads
the text alone.

Defined results: `und` with score 0 for null texts, texts without a letter, and where
nothing could be learned; null doc_id is not held out. Texts of any length are scored
whole; words of any length too (the sums are rescaled on the way). Ties go to the
language that sorts first. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Longest piece of the public vocabulary in characters, with the sign for a word's start.
MAX_PIECE = 16
#: Chance of a character that is no piece.
UNKNOWN = 1e-7
SAMPLE_ROWS = 256
ROUNDS = 4
#: Longest word of the training sample, in characters. Words from LONG on are summed one by one, in bounded memory.
TRAIN_CHARS, LONG = 1024, 33
#: Entries of the worker's cache of scored words, and characters of the longest kept.
CACHE_WORDS, CACHE_CHARS = 500_000, 48
_START = "▁"
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def vocabulary(model_file: str) -> list[str]:
    """The pieces that lower-case words can contain, of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    fits = {p for p in pieces if p == p.lower() and p.lstrip(_START).isalpha() and _START not in p[1:]}
    if max(map(len, fits), default=0) > MAX_PIECE:
        raise ValueError("a piece is longer than MAX_PIECE")
    return sorted(fits | {_START})


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words (with the sign for a start), zero-padded to ``width``."""
    joined = "".join([(_START + w).ljust(width, "\0") for w in words])
    return np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(words), width).astype(np.uint64)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes (polynomials modulo 2**64), and the powers of the base."""
    n, width = codes.shape
    with np.errstate(over="ignore"):
        powers = np.ones(width + 1, np.uint64)
        for j in range(width):
            powers[j + 1] = powers[j] * _BASE
        h = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            h[:, j + 1] = h[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return h, powers


class Pieces:
    """Looks substrings up in the vocabulary by hash."""

    def __init__(self, pieces: list[str]):
        keys = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = 0
                for c in p:
                    h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
                keys[i] = h
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def find(self, h: np.ndarray, powers: np.ndarray, i: int, j: int) -> np.ndarray:
        """For each word the piece that its characters i to j are, or -1."""
        with np.errstate(over="ignore"):
            want = h[:, j] - h[:, i] * powers[j - i]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], -1)


class Model:
    """probs: a row for each piece, and at last one for what is no piece; a column for each language."""

    def __init__(self, langs: list[str], pieces: Pieces, probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(langs)))

    def forward(self, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log of the sums over all segmentations (words x languages).

        counts (words x languages): then also the pieces' expected counts, by the backward sums."""
        k = self.probs.shape[1]
        out = np.zeros((len(words), k))
        expected = np.zeros((len(self.probs), k)) if counts is not None else None
        order = sorted(range(len(words)), key=lambda x: len(words[x]))
        at = 0
        while at < len(order):
            width = len(words[order[at]]) + 1
            stop = at
            while stop < len(order) and len(words[order[stop]]) + 1 == width and (stop == at or (stop - at) * width < 60_000):
                stop += 1
            who = order[at:stop]
            at = stop
            h, powers = _hashes(_codes([words[x] for x in who], width))
            alpha = np.zeros((len(who), width + 1, k))
            alpha[:, 0] = 1
            log = np.zeros((len(who), k))
            scale_at = {}
            steps = {}
            for j in range(1, width + 1):
                total = np.zeros((len(who), k))
                for i in range(max(0, j - MAX_PIECE), j):
                    found = self.pieces.find(h, powers, i, j)
                    if j - i > 1:
                        rows = np.flatnonzero(found >= 0)
                        if not len(rows):
                            continue
                        total[rows] += alpha[rows, i] * self.probs[found[rows]]
                    else:
                        rows = slice(None)
                        total += alpha[:, i] * self.probs[found]
                    if counts is not None:
                        steps[i, j] = rows, found[rows]
                alpha[:, j] = total
                if j % 16 == 0 and j < width and counts is None:  # keep the numbers within range
                    s = total.copy()
                    alpha[:, max(0, j - MAX_PIECE) : j + 1] /= s[:, None]
                    log += np.log(s)
            end = alpha[:, width]
            out[who] = np.log(end) + log
            if counts is not None:
                beta = np.zeros_like(alpha)
                beta[:, width] = counts[who] / end
                for j in range(width, 0, -1):
                    for i in range(max(0, j - MAX_PIECE), j):
                        if (i, j) in steps:
                            rows, found = steps[i, j]
                            part = self.probs[found] * beta[rows, j]
                            np.add.at(expected, found, alpha[rows, i] * part)
                            beta[rows, i] += part
        return out, expected

    def _steps(self, word: str):
        """For each end in the word (with its sign) the pieces that stop there, (length, row) pairs; by stretches of the word."""
        s = _START + word
        for lo in range(0, len(s), 4096):
            before = min(lo, MAX_PIECE - 1)
            part = s[lo - before : lo + 4096]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)[None]
            h, powers = _hashes(codes)
            stops = np.arange(before + 1, len(part) + 1)
            table = np.full((len(stops), MAX_PIECE), -2, np.int64)
            with np.errstate(over="ignore"):
                for size in range(1, min(MAX_PIECE, len(part)) + 1):
                    at = np.flatnonzero(stops >= size)
                    want = h[0, stops[at]] - h[0, stops[at] - size] * powers[size]
                    place = np.minimum(np.searchsorted(self.pieces.keys, want), len(self.pieces.keys) - 1)
                    hit = self.pieces.keys[place] == want
                    table[at, size - 1] = np.where(hit, self.pieces.order[place], -1 if size == 1 else -2)
            for row in table:
                yield [(size + 1, int(row[size])) for size in np.flatnonzero(row != -2)]

    def long_word(self, word: str) -> np.ndarray:
        """forward() of one word of any length: only the sums of the last characters are held."""
        last = [np.ones(self.probs.shape[1])]
        log = np.zeros_like(last[0])
        for j, steps in enumerate(self._steps(word), 1):
            last = [*last[-MAX_PIECE + 1 :], sum(last[-size] * self.probs[row] for size, row in steps)]
            if j % 16 == 0:
                log += np.log(last[-1])
                last = [x / last[-1] for x in last]
        return np.log(last[-1]) + log

    def long_expected(self, word: str, counts: np.ndarray, expected: np.ndarray) -> None:
        """Adds the pieces' expected counts in one word, with sums in logarithms both ways."""
        steps = list(self._steps(word))
        n = len(steps)
        logs = np.log(self.probs)

        def plus(terms):
            top = np.max(terms, axis=0)
            return top + np.log(np.exp(np.array(terms) - top).sum(axis=0))

        alpha = [np.zeros(self.probs.shape[1])]
        for found in steps:
            alpha.append(plus([alpha[-size] + logs[row] for size, row in found]))
        into: list[list] = [[] for _ in range(n + 1)]
        beta = [np.zeros(0)] * (n + 1)
        for j in range(n, -1, -1):
            beta[j] = plus(into[j]) if j < n else np.zeros_like(alpha[0])
            for size, row in steps[j - 1] if j else ():
                value = logs[row] + beta[j]
                into[j - size].append(value)
                expected[row] += counts * np.exp(alpha[j - size] + value - alpha[n])

    def text_scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the languages' logarithms, or None if it has no letter."""
        split = [_WORDS.findall(t.lower()) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, own = self.cache, {}
        new = list({w for words in split for w in words if w not in cache})
        if new:
            letters = sorted((w for w in new if any(map(str.isalpha, w))), key=len)
            short = [w for w in letters if len(w) < LONG]
            scores = [*(self.forward(short)[0] if short else ()), *map(self.long_word, letters[len(short) :])]
            first = len(cache) + 1
            need = first + len(new) + 1
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((need, len(self.langs)))])
            keep = [(w, s) for w, s in zip(letters, scores) if len(w) <= CACHE_CHARS]
            for n, (w, s) in enumerate(keep, first):
                cache[w] = n
                self.rows[n] = s
            own = {w: s for w, s in zip(letters, scores) if len(w) > CACHE_CHARS}
            own |= {w: None for w in set(new) - set(letters)}  # marks that count as word characters but are no letters
        out = []
        for words in split:
            extra = [own[w] for w in words if w in own] if own else []
            rows = np.array([cache[w] for w in words if w in cache] if own else [cache[w] for w in words], np.int64)
            extra = [e for e in extra if e is not None]
            out.append(self.rows[rows].sum(axis=0) + sum(extra, np.zeros(len(self.langs))) if len(rows) or extra else None)
        return out


def train(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counts: for each language, how often each word occurs."""
    langs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c if len(w) <= TRAIN_CHARS}, key=lambda w: (len(w), w))
    short = [w for w in words if len(w) < LONG]
    n = np.array([[counts[g].get(w, 0) for g in langs] for w in words], float).reshape(len(words), len(langs))
    lookup = Pieces(pieces)
    probs = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    probs[-1] = UNKNOWN
    model = Model(langs, lookup, probs)
    for _ in range(rounds):
        seen = np.zeros_like(probs)
        for at in range(0, len(short), 20_000):
            seen += model.forward(short[at : at + 20_000], n[at : at + 20_000])[1]
        for w, c in zip(words[len(short) :], n[len(short) :]):
            model.long_expected(w, c, seen)
        pooled = seen[:-1].sum(axis=1, keepdims=True) + 1e-3
        smooth = seen[:-1] + 20 * pooled / pooled.sum() + 1e-4
        model.probs = np.concatenate([smooth / smooth.sum(axis=0), np.full((1, len(langs)), UNKNOWN)])
    return model


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> dict[str, dict[str, int]]:
    """Word counts by language of the bounded training sample."""
    ids = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~is_held_out(docs[id_col])).select(
        docs[lang_col].alias("lang"), docs[id_col].alias("id"), F.xxhash64(docs[id_col], F.lit(11)).alias("r")
    )
    ids = bounded_sample(ids, "lang", "r", sample_rows).select("id").distinct()
    chosen = docs.join(ids, docs[id_col].eqNullSafe(ids["id"]), "left_semi")  # sample_rows for each language
    chosen = chosen.filter(docs[lang_col].isNotNull()).select(docs[lang_col].alias("lang"), F.lower(docs[text_col]).alias("text"))
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(0)))
    counted: dict[str, dict[str, int]] = {}
    for lang, w, n in chosen.select("lang", word.alias("word")).groupBy("lang", "word").count().toLocalIterator():
        counted.setdefault(lang, {})[w] = n
    return counted


#: The model of the worker process, by name, with its cache.
_models: dict[str, Model] = {}


def predict(docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per document."""
    counts = sample_words(docs, id_col, text_col, lang_col, sample_rows)
    pieces = vocabulary(vocab_file)
    model = train(counts, pieces) if counts else None
    # Pieces times languages numbers: a few MB, whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.langs, pieces, model.probs) if model else None)

    def run(batches):
        if sent.value is None:
            mine = None
        else:
            key, langs, names, probs = sent.value
            if key not in _models:
                _models.clear()
                _models[key] = Model(langs, Pieces(names), probs)
            mine = _models[key]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(2).to_pylist()
                best, score = [], []
                for s in mine.text_scores(texts) if mine else [None] * len(texts):
                    if s is None:
                        best.append("und")
                        score.append(0.0)
                    else:
                        top = int(np.argmax(s))
                        best.append(mine.langs[top])
                        score.append(float(1 / np.exp(s - s[top]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), is_held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return d.mapInArrow(run, SCHEMA)
