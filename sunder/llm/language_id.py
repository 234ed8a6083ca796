"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces of the
product of their probabilities, by a forward pass over its characters; a
text's is the product over its words.  The language under which the whole text is
likeliest wins; the score is its posterior with equal priors.  Words are summed whole, however
long they are: those of up to ``SHORT`` characters many at a time as products, longer
ones one by one in logarithms, which cannot underflow.

Piece probabilities are learned by expectation maximisation (forward and
backward passes give the expected count of each piece) from the words of at most
``per_language`` whole documents of each language, taken in the order of a hash
of their ids.  Nothing but text and language is learned from, nothing but text is
scored.

Defined cases: a null text, one without a letter, or a corpus without a
labelled document gives ``und`` and score 0; languages tie in code point order;
rows with a null id are predicted but not learned from; rows with one id are documents
of their own; rows equal in id, language and text are learned from once and predicted alike; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.llm import textkernel as tk
from sunder.llm.rows import plain
from sunder.llm.sentencepiece import MARK, PieceModel, default_model

SHORT = 32
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
FLOOR = 1e-7  # probability of a character without a piece, in every language


class Vocabulary:
    """Pieces in two hash tables over their characters."""

    SIZE, MORE = 1 << 20, 1 << 17

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in dict.fromkeys(pieces) if p]
        self.ids = {p: k for k, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        n = len(keys)
        self.keys = np.append(keys, _U(0))
        self.first = np.full(self.SIZE, n, np.int32)
        slot = (keys >> _U(44)).astype(np.int64)
        self.first[slot[::-1]] = np.arange(n)[::-1]
        late = np.flatnonzero(self.first[slot] != np.arange(n))
        self.second = np.full(self.MORE, n, np.int32)
        at = (keys[late] & _U(self.MORE - 1)).astype(np.int64)
        if len(np.unique(at)) < len(at):
            raise ValueError("pieces collide in both tables")
        self.second[at] = late

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & (1 << 64) - 1
        return int(tk.mix(np.array([h], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each character hash, or the number of pieces."""
        key = tk.mix(h)
        got = self.first[(key >> _U(44)).astype(np.int64)]
        miss = np.flatnonzero(self.keys[got] != key)
        if len(miss):
            other = self.second[(key[miss] & _U(self.MORE - 1)).astype(np.int64)]
            got[miss] = np.where(self.keys[other] == key[miss], other, len(self.pieces))
        return got

    def spans(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of equal length as rows of code points: (start, end, piece of each), by end."""
        m, n = words.shape
        prefix = np.zeros((n + 1, m), np.uint64)
        power = [_U(pow(int(_P), k, 1 << 64)) for k in range(n + 1)]
        for k in range(n):
            prefix[k + 1] = prefix[k] * _P + words[:, k] + _U(1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                yield start, end, self.find(prefix[end] - prefix[start] * power[end - start])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: their positions and code points, a bounded number at a time."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens) - lens
    for n in np.unique(lens):
        if n:
            every = np.flatnonzero(lens == n)
            for k in range(0, len(every), 20_000):
                at = every[k : k + 20_000]
                yield at, flat[starts[at][:, None] + np.arange(n)].astype(np.uint64)


def _with_floor(prob: np.ndarray) -> np.ndarray:
    """Rows for 'no piece' (zero) and 'a character without a piece' below the pieces' rows."""
    return np.vstack([prob, np.zeros((1, prob.shape[1])), np.full((1, prob.shape[1]), FLOOR)])


def _long_words(words: list[str]) -> tuple[list[int], list[int]]:
    """Positions of the words that are summed many at a time, and of those that are not."""
    long = [k for k, x in enumerate(words) if len(x) > SHORT]
    return ([k for k, x in enumerate(words) if len(x) <= SHORT] if long else list(range(len(words)))), long


def _edges(vocab: Vocabulary, word: str) -> list[tuple[int, int, int]]:
    """(start, end, piece) of all pieces in a word, by end; a character without one has the number of pieces plus 1."""
    ids, none, out = vocab.ids, len(vocab.pieces) + 1, []
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - vocab.longest), end - 1):
            piece = ids.get(word[start:end])
            if piece is not None:
                out.append((start, end, piece))
        out.append((end - 1, end, ids.get(word[end - 1], none)))
    return out


def _forward(edges: list, logs: list[float], n: int, backward: bool = False) -> list[float]:
    """Logarithms of the sums over all segmentations up to each place, or from it."""
    sums: list[list[float]] = [[] for _ in range(n + 1)]
    out = [0.0] * (n + 1)
    done = n if backward else 0
    for start, end, piece in reversed(edges) if backward else edges:
        here, there = (end, start) if backward else (start, end)
        while done != here:
            done += -1 if backward else 1
            top = max(sums[done])
            out[done] = top + math.log(sum([math.exp(x - top) for x in sums[done]]))
        sums[there].append(out[here] + logs[piece])
    while done != (0 if backward else n):
        done += -1 if backward else 1
        top = max(sums[done])
        out[done] = top + math.log(sum([math.exp(x - top) for x in sums[done]]))
    return out


def log_likelihoods(vocab: Vocabulary, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (already marked) in each language."""
    out = np.zeros((len(words), prob.shape[1]))
    table, none = _with_floor(prob), len(vocab.pieces)
    short, long = _long_words(words)
    for at, rows in _by_length([words[k] for k in short]):
        m, n = rows.shape
        alpha = np.zeros((n + 1, m, prob.shape[1]))
        alpha[0] = 1.0
        for start, end, piece in vocab.spans(rows):
            if end == start + 1:
                piece = np.where(piece == none, none + 1, piece)
                alpha[end] += alpha[start] * table[piece]
            else:
                hit = np.flatnonzero(piece != none)
                if len(hit):
                    alpha[end, hit] += alpha[start, hit] * table[piece[hit]]
        out[np.asarray(short)[at]] = np.log(alpha[n])
    if long:
        with np.errstate(divide="ignore"):
            logs = [np.log(table[:, c]).tolist() for c in range(prob.shape[1])]
        for k in long:
            edges = sorted(_edges(vocab, words[k]))
            out[k] = [_forward(edges, x, len(words[k]))[-1] for x in logs]
    return out


def expected_counts(vocab: Vocabulary, prob: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the words, one language: ``prob`` and the result have a row per piece."""
    total = np.zeros(len(vocab.pieces) + 2)
    table, none = _with_floor(prob[:, None])[:, 0], len(vocab.pieces)
    short, long = _long_words(words)
    for at, rows in _by_length([words[k] for k in short]):
        m, n = rows.shape
        found = []
        alpha, beta = np.zeros((n + 1, m)), np.zeros((n + 1, m))
        alpha[0] = beta[n] = 1.0
        for start, end, piece in vocab.spans(rows):
            if end == start + 1:
                piece = np.where(piece == none, none + 1, piece)
            hit = np.flatnonzero(piece != none)
            if len(hit):
                found.append((start, end, hit, piece[hit]))
                alpha[end, hit] += alpha[start, hit] * table[piece[hit]]
        for start, end, hit, piece in sorted(found, key=lambda x: -x[1]):
            beta[start, hit] += table[piece] * beta[end, hit]
        scale = weights[np.asarray(short)[at]] / alpha[n]
        for start, end, hit, piece in found:
            total += np.bincount(piece, alpha[start, hit] * table[piece] * beta[end, hit] * scale[hit], len(total))
    if long:
        with np.errstate(divide="ignore"):
            logs = np.log(table).tolist()
        for k in long:
            n, edges = len(words[k]), _edges(vocab, words[k])
            alpha, beta = _forward(sorted(edges), logs, n), _forward(sorted(edges, key=lambda x: (x[1], x[0])), logs, n, backward=True)
            for start, end, piece in edges:
                total[piece] += weights[k] * math.exp(alpha[start] + logs[piece] + beta[end] - alpha[n])
    return total[:none]


def train(vocab: Vocabulary, counts: dict[str, dict[str, int]], rounds: int = 4, smoothing: float = 0.05) -> np.ndarray:
    """Piece probabilities, a column for each language in order, from word counts by language."""
    out = []
    for lang in sorted(counts):
        words, weights = [MARK + x for x in counts[lang]], np.fromiter(counts[lang].values(), float, len(counts[lang]))
        prob = np.full(len(vocab.pieces), 1.0 / len(vocab.pieces))
        for _ in range(rounds):
            got = expected_counts(vocab, prob, words, weights) + smoothing
            prob = got / got.sum()
        out.append(prob)
    return np.stack(out, axis=1)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _score(pieces: list[str], prob: np.ndarray, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(pieces)
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = True
        for batch in batches:
            raw, offsets = tk.buffers(batch.column("text"))
            for i, j in tk.row_slices(offsets, 4 << 20):
                n, a = j - i, offsets[i]
                w = tk.words(raw, offsets, i, j)
                _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                words = [raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.starts[first], w.ends[first], strict=True)]
                scores = np.zeros((len(words), len(langs)))
                if langs:
                    scores = log_likelihoods(vocab, prob, [MARK + x for x in words])
                total = np.stack([np.bincount(w.rows, scores[back, c], n) for c in range(len(langs))], axis=1) if langs else np.zeros((n, 0))
                sums = np.concatenate(([0], np.cumsum(letters[raw[a : offsets[j]]])))
                some = sums[offsets[i + 1 : j + 1] - a] > sums[offsets[i:j] - a]
                for r in np.flatnonzero(~some & (offsets[i + 1 : j + 1] > offsets[i:j])):
                    some[r] = _has_letter(raw[offsets[i + r] : offsets[i + r + 1]].tobytes().decode("utf-8", "replace"))
                if langs:
                    best = total.argmax(axis=1)
                    top = total[np.arange(n), best]
                    share = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
                else:
                    best, share, some = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(i, n), "held_out": batch.column("held_out").slice(i, n)}
                    | {"lang_pred": pa.array([langs[b] if s else "und" for b, s in zip(best, some, strict=True)], pa.string())}
                    | {"score": pa.array(np.where(some, share, 0.0))}
                )

    return run


def held_out():
    """The fold that is never learned from, by document id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int) -> dict[str, dict[str, int]]:
    """Word counts by language of at most ``per_language`` documents each."""
    rows = plain(docs, ("lang",)).withColumn("lang", F.col("carry.lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.lit("lang"), "kid"), "kid", "th")
    chosen = known.select("kid", "th", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    # At most per_language rows of each language, whatever the corpus; equal rows are one.
    chosen = F.broadcast(chosen.select("kid", "th", "lang").distinct())
    texts = known.join(chosen, ["kid", "th", "lang"]).groupBy("kid", "th", "lang").agg(F.min("text").alias("text"))
    words = texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("word"))
    out: dict[str, dict[str, int]] = {}
    table = words.groupBy("lang", "word").count().toArrow()
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "count")), strict=True):
        out.setdefault(lang, {})[word] = n
    return out


def identify_languages(docs: DataFrame, per_language: int = 200, model_path: str | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text, lang)``."""
    docs = docs.select(*[docs[c].cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))])
    model = PieceModel.load(model_path or default_model())
    pieces = sorted(model.ids, key=model.ids.get)
    counts = learn(docs, per_language)
    vocab = Vocabulary(pieces)
    prob = train(vocab, counts) if counts else np.zeros((len(vocab.pieces), 0))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_score(pieces, prob, sorted(counts)), "doc_id long, held_out boolean, lang_pred string, score double")
