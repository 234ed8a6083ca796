"""Quality classifier by co-training.

Blum and Mitchell, "Combining Labeled and Unlabeled Data with Co-Training"
(1998).  Two naive Bayes classifiers see a document each in their own way: one its
text (which words and pairs of words it has, hashed, and its shape: shares of symbols,
capitals, repeats, word and line lengths, ...), the other its page metadata alone (source,
language, stated length).  The mean log odds of a text's words and pairs weigh as much as
``TEXT_FEATURES`` of its shape.  Each view is calibrated on
labelled documents that it was not fitted on.  In every round each view labels
the unlabelled documents that it is sure of, and those labels are added to what
the other view is fitted on.  At the end the calibrated log odds of both views
are added, the prior counted once.

Features are small integers and ``CONTENT`` bits, computed once from the whole text and stored.  A
round is two passes over them: a histogram for calibration and counts for
fitting, both of a size that depends on the features alone.  Every labelled row
and every confident document takes part.

Defined cases: a null text has the features of an empty one; null metadata are a
value of their own; a document with several labels has their mean, rounded
down at a tie; rows with the same id share its label; without any label of one
of the classes every score is the share of good labels, or 0.5 without a label;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sunder.llm import textkernel as tk
from sunder.plans.scratch import Scratch

BINS = 16
TEXT_FEATURES = 14
SOURCES, LANGS, LENGTHS = 1024, 64, 32
META_FEATURES = 3
WORDS = PAIRS = 4096
CONTENT = WORDS + PAIRS
SHAPE = BINS * TEXT_FEATURES
SIZE = {"t": SHAPE + CONTENT, "m": SOURCES + LANGS + LENGTHS}
SLICE = 2048  # rows whose bits are unpacked at once
HIST, STEP = 240, 0.25  # bins of log odds, and their width


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SETS = [
    _class(b"#*$%&|<>{}[]\\^~_="),
    _class(bytes(range(65, 91))),
    _class(b"0123456789"),
    _class(b"!?"),
    _class(b".,;:'\"-()"),
    _class(b"|"),
    _class(bytes(range(128, 256))),
]


def text_features(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, w: tk.Spans) -> np.ndarray:
    """A row of ``TEXT_FEATURES`` bins for each of rows ``i`` to ``j``."""
    n, a = j - i, offsets[i]
    part = raw[a : offsets[j]]
    ln = tk.lines(raw, offsets, i, j)
    lo, hi = offsets[i:j] - a, offsets[i + 1 : j + 1] - a
    size = np.maximum(hi - lo, 1)
    n_words = np.bincount(w.rows, minlength=n)
    n_lines = np.bincount(ln.rows, minlength=n)
    per = lambda x, by: x / np.maximum(by, 1)
    share = lambda x: np.minimum(BINS - 1, (BINS * np.sqrt(np.clip(x, 0, 1))).astype(np.int64))
    log = lambda x, scale=1.0: np.clip(scale * np.log2(1 + x), 0, BINS - 1).astype(np.int64)
    out = []
    for table in _SETS:
        sums = np.concatenate(([0], np.cumsum(table[part], dtype=np.int64)))
        out.append(share((sums[hi] - sums[lo]) / size))
    same = np.zeros(len(w.rows), bool)
    if len(same):
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.rows[1:] == w.rows[:-1])
    key = tk.mix(w.hashes + tk.mix(w.rows.astype(np.uint64)))
    distinct = np.bincount(w.rows[np.unique(key, return_index=True)[1]], minlength=n)
    line_key = tk.mix(ln.hashes + tk.mix(ln.rows.astype(np.uint64)))
    lines = np.bincount(ln.rows[np.unique(line_key, return_index=True)[1]], minlength=n)
    length = w.ends - w.starts
    out += [
        share(per(np.bincount(w.rows[same], minlength=n), n_words)),
        share(per(distinct, n_words)),
        share(1 - per(lines, n_lines)),
        log(per(np.bincount(w.rows, length, n), n_words), 3),
        share(per(np.bincount(w.rows[length <= 3], minlength=n), n_words)),
        log(n_words),
        log(per(n_words, n_lines), 1.5),
    ]
    return np.stack(out, axis=1) + BINS * np.arange(TEXT_FEATURES)


def content_bits(w: tk.Spans, n: int) -> list[bytes]:
    """Of each row, ``CONTENT`` bits: which hashed words and pairs of neighbouring words it has."""
    flags = np.zeros((n, CONTENT), bool)
    flags[w.rows, (w.hashes & np.uint64(WORDS - 1)).astype(np.int64)] = True
    if len(w.rows) > 1:
        inside = w.rows[1:] == w.rows[:-1]
        pair = tk.mix(w.hashes[:-1] + tk.mix(w.hashes[1:]))[inside]
        flags[w.rows[1:][inside], WORDS + (pair & np.uint64(PAIRS - 1)).astype(np.int64)] = True
    return [x.tobytes() for x in np.packbits(flags, axis=1)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tk.buffers(batch.column("text"))
        for i, j in tk.row_slices(offsets):
            cols = {c: batch.column(c).slice(i, j - i) for c in ("doc_id", "m")}
            w = tk.words(raw, offsets, i, j)
            t = text_features(raw, offsets, i, j, w).astype(np.int16)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, TEXT_FEATURES), pa.int32()), pa.array(t.ravel()))
            yield pa.RecordBatch.from_pydict(cols | {"t": flat, "w": pa.array(content_bits(w, j - i), pa.binary())})


def _metadata():
    """Bins of source, language and stated length; nothing is read from the text."""
    bucket = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("smallint")
    stated = F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0))
    length = F.when(stated < 0, 0).otherwise(F.least(F.lit(LENGTHS - 1), 1 + F.floor(F.log2(1 + stated))))
    return F.array(
        bucket("source", SOURCES, "source"),
        (bucket("lang", LANGS, "lang") + SOURCES).cast("smallint"),
        (length + SOURCES + LANGS).cast("smallint"),
    )


class View:
    """A calibrated naive Bayes classifier: log odds per feature value, and a line from their sum to log odds."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.scale, self.shift = weights, 1.0, 0.0

    @classmethod
    def fit(cls, counts: np.ndarray, widths: list[int]) -> View:
        """``counts``: (2, features) of the bad and the good class; ``widths``: values of each feature."""
        out, at = np.zeros(counts.shape[1]), 0
        for width in widths:
            x = counts[:, at : at + width] + 0.5
            out[at : at + width] = np.log(x[1] / x[1].sum()) - np.log(x[0] / x[0].sum())
            at += width
        # What is left are bits: a document has each or not.
        n = counts[:, : widths[0]].sum(axis=1, keepdims=True)
        x = (counts[:, at:] + 0.5) / (n + 1)
        out[at:] = np.log(x[1]) - np.log(x[0])
        return cls(out)

    def raw(self, features: tuple) -> np.ndarray:
        """``features``: bins, and bits or None."""
        bins, bits = features
        out = self.weights[bins].sum(axis=1)
        if bits is not None:
            out += TEXT_FEATURES * (bits @ self.weights[SHAPE:].astype(np.float32)) / np.maximum(1, bits.sum(axis=1))
        return out

    def odds(self, features: tuple) -> np.ndarray:
        return self.scale * self.raw(features) + self.shift

    def calibrate(self, hist: np.ndarray) -> None:
        """Platt scaling on a (2, HIST) histogram of raw log odds, by Newton steps."""
        x = (np.arange(HIST) - HIST / 2 + 0.5) * STEP
        n = hist.sum(axis=0)
        # Platt's targets keep the fit finite where the classes separate.
        good = (hist[1] * (hist[1].sum() + 1) / (hist[1].sum() + 2)) + hist[0] / (hist[0].sum() + 2)
        b = np.array([0.0, np.log((hist[1].sum() + 1) / (hist[0].sum() + 1))])
        design = np.stack([x, np.ones(HIST)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(b @ design, -40, 40)))
            step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + 1e-6 * np.eye(2), design @ (good - n * p))
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = max(0.0, float(b[0])), float(b[1])


WIDTHS = {"t": [BINS] * TEXT_FEATURES, "m": [SOURCES, LANGS, LENGTHS]}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, tuple]]]:
    """Rows, a few at a time, and the features of each view: bins, and bits (as floats) or None."""
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            batch = whole.slice(k, SLICE)
            x = {v: (batch.column(v).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1), None) for v in ("t", "m")}
            packed = np.frombuffer(b"".join(batch.column("w").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            x["t"] = (x["t"][0], np.unpackbits(packed, axis=1).astype(np.float32))
            yield batch, x


def _counted(features: tuple, which: np.ndarray, size: int) -> np.ndarray:
    """How many of the rows ``which`` have each feature."""
    bins, bits = features
    out = np.bincount(bins[which].ravel(), minlength=size)
    if bits is not None and which.any():
        out[SHAPE:] += (which.astype(np.float32) @ bits).astype(np.int64)
    return out


def _emit(view: str, cls: int, kind: str, values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    n = len(at)
    return pa.RecordBatch.from_pydict({"view": pa.array([view] * n, pa.string()), "cls": pa.array([cls] * n, pa.int32()), "kind": pa.array([kind] * n, pa.string()), "i": pa.array(at, pa.int32()), "n": pa.array(values[at].astype(np.int64))})


def _label_counts(views: dict[str, View] | None, sure: float):
    """Feature counts of labelled rows of the fitting fold; with views, of rows the other view is sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(v, c, k): np.zeros(SIZE[v], np.int64) for v in ("t", "m") for c in (0, 1) for k in ("label", "pseudo")}
        for batch, x in _slices(batches):
            y = batch.column("y").fill_null(-1).to_numpy()
            fit = batch.column("fit").to_numpy(zero_copy_only=False)
            for view, other in (("t", "m"), ("m", "t")):
                for c in (0, 1):
                    total[view, c, "label"] += _counted(x[view], fit & (y == c), SIZE[view])
                    if views is not None:
                        odds = views[other].odds(x[other])
                        confident = (y < 0) & ((odds >= sure) if c else (odds <= -sure))
                        total[view, c, "pseudo"] += _counted(x[view], confident, SIZE[view])
        for (v, c, k), values in total.items():
            yield _emit(v, c, k, values)

    return run


def _histograms(views: dict[str, View]):
    """Histograms of raw log odds of labelled rows outside the fitting fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(v, c): np.zeros(HIST, np.int64) for v in ("t", "m") for c in (0, 1)}
        for batch, x in _slices(batches):
            y = batch.column("y").fill_null(-1).to_numpy()
            fit = batch.column("fit").to_numpy(zero_copy_only=False)
            for (v, c), values in total.items():
                odds = views[v].raw(x[v])[~fit & (y == c)]
                values += np.bincount(np.clip(odds / STEP + HIST / 2, 0, HIST - 1).astype(np.int64), minlength=HIST)
        for (v, c), values in total.items():
            yield _emit(v, c, "hist", values)

    return run


def _scores(views: dict[str, View], prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches):
            t, m = views["t"].odds(x["t"]), views["m"].odds(x["m"])
            sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            both = sigmoid(t + m - prior)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "text_score": pa.array(sigmoid(t)), "meta_score": pa.array(sigmoid(m)), "score": pa.array(both), "keep": pa.array(both >= 0.5)}
            )

    return run


def co_train(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = 3, confidence: float = 0.98, pseudo_weight: float = 1.0) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` of every row of ``docs(doc_id, text, lang, source, n_chars)``.

    The pseudo-labels of a class weigh together at most ``pseudo_weight`` times as much as its labels.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "cotrain")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in ("lang", "source", "n_chars")])
    feats = docs.select("doc_id", "text", _metadata().alias("m")).mapInArrow(_features, "doc_id long, m array<smallint>, t array<smallint>, w binary")
    given = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label)).alias("mean"))
    given = given.where("doc_id is not null and mean is not null").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("y"))
    fit = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)) == 0
    data = scratch.keep(feats.join(given.hint("merge"), "doc_id", "left").withColumn("fit", F.coalesce(fit, F.lit(True))))
    schema = "view string, cls int, kind string, i int, n long"

    def gather(run) -> dict[tuple[str, int, str], np.ndarray]:
        out: dict = {}
        for r in data.mapInArrow(run, schema).groupBy("view", "cls", "kind", "i").agg(F.sum("n").alias("n")).collect():
            out.setdefault((r.view, r.cls, r.kind), np.zeros(HIST if r.kind == "hist" else SIZE[r.view]))[r.i] = r.n
        return out

    views, prior = None, 0.0
    for step in range(rounds + 1):
        counts = gather(_label_counts(views, np.log(confidence / (1 - confidence))))
        zero = {v: np.zeros(SIZE[v]) for v in SIZE}
        labelled = {v: np.stack([counts.get((v, c, "label"), zero[v]) for c in (0, 1)]) for v in SIZE}
        if min(labelled["t"][c].sum() for c in (0, 1)) == 0:
            # One class is missing: nothing can be learned.
            n_bad, n_good = (labelled["t"][c].sum() for c in (0, 1))
            prior = float(np.log((n_good + 1) / (n_bad + 1))) if n_bad + n_good else 0.0
            views = {v: View(np.zeros(SIZE[v])) for v in SIZE}
            for v in views.values():
                v.shift = prior
            break
        fitted = {}
        for v in SIZE:
            pseudo = np.stack([counts.get((v, c, "pseudo"), zero[v]) for c in (0, 1)])
            docs_of = lambda x: x[:, : WIDTHS[v][0]].sum(axis=1, keepdims=True)  # noqa: B023, E731
            mass = pseudo_weight * docs_of(labelled[v]) / np.maximum(docs_of(pseudo), 1)
            fitted[v] = View.fit(labelled[v] + pseudo * np.minimum(1.0, mass), WIDTHS[v])
        hist = gather(_histograms(fitted))
        none = np.zeros(HIST)
        for v in SIZE:
            fitted[v].calibrate(np.stack([hist.get((v, c, "hist"), none) for c in (0, 1)]))
        n_bad, n_good = (sum(hist.get(("t", c, "hist"), none)) for c in (0, 1))
        prior, views = float(np.log((n_good + 1) / (n_bad + 1))), fitted
    return data.mapInArrow(_scores(views, prior), "doc_id long, text_score double, meta_score double, score double, keep boolean")
