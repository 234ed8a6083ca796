r"""Line dedup by winnowing over line hashes.

A run is a stretch of consecutive lines of a document.  A line is deleted if it
lies in a run of at least ``min_words`` words whose lines occur, in that order,
at an earlier place as well; places are ordered by (doc_id, hash of the row, line).
Lines without a word take no part: they neither break a run nor count in it, and go
with the run around them.

1. Winnowing.  A window is a shortest run with ``min_words`` words, cut at its
   first line or at its last one.  The smallest line hash of a window is its
   fingerprint.  Two places that share a long enough run share a window, and so
   its fingerprint: no repeated run is missed.
2. Positions of fingerprints are joined; windows whose fingerprint occurs at one
   place alone are dropped.
3. Matches are extended both ways: the windows around a fingerprint, those cut at
   their first line and those cut at their last, are compared by their whole
   content, and each that occurs earlier covers its lines.  Windows that overlap
   join to the full repeated run.

Places are only ever reduced to the first of equal ones, by aggregates that
combine before the shuffle, so a line that a third of all documents share makes
no pairs.  First places are written before windows are joined to them, so that
Spark can split the windows of a common passage over tasks.

Defined cases: a null text stays null and counts 0 lines, an empty one has one
line without a word; rows with the same id or without one are documents of their
own; of rows equal in id, text and ``carry`` the first keeps its text and the others
lose what is long enough to be a repeated run; rows with a null id come first in order; an
empty table gives an empty result; columns in ``carry`` pass through, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sunder.llm import textkernel as tk
from sunder.llm.rows import distinct_rows, plain
from sunder.plans.scratch import Scratch

_U = np.uint64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows_of(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, min_words: int) -> dict[str, np.ndarray]:
    """All windows of rows ``i`` to ``j``: row, first and last line, fingerprint and its line, content keys."""
    ln = tk.lines(raw, offsets, i, j)
    w = tk.words(raw, offsets, i, j, hashed=False)
    count = np.bincount(np.searchsorted(ln.starts, w.starts, "right") - 1, minlength=len(ln.rows))
    number = np.arange(len(ln.rows)) - np.searchsorted(ln.rows, ln.rows)
    some = np.flatnonzero(count)
    rows, h, number, count = ln.rows[some], ln.hashes[some], number[some], count[some]
    n = len(some)
    sums = np.concatenate(([0], np.cumsum(count)))
    begin, end = np.searchsorted(rows, rows, "left"), np.searchsorted(rows, rows, "right")
    at = np.arange(n)
    last = np.searchsorted(sums, sums[:-1] + min_words) - 1
    first = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    f, b = last < end, first >= begin
    spans = np.unique(np.concatenate((at[f] * (n + 1) + last[f], first[b] * (n + 1) + at[b]))) if n else np.zeros(0, np.int64)
    s, e = spans // (n + 1), spans % (n + 1)
    low, where = h[s], s.copy()
    for d in range(1, int((e - s).max(initial=0)) + 1):
        k = np.flatnonzero(s + d <= e)
        less = h[s[k] + d] < low[k]
        low[k[less]], where[k[less]] = h[s[k[less]] + d], s[k[less]] + d
    out = {"row": rows[s], "s": number[s], "e": number[e], "p": number[where], "f": low}
    for name, base in (("k1", 0xD6E8FEB86659FD93), ("k2", 0xA0761D6478BD642F)):
        up = np.full(n + 1, _U(base))
        up[0] = 1
        up = np.multiply.accumulate(up)
        down = np.full(n + 1, _U(pow(base, -1, 1 << 64)))
        down[0] = 1
        down = np.multiply.accumulate(down)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(h ^ _U(base)) * up[:n])))
        out[name] = tk.mix((total[e + 1] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.buffers(batch.column("text"))
            for i, j in tk.row_slices(offsets):
                x = windows_of(raw, offsets, i, j, min_words)
                row = pa.array(x.pop("row"))
                keys = {c: batch.column(c).slice(i, j - i).take(row) for c in ("doc_id", "kid", "th")}
                yield pa.RecordBatch.from_pydict(keys | {k: pa.array(v.astype(np.int32) if k in "sep" else v.view(np.int64)) for k, v in x.items()})

    return run


def _without(text: str, gone: np.ndarray) -> tuple[str, int, int]:
    """The text without some of its lines, how many these are, and their words."""
    lines = text.split("\n")
    words = sum(len(_WORD.findall(x)) for x, out in zip(lines, gone, strict=True) if out)
    return "\n".join(x for x, out in zip(lines, gone, strict=True) if not out), int(gone.sum()), words


def _cut(min_words: int):
    """Remove the lines that ``spans`` cover; ``again`` is what is left of a row that equals an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n_lines = {"once": [], "again": []}, []
            times = batch.column("times").to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                text = batch.column("text")[k].as_py()
                n = 0 if text is None else text.count("\n") + 1
                n_lines.append(n)
                left = same = (text, 0, 0)
                if spans:
                    gone = np.zeros(n + 1, np.int64)
                    for x in spans:
                        gone[x["s"]] += 1
                        gone[x["e"] + 1] -= 1
                    left = _without(text, np.cumsum(gone)[:-1] > 0)
                if times[k] > 1 and text is not None:
                    some = [i for i, x in enumerate(text.split("\n")) if _WORD.search(x)]
                    if len(_WORD.findall(text)) >= min_words:
                        at = np.arange(n)
                        same = _without(text, (at >= some[0]) & (at <= some[-1]))
                rows["once"].append(left)
                rows["again"].append(same)
            cols = {c: batch.column(c) for c in ("doc_id", "carry", "times") if c in batch.schema.names} | {"n_lines": pa.array(n_lines, pa.int64())}
            for name, values in rows.items():
                parts = zip(*values, strict=True) if values else ((), (), ())
                cols[name] = pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in zip(parts, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["text", "lines", "words"])
            yield pa.RecordBatch.from_pydict(cols)

    return run


def dedup_lines(docs: DataFrame, min_words: int = 50, carry: tuple = ()) -> DataFrame:
    """``doc_id``, the text without later repeated runs, ``n_lines, n_removed_lines, n_removed_words``, and ``carry`` as a struct."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = plain(docs, carry, *carry)
    seen = scratch.keep(
        rows.select("doc_id", "kid", "th", "text").mapInArrow(_windows(min_words), "doc_id long, kid long, th long, s int, e int, p int, f long, k1 long, k2 long")
    )
    place = F.struct("doc_id", "th", "p")
    shared = scratch.keep(seen.groupBy("f").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("f"))
    met = scratch.keep(seen.join(shared, "f", "left_semi").drop("p", "f"))
    scratch.drop(seen, shared)
    start = F.struct("doc_id", "th", "s")
    first = met.groupBy("k1", "k2").agg(F.min(start).alias("lo"), F.max(start).alias("hi")).where("lo <> hi")
    first = scratch.keep(first.select("k1", "k2", "lo"))
    later = met.join(first, ["k1", "k2"]).where(start != F.col("lo"))
    # At most one span for each pair of a row's lines, however often the row is there.
    spans = later.groupBy("kid", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    kept = ["doc_id", "text", *(["carry"] if carry else [])]
    joined = distinct_rows(rows, *kept).join(spans, ["kid", "th"], "left").select(*kept, "times", "spans")
    part = "struct<text:string,lines:long,words:long>"
    schema = "doc_id long, " + (f"carry {rows.schema['carry'].dataType.simpleString()}, " if carry else "") + f"times long, n_lines long, once {part}, again {part}"
    cut = joined.mapInArrow(_cut(min_words), schema).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    own = F.when(F.col("nth") == 1, F.col("once")).otherwise(F.col("again"))
    cut = cut.withColumn("own", own)
    return cut.select(
        "doc_id", *(["carry"] if carry else []), F.col("own.text").alias("text"), "n_lines", F.col("own.lines").alias("n_removed_lines"), F.col("own.words").alias("n_removed_words")
    )
