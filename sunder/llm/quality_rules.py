r"""Quality rules, line first.

Every line is judged alone by the rules below.  Lines that fail are removed,
and a document that loses more than ``max_lost`` of its words, or fails one of
the document-wide base rules, is rejected.

Line rules (a line without a word always passes):

* punctuation: more than 3 symbols ``#*$%&|<>`` or exclamation marks to 10 words; or an
  ellipsis at the end of at most 12 words, as of a teaser;
* navigation: at least two ``|`` or ``»`` and at least one for every 4 words; at
  least 5 words whose ASCII letters are capitals for over nine tenths; a
  bullet before at most 4 words without a full stop; or one of at least 4 lines
  with a word in a row, of at most 4 words each, that end without punctuation;
* boilerplate: a licence, cookie, script or rights notice, or a call to act, where
  it is most of the line (``NOTICES``: the phrases, and the most words that the line may have);
* repetition: at least 10 words, of which fewer than a quarter differ from
  the word before.

Defined cases: a null or empty text has zero words and fails the base rules;
nulls in other columns do not matter; repeated rows and ids are judged row by
row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sunder.llm import textkernel as tk

_GAP = r"[\x20\x09-\x0D]*"
# Phrases that mark a boilerplate line, and the most words of such a line.
NOTICES = (
    (
        r"(?i)(licensed under|released under the|all rights reserved|cookie policy|uses? cookies|lorem ipsum|copyright \(c\)|"
        r"spdx-license-identifier|(enable|requires?|turn on) javascript|javascript (is|must be) (enabled|disabled|required))",
        24,
    ),
    (r"(?i)(privacy policy|terms of use|terms of service)", 10),
    (rf"(?i)^{_GAP}(read more|continue reading|click here|share this|follow us|sign up|log in|subscribe)\b", 6),
)
# Characters that end a sentence or close one, and bullets.
ENDED = rf"[.!?:;,\"')\]”’»…。！？]{_GAP}$"
ELLIPSIS = rf"(\.\.\.|…){_GAP}$"
BULLET = rf"^{_GAP}[-*•·‣◦▪►][\x20\x09]"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

FIELDS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed_lines long, removed_words long"
)


def _in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _BANG, _PIPE = _in(SYMBOLS), _in(b"!"), _in(b"|")
_UPPER, _LOWER = _in(bytes(range(65, 91))), _in(bytes(range(97, 123)))


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of set flags in each span."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends] - sums[starts]


def _in_menu(rows: np.ndarray, in_line: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """Lines that stand in a row of at least 4 short ones without an end; lines without a word do not count."""
    out = np.zeros(len(rows), bool)
    some = np.flatnonzero(in_line)
    if len(some):
        short = (in_line[some] <= 4) & ~ended[some]
        start = np.ones(len(some), bool)
        start[1:] = (short[1:] != short[:-1]) | (rows[some][1:] != rows[some][:-1])
        run = np.cumsum(start) - 1
        out[some] = short & (np.bincount(run)[run] >= 4)
    return out


def judge(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, max_lost: float) -> dict:
    """Counts and verdicts of rows ``i`` to ``j``, and what concerns their lines."""
    n, a = j - i, offsets[i]
    w = tk.words(raw, offsets, i, j)
    ln = tk.lines(raw, offsets, i, j)
    part = raw[a : offsets[j]]
    per_row = lambda rows, weights=None: np.bincount(rows, weights, n).astype(np.int64)
    n_words = per_row(w.rows)
    line_of = np.searchsorted(ln.starts, w.starts, "right") - 1
    in_line = np.bincount(line_of, minlength=len(ln.rows))
    s, e = ln.starts - a, ln.ends - a
    symbols = _between(_SYMBOL[part], s, e)
    bangs = _between(_BANG[part], s, e)
    pipes = _between(_PIPE[part], s, e)
    upper = _between(_UPPER[part], s, e)
    letters = upper + _between(_LOWER[part], s, e)
    guillemet = np.zeros(len(part), bool)
    if len(part) > 1:
        guillemet[:-1] = (part[:-1] == 0xC2) & (part[1:] == 0xBB)
    pipes_all = pipes + _between(guillemet, s, e)
    changed = np.zeros(len(ln.rows), np.int64)
    if len(w.hashes):
        fresh = np.ones(len(w.hashes), bool)
        fresh[1:] = (w.hashes[1:] != w.hashes[:-1]) | (line_of[1:] != line_of[:-1])
        changed = np.bincount(line_of[fresh], minlength=len(ln.rows))
    whole = pa.LargeStringArray.from_buffers(
        len(s), pa.py_buffer(np.append(s, len(part)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part))
    )
    match = lambda pattern: pc.match_substring_regex(whole, pattern).to_numpy(zero_copy_only=False)
    ended = match(ENDED)
    phrase = np.zeros(len(s), bool)
    for pattern, most in NOTICES:
        phrase |= (in_line <= most) & match(pattern)
    failed = (in_line > 0) & (
        (10 * (symbols + bangs) > 3 * in_line)
        | ((in_line <= 12) & match(ELLIPSIS))
        | ((pipes_all >= 2) & (4 * pipes_all >= in_line))
        | ((in_line >= 5) & (10 * upper > 9 * letters))
        | ((in_line <= 5) & ~ended & match(BULLET))
        | _in_menu(ln.rows, in_line, ended)
        | phrase
        | ((in_line >= 10) & (4 * changed < in_line))
    )
    removed_words = per_row(ln.rows, in_line * failed)
    # Lines with a word that equal an earlier one.
    some = in_line > 0
    keys = tk.mix(ln.hashes[some] + tk.mix(ln.rows[some].astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    distinct = per_row(ln.rows[some][first])
    n_dup = per_row(ln.rows[some]) - distinct
    # Words inside 3-word windows that the text holds at least twice.
    covered = np.zeros(len(w.rows), bool)
    if len(w.rows) >= 3:
        h = w.hashes
        inside = w.rows[:-2] == w.rows[2:]
        key = tk.mix(h[:-2] + tk.mix(h[1:-1] + tk.mix(h[2:] + tk.mix(w.rows[:-2].astype(np.uint64)))))
        at = np.flatnonzero(inside)
        _, back, times = np.unique(key[at], return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        for k in range(3):
            covered[again + k] = True
    n_repeat = per_row(w.rows[covered])
    code_points = _between((part & 0xC0) != 0x80, w.starts - a, w.ends - a)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": per_row(w.rows, code_points),
        "n_symbols": per_row(ln.rows, symbols),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (removed_words <= max_lost * n_words),
        "n_lines": per_row(ln.rows),
        "n_removed_lines": per_row(ln.rows, failed),
        "removed_words": removed_words,
        "_lines": (ln, failed),
    }


def _apply(max_lost: float, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.buffers(batch.column("text"))
            for i, j in tk.row_slices(offsets):
                out = judge(raw, offsets, i, j, max_lost)
                ln, failed = out.pop("_lines")
                cols = {c: batch.column(c).slice(i, j - i) for c in ("doc_id", "carry") if c in batch.schema.names} | {k: pa.array(v) for k, v in out.items()}
                if with_text:
                    texts = batch.column("text").slice(i, j - i).to_pylist()
                    for r in np.unique(ln.rows[failed]):
                        lo, hi = np.searchsorted(ln.rows, [r, r + 1])
                        texts[r] = "\n".join(x for x, bad in zip(texts[r].split("\n"), failed[lo:hi], strict=True) if not bad)
                    cols["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def line_first_quality(docs: DataFrame, max_lost: float = 0.5, with_text: bool = False, carry: tuple = ()) -> DataFrame:
    """Counts, verdict and, with ``with_text``, the cleaned text of every row of ``docs(doc_id, text)``; ``carry`` as a struct."""
    extra = [F.struct(*[docs[c] for c in carry]).alias("carry")] if carry else []
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *extra)
    schema = FIELDS.replace("doc_id long,", "doc_id long," + (f" carry {rows.schema['carry'].dataType.simpleString()}," if carry else "")) + (", text string" if with_text else "")
    return rows.mapInArrow(_apply(max_lost, with_text), schema)
