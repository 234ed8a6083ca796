r"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles.  Two documents link when
``100 * intersection >= percent * union``.  The join is exact:

1. Equal sets become one member from the start, so copies never meet as pairs.
2. Trees are spread over the cluster by rare shingles.  Shingles have one order
   for all documents: those of many documents last (by counts over all of them, in
   ``CELLS`` cells), the others by hash.  Of two sets that link, the first common shingle
   is one of the first ``n - ceil(n * percent / 100) + 1`` of either, and of the first
   ``n - ceil(2 * n * percent / (100 + percent)) + 1`` of the smaller one.  A tree is the
   members that have one such shingle, without those that no other's size and place fit,
   cut where sizes leave a gap; trees with the same members are one tree.
3. Leaves of a tree hold a bitmap of their whole set, as wide as the set is large
   (``LOAD`` shingles to a bit at most), inner nodes the OR of their children's bitmaps and
   the range of their sizes.  A dual traversal drops every pair of nodes whose
   largest possible overlap is below the smallest one that a link needs.
   Bitmaps of unlike width are compared at the smaller one, to which the wider is folded.
   Members are dealt to blocks of ``BLOCK`` by hash, and blocks meet in parallel, so that
   no task gathers a large tree.
4. Of the pairs that survive in a tree, a spanning forest of the likeliest ones is compared
   as full sets first, and links become components.  Then those members that have further
   pairs meet again, with bitmaps of ``FINE`` shingles to a bit at most, but only across
   components: where two members are in one component already, their pair cannot
   add anything.  What survives is compared as full sets.  That is the plan for trees of every size.

The order of shingles and the choice of the first pairs decide how much work there is, never the result.
Links inside a component are therefore not counted, only components are returned.

Defined cases: null and empty texts, and texts without a word, have no shingle
and link with nothing; with fewer words than a shingle the whole sequence is
the one shingle; rows with the same id, or without an id, are documents of their
own; a component without any id is null; further columns are ignored, whatever
their names; an empty table gives an empty result.  Shingles are compared as 64-bit
hashes, sets as 128-bit hashes, texts of one id as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sunder.llm import textkernel as tk
from sunder.llm.rows import distinct_rows, plain
from sunder.plans.components import connected_components
from sunder.plans.scratch import Scratch

BLOCK = 1024
FAN = 8
CELLS = 1 << 22
HEAVY = 512  # a cell is heavy with more than one of so many documents
LOAD, FINE = 0.75, 0.125
NAMED = 1 << 16  # members of a tree that are held to name it; a larger one has its shingle's name
SEEN = 1 << 18  # sets that a task remembers, to give the shingles of equal ones once
PAIRS = 1 << 14  # pairs of nodes that are compared at once
_U = np.uint64
_WORD = r"[^\x20\x09-\x0D]"


def _sets(raw, offsets, i, j, size) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of rows ``i`` to ``j``, ascending."""
    w = tk.words(raw, offsets, i, j, lower=True)
    r, s = tk.shingles(w, j - i, size)
    if len(r) and np.any(r[1:] < r[:-1]):
        order = np.argsort(r, kind="stable")
        r, s = r[order], s[order]
    cut = np.searchsorted(r, np.arange(j - i + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a + 1:
            s[a:b].sort()
    if len(r):
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        r, s = r[new], s[new]
    return r, s


def _per_row(ufunc, values, starts, n_rows, which):
    out = np.zeros(n_rows, values.dtype)
    if len(which):
        out[which] = ufunc.reduceat(values, starts)
    return out


def bitmaps(rows: np.ndarray, s: np.ndarray, n: np.ndarray, load: float = LOAD) -> list[bytes]:
    """A bitmap of each set, a power of two of words; a shingle's bit in a narrower one is its bit in a wider one, folded."""
    w = 1 << np.ceil(np.log2(np.maximum(1, np.ceil(n / load / 64)))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(w)))
    flags = np.zeros(64 * base[-1], bool)
    h = tk.mix(s ^ _U(0x27D4EB2F))
    flags[64 * base[rows] + (h & (64 * w[rows] - 1).astype(np.uint64)).astype(np.int64)] = True
    flat = np.packbits(flags, bitorder="little").tobytes()
    cut = (8 * base).tolist()
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _hashes(rows, s, n_rows, which, starts) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_per_row(np.add, tk.mix(s ^ _U(salt)), starts, n_rows, which) for salt in (0x1B873593, 0xCC9E2D51))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & _U(CELLS - 1)).astype(np.int64)


def _profile(size: int):
    """Per row: set size, set hashes and bitmap.  At the end, with n = -1: cells that many of the task's rows have, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n_docs, waiting = np.zeros(CELLS, np.int64), 0, []

        def count():
            cells[:] += np.bincount(np.concatenate(waiting), minlength=CELLS)
            waiting.clear()

        for batch in batches:
            raw, offsets = tk.buffers(batch.column("text"))
            for i, j in tk.row_slices(offsets):
                n_rows = j - i
                rows, s = _sets(raw, offsets, i, j, size)
                n = np.bincount(rows, minlength=n_rows)
                which = np.flatnonzero(n)
                s1, s2 = _hashes(rows, s, n_rows, which, np.searchsorted(rows, which))
                waiting.append(_cell(s))
                if sum(map(len, waiting)) > CELLS:
                    count()
                n_docs += n_rows
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c).slice(i, n_rows) for c in ("doc_id", "kid", "th")}
                    | {"n": pa.array(n.astype(np.int64)), "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)), "bits": pa.array(bitmaps(rows, s, n), pa.binary())}
                )
        if waiting:
            count()
        at = np.flatnonzero(cells > 2 * cells.mean() + n_docs / (2 * HEAVY) + 4)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_pydict(
            {"doc_id": none, "kid": none, "th": none, "n": pa.array(np.full(len(at), -1)), "s1": pa.array(at.astype(np.int64)), "s2": pa.array(cells[at].astype(np.int64)), "bits": pa.nulls(len(at), pa.binary())}
        )

    return run


def _prefixes(size: int, percent: int, heavy: np.ndarray, level: np.ndarray):
    """The shingles by which a set's trees are found, its size (negative: not as the smaller set), and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(CELLS, np.uint8)
        last[heavy] = level
        seen: set[int] = set()
        for batch in batches:
            raw, offsets = tk.buffers(batch.column("text"))
            for i, j in tk.row_slices(offsets):
                n_rows = j - i
                rows, s = _sets(raw, offsets, i, j, size)
                n = np.bincount(rows, minlength=n_rows)
                which = np.flatnonzero(n)
                s1, _ = _hashes(rows, s, n_rows, which, np.searchsorted(rows, which))
                fresh = np.zeros(n_rows, bool)
                for k, x in zip(which.tolist(), s1[which].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                if len(seen) > SEEN:
                    seen.clear()
                keep = fresh[rows]
                rows, s = rows[keep], s[keep]
                late = last[_cell(s)]
                if late.any():
                    order = np.lexsort((late, rows))
                    rows, s = rows[order], s[order]
                place, own = np.arange(len(rows)) - np.searchsorted(rows, rows), n[rows]
                keep = place <= own - -(-percent * own // 100)
                as_smaller = place <= own - -(-2 * percent * own // (100 + percent))
                signed = np.where(as_smaller, own, -own)[keep]
                yield pa.RecordBatch.from_pydict(
                    {"token": pa.array(s[keep].view(np.int64)), "n": pa.array(signed.astype(np.int32)), "s1": pa.array(s1[rows[keep]].view(np.int64))}
                )

    return run


def _named(rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (token, n, s1) of whole tokens: the trees, named by their members, and their members."""
    token, n, s1 = rows[:, np.lexsort((rows[2], -rows[1], np.abs(rows[1]), rows[0]))]
    smaller, n = n > 0, np.abs(n)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (s1[1:] != s1[:-1])
    token, n, s1, smaller = token[new], n[new], s1[new], smaller[new]
    if not len(token):
        return token, s1
    same = np.concatenate(([False], token[1:] == token[:-1]))
    group = np.cumsum(~same)
    # A member can be the larger set of a pair if one that can be the smaller is before it, and the smaller if any is after it.
    before = np.concatenate(([0], np.maximum.accumulate(np.where(smaller, (group << 40) + n, 0))[:-1]))
    size = np.where(before >> 40 == group, before & (1 << 40) - 1, 0)
    as_larger = (size > 0) & (100 * size >= percent * n)
    after = np.append(same[1:] & (percent * n[1:] <= 100 * n[:-1]), False)
    keep = as_larger | (smaller & after)
    token, n, s1 = token[keep], n[keep], s1[keep]
    if not len(token):
        return token, s1
    starts = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (percent * n[1:] > 100 * n[:-1]))))
    size = np.diff(np.append(starts, len(token)))
    name = tk.mix(np.add.reduceat(tk.mix(s1.view(np.uint64)), starts) + size.astype(np.uint64))
    several = np.repeat(size > 1, size)
    return np.repeat(name, size)[several].view(np.int64), s1[several]


def _trees(percent: int):
    """Of rows that come together by token: the members of trees.  Holds back the last token's rows, ``NAMED`` at most."""

    def out(tree, s1):
        return pa.RecordBatch.from_pydict({"tree": pa.array(tree, pa.int64()), "s1": pa.array(s1, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((3, 0), np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "n", "s1")])
            if large is not None:
                more = int(np.searchsorted(rows[0], large, "right"))
                if more:
                    yield out(rows[0, :more], rows[2, :more])
                    rows = rows[:, more:]
                if rows.shape[1]:
                    large = None
            if not rows.shape[1]:
                continue
            rows = np.concatenate((held, rows), axis=1)
            at = int(np.searchsorted(rows[0], rows[0, -1]))
            yield out(*_named(rows[:, :at], percent))
            held = rows[:, at:]
            if held.shape[1] > NAMED:
                held = np.unique(held, axis=1)
            if held.shape[1] > NAMED:
                # Too many to hold: the tree is all of them, under the token's name.
                large = int(held[0, 0])
                yield out(held[0], held[2])
                held = np.zeros((3, 0), np.int64)
        yield out(*_named(held, percent))

    return run


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


class Forest:
    """Signature trees over members of one bitmap width.

    Leaves come first; then levels of nodes that hold the OR of up to ``FAN`` children's bitmaps, the range
    of their sizes, the most shingles that a leaf has above its bits, and their component (or -1).
    """

    def __init__(self, tree: np.ndarray, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        """Members sorted by ``tree``, like ones near each other."""
        slack = n - np.bitwise_count(bits).sum(axis=1)
        level = {"bits": bits, "low": n, "high": n, "slack": slack, "comp": comp}
        levels, starts, counts = [level], [np.zeros(len(n), np.int64)], [np.zeros(len(n), np.int64)]
        base, owner = 0, tree
        while len(owner) and np.any(owner[1:] == owner[:-1]):
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            first = np.flatnonzero(place % FAN == 0)
            size = np.diff(np.append(first, len(owner)))
            one = np.minimum.reduceat(level["comp"], first)
            up = {
                "bits": np.bitwise_or.reduceat(level["bits"], first, axis=0),
                "low": np.minimum.reduceat(level["low"], first),
                "high": np.maximum.reduceat(level["high"], first),
                "slack": np.maximum.reduceat(level["slack"], first),
                "comp": np.where(one == np.maximum.reduceat(level["comp"], first), one, -1),
            }
            starts.append(base + first)
            counts.append(size)
            base += len(owner)
            owner, level = owner[first], up
            levels.append(level)
        self.size = base + len(owner)
        for k in level:
            setattr(self, k, np.concatenate([x[k] for x in levels]))
        self.start, self.count = np.concatenate(starts), np.concatenate(counts)
        self.roots, self.of = np.arange(base, self.size), owner

    def meet(self, x: np.ndarray, y: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Dual traversal from the pairs of nodes (x, y): pairs of leaves of different components that the bounds allow, and their largest overlap."""
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if len(x) > PAIRS:
                half = len(x) // 2
                todo += [(x[half:], y[half:]), (x[:half], y[:half])]
                continue
            keep = ~((self.comp[x] == self.comp[y]) & (self.comp[x] >= 0))
            keep &= (100 * self.high[x] >= percent * self.low[y]) & (100 * self.high[y] >= percent * self.low[x])
            x, y = x[keep], y[keep]
            common = np.bitwise_count(self.bits[x] & self.bits[y]).sum(axis=1, dtype=np.int64)
            most = np.minimum(np.minimum(self.high[x], self.high[y]), common + np.minimum(self.slack[x], self.slack[y]))
            keep = most >= _least_overlap(self.low[x], self.low[y], percent)
            x, y, most = x[keep], y[keep], most[keep]
            nx, ny = self.count[x], self.count[y]
            leaf = (nx == 0) & (ny == 0)
            two = leaf & (x != y)
            yield x[two], y[two], most[two]
            x, y, nx, ny = x[~leaf], y[~leaf], nx[~leaf], ny[~leaf]
            if not len(x):
                continue
            # Each pair becomes the pairs of children; a leaf stands for itself.
            times = np.maximum(nx, 1) * np.maximum(ny, 1)
            which = np.repeat(np.arange(len(x)), times)
            k = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            down = np.maximum(ny, 1)[which]
            u = np.where(nx[which] > 0, self.start[x[which]] + k // down, x[which])
            v = np.where(ny[which] > 0, self.start[y[which]] + k % down, y[which])
            keep = (x[which] != y[which]) | (u <= v)
            todo.append((u[keep], v[keep]))


def _matrix(bits: list, width: int, fold: int) -> np.ndarray:
    """Bitmaps of ``width << fold`` words, folded to ``width``."""
    flat = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), 1 << fold, width)
    return np.bitwise_or.reduce(flat, axis=1)


def candidate_pairs(tree: np.ndarray, side: np.ndarray, n: np.ndarray, bits: list, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of pairs of members of a tree that the bounds allow, and the largest Jaccard similarity that they can have.

    ``side`` 0: members meet each other; 1 and 2: those of 1 meet those of 2.
    """
    width = np.array([len(x) // 8 for x in bits], np.int64)
    # Wider bitmaps by at most this power of two can belong to sets that link.
    reach = 1
    while (1 << reach) * percent < 100:
        reach += 1
    for w in np.unique(width):
        for fold in range(reach + 1):
            # Trees of this width, and of one that is folded to it.
            own, other = np.flatnonzero(width == w), np.flatnonzero(width == w << fold)
            if fold and not len(other):
                continue
            both = own if fold == 0 else np.concatenate((own, other))
            kind = side[both] + 3 * np.repeat([0, 1], [len(own), len(both) - len(own)])
            rows = np.concatenate((_matrix([bits[k] for k in own], w, 0), _matrix([bits[k] for k in other], w, fold))) if fold else _matrix([bits[k] for k in own], w, 0)
            order = np.lexsort((rows[:, 0], n[both], comp[both], kind, tree[both]))
            both, rows, kind = both[order], rows[order], kind[order]
            name = np.cumsum(np.concatenate(([0], (tree[both][1:] != tree[both][:-1]) | (kind[1:] != kind[:-1]))))
            forest = Forest(name, n[both], rows, comp[both])
            first = np.searchsorted(name, forest.of)
            root = {(t, k): r for t, k, r in zip(tree[both][first].tolist(), kind[first].tolist(), forest.roots.tolist(), strict=True)}
            x, y = [], []
            for (t, k), r in root.items():
                meets = {0: (0,), 1: (2,)} if fold == 0 else {0: (3,), 1: (5,), 2: (4,)}
                for other_kind in meets.get(k, ()):
                    if (t, other_kind) in root:
                        x.append(r)
                        y.append(root[t, other_kind])
            for u, v, most in forest.meet(np.array(x, np.int64), np.array(y, np.int64), percent):
                if len(u):
                    p, q = both[u], both[v]
                    yield p, q, most / (n[p] + n[q] - most)


def spanning(p: np.ndarray, q: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Which pairs of ``size`` places make a spanning forest of the heaviest ones: each part takes its heaviest pair to another part, until there is none."""
    taken, part = np.zeros(len(p), bool), np.arange(size)
    # One order for all, so that no cycle can close.
    order = np.lexsort((np.arange(len(p)), weight))
    rank = np.empty(len(p), np.int64)
    rank[order] = np.arange(len(p))
    live = np.arange(len(p))
    while len(live):
        live = live[part[p[live]] != part[q[live]]]
        best = np.full(size, -1)
        for end in (p, q):
            np.maximum.at(best, part[end[live]], rank[live])
        chosen = np.unique(order[best[best >= 0]])
        taken[chosen] = True
        for a, b in zip(part[p[chosen]].tolist(), part[q[chosen]].tolist(), strict=True):
            while part[a] != a:
                a = part[a]
            while part[b] != b:
                b = part[b]
            part[max(a, b)] = min(a, b)
        while np.any(part[part] != part):
            part = part[part]
    return taken


def _search(percent: int, first: bool):
    """Candidates of trees whose rows come together, by (tree, x, y); a few thousand members at a time.

    ``first``: a spanning forest of them, and with b = -1 the members a of (tree, x, y) that have others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(part: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: part.column(c).to_numpy() for c in ("tree", "x", "y", "side", "u", "n", "comp")}
            tree, x, y, u = (col[c] for c in ("tree", "x", "y", "u"))
            change = np.concatenate(([0], (tree[1:] != tree[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            pairs = list(candidate_pairs(np.cumsum(change), col["side"], col["n"], part.column("bits").to_pylist(), col["comp"], percent))
            if not pairs:
                return
            p, q, weight = (np.concatenate(z) for z in zip(*pairs, strict=True))
            keep, names = np.ones(len(p), bool), [(c, np.int64 if c == "tree" else np.int32) for c in ("tree", "x", "y", "side")]
            if first:
                keep = spanning(p, q, weight, len(u))
                left = np.unique(np.concatenate((p[~keep], q[~keep])))
                yield pa.RecordBatch.from_pydict({"a": pa.array(u[left]), "b": pa.array(np.full(len(left), -1))} | {c: pa.array(col[c][left].astype(kind)) for c, kind in names})
            a, b = u[p[keep]], u[q[keep]]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))} | {c: pa.array(np.zeros(len(a), kind)) for c, kind in names})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if table.num_rows < 2 * BLOCK:
                rest = table
                continue
            keys = np.stack([table.column(c).to_numpy() for c in ("tree", "x", "y")])
            end = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if len(end):
                yield from found(table.slice(0, end[-1] + 1).combine_chunks())
                table = table.slice(end[-1] + 1)
            rest = table
        if rest is not None and rest.num_rows:
            yield from found(rest.combine_chunks())

    return run


def _set_bytes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.buffers(batch.column("text"))
            for i, j in tk.row_slices(offsets):
                rows, s = _sets(raw, offsets, i, j, size)
                cut = np.searchsorted(rows, np.arange(j - i + 1))
                values = [s[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]
                fine = bitmaps(rows, s, np.diff(cut), FINE)
                yield pa.RecordBatch.from_pydict({"u": batch.column("u").slice(i, j - i), "tokens": pa.array(values, pa.binary()), "bits": pa.array(fine, pa.binary())})

    return run


def _verify(percent: int):
    """Pairs that link, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            x_col, y_col = batch.column("x"), batch.column("y")
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (x_col, y_col))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Join:
    """The steps of one join; ``profile`` has a row per document, ``sets`` one per distinct set."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        spark = docs.sparkSession
        self.docs, self.size, self.percent = docs, size, percent
        self.scratch = scratch = Scratch(spark, "ngram")
        kept = scratch.keep(docs.select("doc_id", "kid", "th", "text").mapInArrow(_profile(size), "doc_id long, kid long, th long, n long, s1 long, s2 long, bits binary"))
        self.profile = kept.where("n >= 0")
        total = self.profile.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
        bar = total.docs / HEAVY + 4 * total.shingles / CELLS
        # Fewer than CELLS / 4 cells can be above four times the mean.
        cells = kept.where("n < 0").groupBy("s1").agg(F.sum("s2").alias("c")).where(F.col("c") > bar).toArrow()
        heavy, count = (cells.column(c).to_numpy() for c in ("s1", "c"))
        self.heavy, self.level = heavy, (1 + np.floor(np.log2(count / max(bar, 1e-9)))).clip(1, 255).astype(np.uint8)
        # Of a set: its rows' smallest id, and the row that stands for it.
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kid", "th")
        sets = self.profile.where("n > 0").groupBy("s1", "s2").agg(F.min("n").alias("n"), F.min(row).alias("row"), F.min("bits").alias("bits"))
        self.sets = scratch.keep(sets.withColumn("u", F.monotonically_increasing_id()))

    def labels(self) -> DataFrame:
        """``node, component`` of the sets that link with another."""
        scratch, percent = self.scratch, self.percent
        spread = self.docs.select("text").mapInArrow(_prefixes(self.size, percent, self.heavy, self.level), "token long, n int, s1 long")
        found = spread.repartition("token").sortWithinPartitions("token").mapInArrow(_trees(percent), "tree long, s1 long").distinct()
        members = scratch.keep(found.join(self.sets.select("s1", "u", "n"), "s1").select("tree", "u", "n"))
        trees = scratch.keep(members.groupBy("tree").agg(F.count("*").alias("size")))
        # Members are dealt to blocks, and every pair of blocks meets once.
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = members.join(trees, "tree").withColumn("block", F.pmod(F.xxhash64("u"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        rows = rows.select("tree", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "u", "n", F.col("u").alias("comp"))
        out = self.search(rows.join(self.sets.select("u", "bits"), "u"), first=True)
        pairs = scratch.keep(out.where("b >= 0").select("a", "b").distinct())
        self.fetch(pairs)
        likely = self.linked(pairs)
        labels = scratch.keep(connected_components(likely, scratch))
        # Members with further pairs meet again where they are in several components.
        now = out.where("b < 0").select("tree", "x", "y", "side", F.col("a").alias("u")).join(self.sets.select("u", "n"), "u")
        now = now.join(labels.select(F.col("node").alias("u"), "component"), "u", "left").withColumn("comp", F.coalesce("component", "u")).drop("component")
        now = scratch.keep(now)
        several = now.groupBy("tree", "x", "y").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        several = scratch.keep(several.select("tree", "x", "y"))
        if several.take(1):
            rows = now.join(several, ["tree", "x", "y"]).join(self.found.select("u", "bits"), "u")
            more = self.search(rows, first=False).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
            more = self.linked(scratch.keep(more))
            labels = self.joined(labels, more)
        scratch.drop(members, trees, now, several, out, pairs, self.found)
        return labels

    def joined(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Components after further links between them."""
        if not links.take(1):
            return labels
        ends = labels.select(F.col("node"), "component")
        of = lambda c: ends.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        across = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        across = across.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        top = self.scratch.keep(connected_components(across, self.scratch))
        top = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
        # Nodes that had no component were their own.
        alone = top.select(F.col("component").alias("node"), "component").join(ends, "node", "left_anti")
        every = ends.unionByName(alone).join(top, "component", "left")
        return self.scratch.keep(every.select("node", F.coalesce("top", "component").alias("component")))

    def search(self, rows: DataFrame, first: bool) -> DataFrame:
        rows = rows.select("tree", "x", "y", "side", "u", "n", "comp", "bits").repartition("tree", "x", "y").sortWithinPartitions("tree", "x", "y")
        out = rows.mapInArrow(_search(self.percent, first), "a long, b long, tree long, x int, y int, side int")
        return self.scratch.keep(out)

    def fetch(self, pairs: DataFrame) -> None:
        """The full sets of all members of pairs, as ``found``."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
        need = self.scratch.keep(self.sets.join(need, "u").select("u", "row.kid", "row.th"))
        texts = distinct_rows(self.docs, "text").join(need, ["kid", "th"]).select("u", "text")
        self.found = self.scratch.keep(texts.mapInArrow(_set_bytes(self.size), "u long, tokens binary, bits binary"))
        self.scratch.drop(need)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose full sets link."""
        x, y = (self.found.select(F.col("u").alias(k), F.col("tokens").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return self.scratch.keep(pairs.join(x, "a").join(y, "b").mapInArrow(_verify(self.percent), "a long, b long"))

    def classes(self) -> DataFrame:
        """``s1, s2, first, best``: of each set its component's smallest id and the row that stands for the component."""
        labels = self.labels().select(F.col("node").alias("u"), "component")
        known = self.sets.select("u", "s1", "s2", "row").join(labels, "u", "left")
        known = self.scratch.keep(known.select("s1", "s2", "row", F.coalesce("component", "u").alias("component")))
        # Rows without an id come last.
        best = self.scratch.keep(known.groupBy("component").agg(F.min("row").alias("best")))
        return self.scratch.keep(known.join(best, "component").select("s1", "s2", F.col("best.doc_id").alias("first"), "best"))


def ngram_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``."""
    join = _Join(plain(docs), size, percent)
    classes = join.classes().select("s1", "s2", "first")
    rows = join.profile.select("doc_id", "n", "s1", "s2")
    met = rows.where("n > 0").join(classes, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
    return met.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_components(docs: DataFrame, size: int = 3, percent: int = 90, carry: tuple = ()) -> DataFrame:
    """``doc_id, text`` and ``carry`` as a struct: of each component one row, that with the smallest id; rows without a word all stay."""
    rows = plain(docs, carry)
    best = _Join(rows, size, percent).classes().select("best.kid", "best.th").distinct()
    worded = F.coalesce(F.col("text").rlike(_WORD), F.lit(False))
    kept = ["doc_id", "text", *(["carry"] if carry else [])]
    one = distinct_rows(rows.where(worded), *kept).join(best, ["kid", "th"], "left_semi")
    return one.select(*kept).unionByName(rows.where(~worded).select(*kept))
