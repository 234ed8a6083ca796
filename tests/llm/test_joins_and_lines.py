"""Quality rules, line dedup and the n-gram join against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from sunder.llm import line_dedup, ngram_join, quality_rules
from tests.llm.helpers import DOCS, corpus, same, words


def base_counts(text):
    w = words(text)
    text = text or ""
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(grams)
    inside = {k + d for k, g in enumerate(grams) if times[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality_rules(spark):
    rows = corpus(1) + [(9000, "a*** b### c$$$ " * 30, None, None, 1), (9001, "Plain words stand here. " * 3 + "\n" + "\n".join(f"x{k} y{k} z{k} w{k}." for k in range(40)), None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = {r.doc_id: r for r in quality_rules.line_first_quality(docs, with_text=True).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text)
        assert not (r.base_failed and r.kept)
        assert r.n_lines == len((text or "").split("\n"))
        assert len(words(r.text)) == r.n_words - r.removed_words
        assert r.text is None if text is None else len(r.text.split("\n")) in (r.n_lines - r.n_removed_lines, 1)
    assert not out[9000].kept and out[9001].kept


@pytest.mark.parametrize(
    "text, bad",
    [
        ("home | news | about | contact", 1),
        ("A plain sentence with words and an end.", 0),
        ("THIS IS ALL SHOUTED TEXT NOW", 1),
        ("Licensed under some terms.", 1),
        ("go go go go go go go go go go go go", 1),
        ("word*** word%%% word$$$", 1),
        ("", 0),
        ("He opened the door and then...", 1),
        ("A long line that only pauses in the end, since it has far more words than any teaser ever would have had…", 0),
        ("- Home page", 1),
        ("- A whole sentence stands behind this bullet, and it ends as one.", 0),
        ("• one two three\u3002", 0),
        ("Home\nNews\n\nAbout us\nContact", 4),
        ("Home\nNews\nAbout us", 0),
        ("Yes.\nNo.\nWhy?\nSo.", 0),
        ("Please enable JavaScript to go on.", 1),
        ("JavaScript is a language in which many programs for pages are written, and this line says so at length.", 0),
        ("See our Privacy Policy", 1),
        ("The court found that the privacy policy of the firm was not what its users had been told in the years before.", 0),
        ("Read more about it", 1),
        ("Subscribe to the idea that long lines are whole sentences.", 0),
    ],
)
def test_line_rules(spark, text, bad):
    r = quality_rules.line_first_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_removed_lines == bad


def test_quality_rules_edges(spark):
    assert quality_rules.line_first_quality(spark.createDataFrame([], DOCS), with_text=True).collect() == []
    good = " ".join(f"w{k}" for k in range(60)) + "."
    rows = [(1, good, "l", "s", 1), (1, good, "l", "s", 1), (None, good, None, None, None), (1, None, "l", "s", 1), (None, "", "l", "s", 1), (2, good[:-1] * 3000, "l", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 n_words", "2 kept", "3 carry")
    out = quality_rules.line_first_quality(docs.repartition(3), carry=("lang",)).collect()
    same([(r.doc_id, r.n_words, r.kept, r.carry.lang) for r in out], [(i, len(words(t)), t == good, x) for i, t, x, *_ in rows])


def brute_components(rows, size=3, percent=90):
    """Rows are documents of their own, whatever their ids."""
    sets = []
    for i, text, *_ in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
        sets.append((i, set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else ({tuple(w)} if w else set())))
    comp = list(range(len(sets)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for (j, (_, x)), (k, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(j), root(k)))
            comp[b] = a
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(x), least.get(root(k))) for k, (i, x) in enumerate(sets)]


@pytest.mark.parametrize("seed, percent, size", [(1, 90, 3), (2, 90, 3), (3, 80, 5), (4, 40, 2)])
def test_ngram_join(spark, seed, percent, size):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    same([tuple(r) for r in ngram_join.ngram_components(docs, size, percent).collect()], brute_components(rows, size, percent))


def near_groups(seed):
    """Groups of near copies, whose members link only through some of them."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        w = list(base) if k % 2 else [*base[:60], *(f"v{x}" for x in range(60))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(500)}"
        rows.append((k, " ".join(w), None, None, 0))
    return rows


def test_ngram_join_large_trees(spark, monkeypatch):
    """Blocks of a tree meet in parallel, trees of many members are not held, memories of a task overflow."""
    for name, value in (("BLOCK", 8), ("NAMED", 5), ("SEEN", 10), ("PAIRS", 16)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_groups(5)
    expected = brute_components(rows)
    assert 2 < len({c for *_, c in expected}) < 80
    same([tuple(x) for x in ngram_join.ngram_components(spark.createDataFrame(rows, DOCS)).collect()], expected)


def test_ngram_join_repeated_and_null_ids(spark):
    rows = [(None if k % 3 == 0 else k // 4, t, *x) for k, (_, t, *x) in enumerate(near_groups(6))]
    rows += rows[:9] + [(None, "none here at all", None, None, 0)] * 3 + [(4, None, None, None, 0), (None, "", None, None, 0)]
    for n in (1, 7):
        out = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS).repartition(n)).collect()
        same([tuple(x) for x in out], brute_components(rows))


def test_first_of_components(spark):
    rows = [(None if k % 3 == 0 else k // 4, t, *x) for k, (_, t, *x) in enumerate(near_groups(6))]
    rows += rows[:9] + [(None, "none here at all", "l", "s", 0)] * 3 + [(4, None, None, None, 0), (None, "", "l", None, 0), (None, "", "l", None, 0)]
    out = ngram_join.first_of_components(spark.createDataFrame(rows, DOCS).repartition(4), carry=("lang", "source")).collect()
    worded = [r for r in rows if words(r[1])]
    texts = {t: c for (_, t, *_), (_, _, c) in zip(worded, brute_components(worded), strict=True)}
    kept = [r for r in out if words(r.text)]
    # Every class has one row, whose id is the class's smallest one; rows without a word all stay.
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(map(repr, (texts[r.text] for r in kept)))
    every = ngram_join.ngram_components(spark.createDataFrame([(k, r[1], *r[2:]) for k, r in enumerate(worded)], DOCS)).collect()
    assert len(kept) == len({r.component_id for r in every})
    same([(r.doc_id, r.text) for r in out if not words(r.text)], [(4, None), (None, ""), (None, "")])


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("n", [50, 240, 600, 1000, 5000])
def test_bitmaps_prune(n, percent):
    """Unrelated sets of one tree hardly ever survive, whatever their size; sets that link always do."""
    r = np.random.default_rng(n)
    sizes = r.integers(n, n * 100 // percent, 120)
    s = r.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    rows = np.repeat(np.arange(120), sizes)
    # The last twenty are near copies of the first.
    cut = np.searchsorted(rows, np.arange(121))
    for k in range(100, 120):
        m = min(sizes[k], sizes[k - 100])
        s[cut[k] : cut[k] + m] = s[cut[k - 100] : cut[k - 100] + m]
    bits = ngram_join.bitmaps(rows, s, sizes)
    zero = np.zeros(120, np.int64)
    got = {(min(p, q), max(p, q)) for x, y, _ in ngram_join.candidate_pairs(zero, zero, sizes.astype(np.int64), bits, np.arange(120), percent) for p, q in zip(x.tolist(), y.tolist(), strict=True)}
    true = {(k - 100, k) for k in range(100, 120)}
    fit = {(a, b) for a, b in true if 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b])}
    assert fit <= got
    # 119 * 60 pairs; those of sets of 50 are few in bits.
    assert len(got - true) < (0.01 if n > 50 else 0.05) * 119 * 60


def test_spanning_forest():
    r = np.random.default_rng(1)
    for n, m in ((30, 60), (50, 20), (5, 0), (40, 800)):
        p, q = r.integers(0, n, m), r.integers(0, n, m)
        p, q = p[p != q], q[p != q]
        weight = r.integers(0, 4, len(p)).astype(float)
        taken = ngram_join.spanning(p, q, weight, n)

        def parts(p, q):
            part = list(range(n))  # noqa: B023
            for a, b in zip(p, q, strict=True):
                x, y = part[a], part[b]
                part = [min(x, y) if z in (x, y) else z for z in part]
            return part

        assert parts(p, q) == parts(p[taken], q[taken]) and taken.sum() == n - len(set(parts(p, q)))


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_components(empty).collect() == []
    assert ngram_join.first_of_components(empty).collect() == []
    rows = [(None, "a b c d", "x", "y", 1), (7, "a b c d", "x", "y", 1), (7, "a b c d", "x", "y", 1), (9, None, "x", "y", 1), (8, "A b C d", "x", "y", 1), (10, "", "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'q' tree", "1 th", "2 n", "3 s1", "4 component", "5 u", "6 bits")
    same(
        [tuple(x) for x in ngram_join.ngram_components(docs).collect()],
        [(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 0, 9), (10, 0, 10)],
    )


def brute_lines(rows, min_words, hashes=None):
    """Delete a line if it lies in a run of enough words that occurs at an earlier place too; a text per row."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, (hashes or {}).get(rows[k][1], 0)))
    seen, out = {}, [None] * len(rows)
    for k in order:
        lines, gone = (rows[k][1] or "").split("\n"), set()
        full = [n for n, x in enumerate(lines) if words(x)]
        for a in range(len(full)):
            total = 0
            for b in range(a, len(full)):
                total += len(words(lines[full[b]]))
                if total >= min_words:
                    key = tuple(lines[n] for n in full[a : b + 1])
                    if seen.setdefault(key, (k, full[a])) != (k, full[a]):
                        gone.update(range(full[a], full[b] + 1))
                    if b - a > 12:
                        break
        out[k] = None if rows[k][1] is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


@pytest.mark.parametrize("seed, min_words", [(1, 20), (2, 8), (4, 50)])
def test_line_dedup(spark, seed, min_words):
    rows = [x for x in corpus(seed) if x[1] is None or len(x[1]) < 8000]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    out = line_dedup.dedup_lines(docs, min_words, carry=("lang", "source")).collect()
    expected = dict(zip((r[0] for r in rows), brute_lines(rows, min_words), strict=True))
    by_id = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    for r in out:
        text = by_id[r.doc_id][1]
        assert r.text == expected[r.doc_id], r.doc_id
        assert (r.carry.lang, r.carry.source) == (by_id[r.doc_id][2], by_id[r.doc_id][3])
        assert r.n_removed_words == len(words(text)) - len(words(r.text))


def test_line_dedup_repeated_and_null_ids(spark):
    rows = [x for x in corpus(7) if x[1] is None or len(x[1]) < 8000]
    rows = [(None if k % 4 == 0 else k // 5, t, None, None, 0) for k, (_, t, *_) in enumerate(rows)]
    rows += rows[:20] * 2 + [(7, "first\n" + rows[1][1], None, None, 0), (7, "alpha\nunique line never repeated", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    expected = brute_lines(rows, 8, hashes)
    assert sum(x != r[1] for x, r in zip(expected, rows, strict=True)) > 20
    for n in (1, 6):
        out = line_dedup.dedup_lines(docs.repartition(n), 8).collect()
        same([(r.doc_id, r.text) for r in out], [(r[0], x) for r, x in zip(rows, expected, strict=True)])


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    passage = " ".join(f"w{k}" for k in range(55))
    rows = [(None, passage, "a", "b", 1), (3, f"own line\n{passage}\nend", "a", "b", 1), (4, passage + " ", "a", "b", 1), (5, None, "a", "b", 1)]
    rows += [(6, "few\u00a0words that\nrepeat", "a", "b", 1)] * 3 + [(5, None, "a", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 s", "2 e", "3 spans", "4 carry", "5 th", "6 kid", "7 times")
    out = line_dedup.dedup_lines(docs).collect()
    same([(r.doc_id, r.text) for r in out], [(None, passage), (3, "own line\nend"), (4, passage + " "), (5, None), (5, None)] + [(6, rows[4][1])] * 3)
    gap = [(1, "a\u00a0b c\u2028d " * 30, None, None, 0)] * 2
    assert sorted(r.n_removed_words for r in line_dedup.dedup_lines(spark.createDataFrame(gap, DOCS)).collect()) == [0, 60]
