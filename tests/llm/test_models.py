"""Quality classifier, SentencePiece, language ID against brute force, the reference library and held-out labels."""

import itertools
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from sunder.llm import language_id as lid, quality_classifier as qc, sentencepiece as spm
from tests.conftest import DATA
from tests.llm.helpers import DOCS, corpus


@pytest.fixture(scope="module")
def model():
    return spm.PieceModel.load(spm.default_model())


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab eé\n\t  ▁①日本the ing 𝄞0129.,<s></s>") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    texts = [*odd_texts(1, 3000), *(t or "" for _, t, *_ in corpus(3)), "    lead", "trail   ", "a" * 3000, "日" * 200, "</s> <unk> <0x41>"]
    encoder = spm.Encoder(model)
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [encoder.decode(x.tolist()) for x in got] == library.decode([x.tolist() for x in got])
    for t, x in zip(texts, got, strict=True):
        if spm.MARK not in t:
            assert encoder.decode(x.tolist()) == t


def test_caches_that_overflow_change_nothing(model, monkeypatch):
    texts = odd_texts(2, 400)
    expected = [x.tolist() for x in spm.Encoder(model).encode(texts)]
    monkeypatch.setattr(spm, "CACHED_WORDS", 20)
    monkeypatch.setattr(spm, "CACHED_PAIRS", 20)
    small = spm.Encoder(model)
    assert [x.tolist() for k in range(0, 400, 50) for x in small.encode(texts[k : k + 50])] == expected


def test_unigram_viterbi_is_the_best_segmentation():
    pieces = [("<unk>", 0.0), ("▁", -3.0), ("▁a", -2.0), ("ab", -2.5), ("b", -4.0), ("a", -3.5), ("bab", -4.2), ("▁ab", -3.9)]
    model = spm.PieceModel(pieces, bpe=False)
    encoder = spm.Encoder(model)
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            marked = spm.MARK + word
            best = -math.inf
            for cut in itertools.product((0, 1), repeat=len(marked) - 1):
                at = [0, *(k + 1 for k, c in enumerate(cut) if c), len(marked)]
                parts = [marked[a:b] for a, b in zip(at, at[1:], strict=False)]
                if all(p in model.ids or len(p) == 1 for p in parts):
                    best = max(best, sum(pieces[model.ids[p]][1] if p in model.ids else model.lowest - 10 for p in parts))
            encoder.words.clear()
            table = [(0, "", 0.0)]
            encoder._extend(marked, table)
            assert table[-1][2] == pytest.approx(best)


def test_encode_and_decode_frames(spark):
    rows = corpus(5, 40)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 ids", "2 n_tokens").repartition(3)
    coded = spm.encode_texts(docs)
    back = {r.doc_id: r.text for r in spm.decode_ids(coded).collect()}
    assert back == {r[0]: r[1] for r in rows}
    for r in spm.encode_texts(docs, digest=True).collect():
        assert r.round_trip in (True, None) and (r.n_tokens is None) == (back[r.doc_id] is None)
    assert spm.encode_texts(docs.limit(0)).collect() == []


def brute_probability(word, prob, zero=0.0):
    """Sum over all segmentations, in numbers of the kind of ``zero``."""
    kind = type(zero)
    total = [kind(1)] + [zero] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            p = prob.get(word[s:e], kind(lid.FLOOR) if e - s == 1 else zero)
            total[e] += total[s] * p
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "é"]
    vocab = lid.Vocabulary(pieces)
    r = np.random.default_rng(1)
    prob = r.random((len(pieces), 2)) / 10
    words = ["▁" + "".join(random.Random(k).choice("abéx") for _ in range(k % 9 + 1)) for k in range(60)]
    got = lid.log_likelihoods(vocab, prob, words)
    for w, row in zip(words, got, strict=True):
        for c in range(2):
            assert row[c] == pytest.approx(math.log(brute_probability(w, dict(zip(pieces, prob[:, c], strict=True)))))
    # Expected counts: derivative of the log probability by the log of each piece's probability.
    counts = lid.expected_counts(vocab, prob[:, 0], words, np.ones(len(words)))
    for k in range(len(pieces)):
        up, down = prob.copy(), prob.copy()
        up[k] *= 1.0001
        down[k] /= 1.0001
        slope = (lid.log_likelihoods(vocab, up, words)[:, 0].sum() - lid.log_likelihoods(vocab, down, words)[:, 0].sum()) / (2 * math.log(1.0001))
        assert counts[k] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_long_words_are_summed_whole():
    """A word of any length: the sum over all segmentations, and the counts that it gives."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "é", "abababab"]
    vocab = lid.Vocabulary(pieces)
    prob = np.random.default_rng(2).random((len(pieces), 2)) / 10
    words = ["▁" + "".join(random.Random(k).choice("abéx") for _ in range(n)) for k, n in enumerate((30, 31, 32, 33, 60, 70))] + ["▁" + "ab" * 40]
    for w, row in zip(words, lid.log_likelihoods(vocab, prob, words), strict=True):
        for c in range(2):
            assert row[c] == pytest.approx(math.log(brute_probability(w, dict(zip(pieces, prob[:, c], strict=True)))))
    for short in (1, 1000):
        mp = pytest.MonkeyPatch()
        mp.setattr(lid, "SHORT", short)
        other = lid.expected_counts(vocab, prob[:, 0], words[:4], np.arange(1, 5))
        mp.undo()
        assert other == pytest.approx(lid.expected_counts(vocab, prob[:, 0], words[:4], np.arange(1, 5)))
    assert np.isfinite(lid.log_likelihoods(vocab, prob, ["▁" + "ab" * 30_000])).all()


def brute_languages(rows, pieces, rounds=4, smoothing=0.05):
    """Predictions by plain dictionaries: word counts, expectation maximisation, posteriors."""
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang in {r[:3] for r in rows}:
        if i is not None and text is not None and lang is not None and not held(i):
            for w in text.split():
                counts.setdefault(lang, {}).setdefault("▁" + w, 0)
                counts[lang]["▁" + w] += 1
    probs, longest = {}, max(map(len, pieces))
    for lang, words in counts.items():
        p = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(rounds):
            got = dict.fromkeys(pieces, smoothing)
            for w, k in words.items():
                n = len(w)
                value = lambda s, e: p.get(w[s:e], lid.FLOOR if e - s == 1 else 0.0)  # noqa: B023, E731
                a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
                for e in range(1, n + 1):
                    a[e] = sum(a[s] * value(s, e) for s in range(max(0, e - longest), e))
                for s in range(n - 1, -1, -1):
                    b[s] = sum(b[e] * value(s, e) for e in range(s + 1, min(n, s + longest) + 1))
                for s in range(n):
                    for e in range(s + 1, min(n, s + longest) + 1):
                        if w[s:e] in p:
                            got[w[s:e]] += k * a[s] * p[w[s:e]] * b[e] / a[n]
            total = sum(got.values())
            p = {x: v / total for x, v in got.items()}
        probs[lang] = p
    out = []
    for i, text, *_ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out.append((i, held(i), "und", 0.0))
            continue
        # Decimals do not underflow, however long the word.
        logs = {lang: sum(float(brute_probability("▁" + w, {x: Decimal(v) for x, v in p.items()}, Decimal(0)).ln()) for w in text.split()) for lang, p in sorted(probs.items())}
        best = max(logs, key=logs.get)
        out.append((i, held(i), best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_language_id_against_brute_force(spark, model):
    r = random.Random(4)
    vocab = {"en": ["the", "cat", "dog", "and", "house"], "de": ["der", "hund", "und", "katze", "haus"], "fr": ["le", "chat", "chien", "et", "maison"]}
    rows = [(k if k % 7 else None, " ".join(r.choice(vocab[lang]) for _ in range(r.randint(1, 6))), lang) for k, lang in enumerate(["en", "de", "fr"] * 12)]
    rows += rows[:3] + [(5, "le chat", "fr"), (2, "12 !", "de"), (9, None, "en"), (11, "maison" * 9, None), (12, "chienundhouse" * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(x) for x in lid.identify_languages(docs).collect()]
    want = brute_languages(rows, sorted(model.ids, key=model.ids.get))
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[3])
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-9)


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = lid.identify_languages(docs.repartition(4)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    held = out[out["held_out"]]
    assert 100 < len(held) < 400 and (held["lang"] == held["lang_pred"]).mean() > 0.95
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out["doc_id"], out["held_out"], strict=True))


def test_language_id_edges(spark):
    rows = [(0, "the cat and the dog", "en", None, 0), (1, "der hund und die katze", "de", None, 0), (3, None, "en", None, 0), (4, "12 34 !", "de", None, 0), (None, "the dog", "en", None, 0), (5, "", None, None, 0), (6, "katze" * 300, None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 held_out", "2 score")
    out = {r.doc_id: r for r in lid.identify_languages(docs).collect()}
    assert [out[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and out[3].score == 0.0
    assert out[0].lang_pred == "en" and out[1].lang_pred == "de" and out[6].lang_pred == "de"
    nothing = spark.createDataFrame([(1, "some text", None, None, 0)], DOCS)
    assert lid.identify_languages(nothing).first().lang_pred == "und"
    assert lid.identify_languages(nothing.limit(0)).collect() == []


def test_quality_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = qc.co_train(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert len(out) > 1000
    good = out["quality"] == 1
    assert (out["keep"] == good).mean() > 0.97
    assert out.loc[good, "keep"].mean() > 0.98 and out.loc[~good, "keep"].mean() < 0.1
    # Calibrated: the mean score is near the share of good documents.
    assert abs(out["score"].mean() - good.mean()) < 0.03


def brute_co_train(rows, labels, rounds=3, confidence=0.98, pseudo_weight=1.0):
    """The same rounds over dictionaries of counts, a document at a time."""
    import pyarrow as pa
    from sunder.llm import textkernel as tk

    raw, offsets = tk.buffers(pa.array([r["text"] for r in rows], pa.string()))
    w = tk.words(raw, offsets, 0, len(rows))
    shape = qc.text_features(raw, offsets, 0, len(rows), w)
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in qc.content_bits(w, len(rows))]
    view = {"t": [(list(s), [int(k) for k in np.flatnonzero(b)]) for s, b in zip(shape, bits, strict=True)], "m": [(list(r["m"]), []) for r in rows]}
    y = [labels.get(r["doc_id"]) for r in rows]

    def fit(weighted, v):
        n, counts = [0.0, 0.0], [{}, {}]
        for (bins, some), c, weight in weighted:
            n[c] += weight
            for f in bins:
                counts[c][f] = counts[c].get(f, 0.0) + weight
            for f in some:
                counts[c][qc.SHAPE + f] = counts[c].get(qc.SHAPE + f, 0.0) + weight
        out, at = {}, 0
        for width in qc.WIDTHS[v]:
            for f in range(at, at + width):
                p = [(counts[c].get(f, 0.0) + 0.5) / (n[c] + 0.5 * width) for c in (0, 1)]
                out[f] = math.log(p[1]) - math.log(p[0])
            at += width
        if v == "t":
            for f in range(qc.SHAPE, qc.SHAPE + qc.CONTENT):
                p = [(counts[c].get(f, 0.0) + 0.5) / (n[c] + 1) for c in (0, 1)]
                out[f] = math.log(p[1]) - math.log(p[0])
        return out

    def raw_odds(weights, x):
        bins, some = x
        return sum(weights[f] for f in bins) + (qc.TEXT_FEATURES * sum(weights[qc.SHAPE + f] for f in some) / max(1, len(some)))

    sure, odds = math.log(confidence / (1 - confidence)), None
    for _ in range(rounds + 1):
        new = {}
        for v, other in (("t", "m"), ("m", "t")):
            data = [(x, c, 1.0) for x, c, r in zip(view[v], y, rows, strict=True) if c is not None and r["fit"]]
            for c in (0, 1):
                extra = [] if odds is None else [x for x, z, o in zip(view[v], y, odds[other], strict=True) if z is None and (o >= sure if c else o <= -sure)]
                if extra:
                    weight = min(1.0, pseudo_weight * sum(d == c for _, d, _ in data) / len(extra))
                    data += [(x, c, weight) for x in extra]
            weights = fit(data, v)
            hist = np.zeros((2, qc.HIST))
            for x, c, r in zip(view[v], y, rows, strict=True):
                if c is not None and not r["fit"]:
                    hist[c, int(min(qc.HIST - 1, max(0, raw_odds(weights, x) / qc.STEP + qc.HIST / 2)))] += 1
            own = qc.View(np.zeros(1))
            own.calibrate(hist)
            new[v] = [own.scale * raw_odds(weights, x) + own.shift for x in view[v]]
            prior = math.log((hist[1].sum() + 1) / (hist[0].sum() + 1))
        odds = new
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    return [(sigmoid(t), sigmoid(m), sigmoid(t + m - prior)) for t, m in zip(odds["t"], odds["m"], strict=True)]


def test_quality_classifier_against_brute_force(spark):
    r = random.Random(9)
    good, bad = [f"good{k}" for k in range(30)], [f"bad{k}!" for k in range(30)]
    rows = [(k, " ".join(r.choice(good if k % 3 or r.random() < 0.2 else bad) for _ in range(r.randint(3, 40))), "en", f"s{k % 3}" if r.random() < 0.7 else "s9", 10 * (k % 5)) for k in range(240)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = {k: int(k % 3 > 0) for k in range(0, 240) if k % 2}
    out = {x.doc_id: x for x in qc.co_train(docs.repartition(4), spark.createDataFrame([(k, v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    fold = "pmod(xxhash64('fold', doc_id), 2) = 0"
    plain = docs.select("doc_id", "text", qc._metadata().alias("m")).selectExpr("*", f"{fold} AS fit").collect()
    for x, (t, m, both) in zip(plain, brute_co_train([x.asDict() for x in plain], labels), strict=True):
        assert (out[x.doc_id].text_score, out[x.doc_id].meta_score, out[x.doc_id].score) == pytest.approx((t, m, both), abs=1e-3)


def test_views_are_separate(spark):
    """No word of a text changes the metadata score, no metadata the text score."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.selectExpr("doc_id", "'' AS text", "lang", "source", "n_chars")
    key = lambda d: {r.doc_id: [int(x) for x in r.m] for r in d.select("doc_id", qc._metadata().alias("m")).collect()}
    assert key(docs) == key(rows)


def test_quality_classifier_edges(spark):
    rows = corpus(4, 30) + [(None, "text", None, None, None), (3, "again", "en", "b", 5)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 y", "2 fit", "3 m", "4 t")
    labels = "doc_id long, quality int, toxic int"
    both = spark.createDataFrame([(r[0], (r[0] or 0) % 2, 0) for r in rows] + [(6, 1, 0), (None, None, 0)], labels)
    out = qc.co_train(docs, both).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    again = qc.co_train(docs.repartition(5), both).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    one_class = spark.createDataFrame([(3, 1, 0), (6, 1, 0)], labels)
    assert all(r.keep and r.score > 0.5 for r in qc.co_train(docs, one_class).collect())
    assert {r.score for r in qc.co_train(docs, both.limit(0)).collect()} == {0.5}
    assert qc.co_train(docs.limit(0), both).collect() == []


def test_calibration_follows_frequencies():
    view = qc.View(np.zeros(4))
    x = (np.arange(qc.HIST) - qc.HIST / 2 + 0.5) * qc.STEP
    p = 1 / (1 + np.exp(-(0.5 * x + 1)))
    view.calibrate(np.stack([1000 * (1 - p), 1000 * p]))
    assert view.scale == pytest.approx(0.5, abs=0.01) and view.shift == pytest.approx(1, abs=0.02)
