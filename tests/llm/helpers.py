"""Fixtures and brute-force versions for the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=0, n=120):
    """Small documents with shared lines, near and exact copies, nulls, empties and a very long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    pool = [line(r.randint(1, 25)) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.4 and texts:
            w = (r.choice(texts) or "x").split(" ")
            w[r.randrange(len(w))] = r.choice(vocab).upper()
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(r.choice(pool) if r.random() < 0.4 else line(r.randint(0, 20)) for _ in range(r.randint(1, 12))))
    texts += [None, "", " \n\t", "one", "one two", "ONE two", "\n".join(pool * 40), "word " * 3000]
    return [(k * 3, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None, "z"]), None if t is None else len(t)) for k, t in enumerate(texts)]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)
