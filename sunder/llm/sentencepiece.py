"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (each space becomes U+2581, one is put in front) and cut into
words at places that no piece crosses.  The distinct words of a batch are sorted,
which lays out their trie depth first: going from one word to the next keeps the
forward table of their common prefix and extends it by the remaining characters.

The forward table depends on the kind of model:

* unigram: the best sum of piece scores up to each character;
* BPE: of all segmentations exactly one has only neighbours that the merge rules
  leave unmerged, a neighbour pair (u, v) being allowed if merging their joined
  text gives u, v again.  Merges inside either of two neighbours do not depend on
  what lies beyond, so that segmentation is the one the merges give, and each
  prefix has one last piece.  The forward scores are 0 for that piece and minus
  infinity for the others; the result equals the reference implementation's ids.

Characters without a piece become byte pieces (or the unknown piece).

Defined cases: a null text has null ids, an empty one none; U+2581 in a text is
decoded as a space, all other texts round-trip if the model has byte pieces;
words may be as long as the text; rows are encoded one by one; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
CACHED_WORDS, CACHED_PAIRS = 100_000, 200_000


def default_model() -> str:
    """The model file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces and scores of a model.  Built on the driver, sent to tasks as plain values."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_pieces: dict[int, int] | None = None, bpe: bool = True, special: tuple[int, ...] = (), dummy_prefix: bool = True):
        self.pieces, self.unknown, self.byte_pieces, self.bpe, self.dummy_prefix = pieces, unknown, byte_pieces or {}, bpe, dummy_prefix
        control = {unknown, *special, *self.byte_pieces.values()}
        self.ids = {p: k for k, (p, _) in enumerate(pieces) if k not in control and p}
        self.longest = max(map(len, self.ids), default=1)
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.lowest = min((s for p, s in pieces if p in self.ids), default=0.0)
        raw = [b"" if k in special else p.replace(MARK, " ").encode() for k, (p, _) in enumerate(pieces)]
        for value, k in self.byte_pieces.items():
            raw[k] = bytes([value])
        raw[unknown] = b" \xe2\x81\x87 "
        self.raw = raw
        inner = set().union(*(set(p) for p in self.ids if len(p) > 1)) if self.ids else set()
        alone = "".join(c for c in "\n\r\t" if c not in inner)
        crossed = any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False))
        stop = re.escape(alone)
        one = f"[{stop}]|" if alone else ""
        self.pattern = r"(?s:.+)" if crossed else f"{one}{MARK}*[^{MARK}{stop}]+|{MARK}+"

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only identity normalisation is supported")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError(f"{path}: neither a unigram nor a BPE model")
        by = {t: [k for k, p in enumerate(proto.pieces) if p.type == t] for t in (kind.UNKNOWN, kind.CONTROL, kind.BYTE, kind.UNUSED, kind.USER_DEFINED)}
        if by[kind.UNUSED] or by[kind.USER_DEFINED]:
            raise ValueError(f"{path}: unused and user-defined pieces are not supported")
        return cls(
            [(p.piece, p.score) for p in proto.pieces], by[kind.UNKNOWN][0], {int(proto.pieces[k].piece[3:5], 16): k for k in by[kind.BYTE]},
            proto.trainer_spec.model_type == 2, tuple(by[kind.CONTROL]), norm.add_dummy_prefix,
        )


class Encoder:
    """Encodes and decodes with a model; keeps words and neighbour pairs it has seen, up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sequences: dict[str, list | None] = {}
        self.find = re.compile(model.pattern).findall

    def _sequence(self, piece: str) -> list | None:
        """The merges that build a piece from its characters: (score, first part, last part) after each.

        None if merging its characters gives something else.
        """
        if piece in self.sequences:
            return self.sequences[piece]
        parts, ids, pieces = list(piece), self.model.ids, self.model.pieces
        out = [(0.0, parts[0], parts[-1])]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or pieces[found][1] > best):
                    best, at = pieces[found][1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        if len(self.sequences) >= CACHED_PAIRS:
            self.sequences.clear()
        self.sequences[piece] = out = out if len(parts) == 1 else None
        return out

    def _unmerged(self, u: str, v: str) -> bool:
        """Whether merging the text of both never joins the end of u with the start of v.

        Merges inside u and inside v come in their own order, the better score
        first and u's first if equal; at each step the pair across competes.
        """
        left, right = self._sequence(u) if u else [(0.0, "", "")], self._sequence(v)
        if left is None or right is None:
            return False
        ids, pieces, i, j = self.model.ids, self.model.pieces, 0, 0
        while True:
            across = ids.get(left[i][2] + right[j][1]) if u else None
            next_u = left[i + 1][0] if i + 1 < len(left) else None
            next_v = right[j + 1][0] if j + 1 < len(right) else None
            if across is not None:
                score = pieces[across][1]
                if (next_u is None or score > next_u) and (next_v is None or score >= next_v):
                    return False
            if next_u is None and next_v is None:
                return True
            if next_v is None or (next_u is not None and next_u >= next_v):
                i += 1
            else:
                j += 1

    def _allowed(self, u: str, v: str) -> bool:
        got = self.pairs.get((u, v))
        if got is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            got = self.pairs[u, v] = self._unmerged(u, v)
        return got

    def _extend(self, word: str, table: list) -> None:
        """One forward entry per character beyond the table: (start of the last piece, the piece, score)."""
        ids, pieces, longest = self.model.ids, self.model.pieces, self.model.longest
        if self.model.bpe:
            allowed, pairs, tails = self._allowed, self.pairs, self.model.tails
            for end in range(len(table), len(word) + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    v = word[start:end]
                    if v in ids or start == end - 1:
                        u = table[start][1]
                        good = pairs.get((u, v))
                        if good is None:
                            good = allowed(u, v)
                        if good:
                            table.append((start, v, 0.0))
                            break
                    if v not in tails:
                        break
                if len(table) == end:
                    raise AssertionError(f"no segmentation of {word!r}")
        else:
            for end in range(len(table), len(word) + 1):
                best = None
                for start in range(max(0, end - longest), end):
                    v = word[start:end]
                    found = ids.get(v)
                    if found is not None or start == end - 1:
                        score = table[start][2] + (self.model.lowest - 10.0 if found is None else pieces[found][1])
                        if best is None or score > best[2]:
                            best = (start, v, score)
                table.append(best)

    def _ids(self, word: str, table: list) -> bytes:
        out, end, model = [], len(word), self.model
        while end:
            start, v, _ = table[end]
            found = model.ids.get(v)
            if found is not None:
                out.append(found)
            elif model.byte_pieces:
                out += [model.byte_pieces[b] for b in reversed(v.encode("utf-8", "surrogatepass"))]
            elif not out or out[-1] != model.unknown:
                out.append(model.unknown)
            end = start
        out.reverse()
        return np.array(out, "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode new words in trie order."""
        before, table = "", [(0, "", 0.0)]
        for word in sorted(words):
            n = min(len(before), len(word))
            same = n if before[:n] == word[:n] else next(k for k in range(n) if before[k] != word[k])
            del table[same + 1 :]
            self._extend(word, table)
            self.words[word] = self._ids(word, table)
            before = word

    def split(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        return self.find(MARK + marked if self.model.dummy_prefix and text else marked)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.split(t) for t in texts]
        new = set()
        for c in cut:
            if c is not None:
                new.update(c)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words = {w: self.words[w] for w in new if w in self.words}
        self.learn(new - self.words.keys())
        get = self.words.__getitem__
        return [None if c is None else np.frombuffer(b"".join(map(get, c)), "<i4") for c in cut]

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _parts(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of a few MB at a time; a longer text is alone."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    at, n, used, out = 0, batch.num_rows, 0, []
    for k in range(n):
        t = texts[k].as_py()
        out.append(t)
        used += len(t or "")
        if used >= size or k == n - 1:
            yield ids.slice(at, k + 1 - at), out
            at, used, out = k + 1, 0, []


def _encode(model: PieceModel, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for ids, texts in _parts(batch):
                coded = encoder.encode(texts)
                n = pa.array([None if c is None else len(c) for c in coded], pa.int64())
                if digest:
                    again = [None if c is None else encoder.decode(c.tolist()) == t for c, t in zip(coded, texts, strict=True)]
                    crc = [None if c is None else zlib.crc32(c.tobytes()) for c in coded]
                    cols = {"ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(again, pa.bool_())}
                else:
                    cols = {"ids": pa.array(coded, pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_tokens": n} | cols)

    return run


def encode_texts(docs: DataFrame, model_path: str | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row of ``docs(doc_id, text)``.

    With ``digest``, instead of the ids their CRC-32 (little-endian 32-bit), and
    whether decoding them gives the text back.
    """
    model = PieceModel.load(model_path or default_model())
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_encode(model, digest), "doc_id long, n_tokens long, " + ("ids_crc32 long, round_trip boolean" if digest else "ids array<int>"))


def _decode(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return run


def decode_ids(coded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ``coded(doc_id, ids)``."""
    model = PieceModel.load(model_path or default_model())
    return coded.select(coded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(_decode(model), "doc_id long, text string")
