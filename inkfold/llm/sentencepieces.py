"""SentencePiece encoding and decoding by batched numpy searches over hashed pieces.

Words of equal length advance together; the hashes of their substrings probe the sorted hashes of the pieces. For a unigram model
a Viterbi search keeps at each end place the best sum of scores with its backpointer by a vectorised maximum; ties go to the longer
last piece; sums are exact (64-bit floats over whole scores), and characters without a piece cost ten more than the worst piece.
For a merging model, whose scores are ranks of merges and no logarithms, sums mean nothing: there the pair of neighbours that makes
the best-scored piece is merged, the leftmost first, until no pair makes one; all words of a batch merge once in each step. Either
way characters without a piece become the byte pieces of their UTF-8 code, and the ids are the library's own for the model's type.

No piece has a word mark after another character, and none a newline beside another, so that words and lines are searched
alone, each distinct one once: a bounded cache keeps their ids. Decoding joins pieces and bytes, turns word marks to spaces
and drops the one that encoding put in front. A literal word mark (U+2581) in a text counts as a space, as in the library.

Null texts are empty and have no ids; null ids are kept; repeated rows are encoded each; an empty table gives no rows; other columns
are not read. A text's chunks are held in memory beside it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import lean
from .tokens import ColumnEncoder
from .words import mix, text_buffers

CACHE_WORDS = 600_000
MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(44)


class Model:
    """Pieces of a model file, sorted by hash."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        self.pieces = [p.piece for p in m.pieces]
        kinds = np.array([p.type for p in m.pieces])
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.byte_id = np.full(256, self.unknown, np.int64)
        for i in np.flatnonzero(kinds == 6).tolist():
            self.byte_id[int(self.pieces[i][1:-1], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_id) if i != self.unknown}
        self.hidden = set(np.flatnonzero(kinds == 3).tolist())
        use = np.flatnonzero((kinds == 1) | (kinds == 4))
        self.longest = max(len(self.pieces[i]) for i in use.tolist())
        keys = np.array([self._hash(self.pieces[i]) for i in use.tolist()], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], use[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        slot = (mix(self.keys) >> _SLOT).astype(np.int64)
        self._slots = np.zeros(1 << 20, np.int64)
        self._slots[slot] = np.arange(len(slot))
        self._slots[np.flatnonzero(np.bincount(slot, minlength=1 << 20) > 1)] = -1
        score = np.array([m.pieces[i].score for i in use.tolist()], np.float64)
        self.scores, self.penalty = score[order], float(score.min()) - 10
        alone = [p for i in use.tolist() if MARK in (p := self.pieces[i]).lstrip(MARK) or "\n" in p]
        if alone:
            raise ValueError("a piece joins words or lines")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.merging = m.trainer_spec.model_type == 2

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return np.uint64(h)

    def _sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix hashes of words of one length, by end place, and powers of the base."""
        n, size = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size)
        sums = np.zeros((size + 1, n), np.uint64)
        for e in range(size):
            sums[e + 1] = sums[e] * _BASE + code[:, e].astype(np.uint64) + np.uint64(1)
        return sums, np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash the place among the sorted pieces, and whether it is one. A table over mixed bits tells the only place that
        can be; where two pieces share a slot the sorted keys are searched."""
        at = self._slots[(mix(h) >> _SLOT).astype(np.int64)]
        many = np.flatnonzero(at < 0)
        at = np.maximum(at, 0)
        if len(many):
            at[many] = np.minimum(np.searchsorted(self.keys, h[many]), len(self.keys) - 1)
        return at, self.keys[at] == h

    def ids_of(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length."""
        return self.merged(words) if self.merging else self.viterbi(words)

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length by merging neighbours, the best-scored piece first."""
        n, size = len(words), len(words[0])
        sums, power = self._sums(words)
        longest = min(size, self.longest)
        score = np.full((n, size, longest + 1), -np.inf)
        piece = np.full((n, size, longest + 1), -1, np.int32)
        for length in range(1, longest + 1):
            starts = size - length + 1
            at, hit = self._probe((sums[length:] - sums[:starts] * power[length]).T.ravel())
            score[:, :starts, length] = np.where(hit, self.scores[at], -np.inf).reshape(n, starts)
            piece[:, :starts, length] = np.where(hit, self.ids[at], -1).reshape(n, starts)
        after = np.tile(np.arange(1, size + 2), (n, 1))  # where the piece that starts here ends
        after[:, size] = size
        begins = np.ones((n, size), bool)
        live, place = np.arange(n), np.arange(size)
        while len(live) and size > 1:
            nxt = after[live]
            mid = nxt[:, :size]
            end = np.take_along_axis(nxt, mid, axis=1)
            length = end - place
            fit = begins[live] & (mid < size) & (length <= longest)
            value = np.where(fit, score[live[:, None], place, np.minimum(length, longest)], -np.inf)
            best = value.argmax(axis=1)
            go = value[np.arange(len(live)), best] > -np.inf
            live, best = live[go], best[go]
            mid, end = mid[go, best], end[go, best]
            after[live, best] = end
            begins[live, mid] = False
        row, at = np.nonzero(begins)
        ids = piece[row, at, np.minimum(after[row, at] - at, longest)]
        cuts = np.searchsorted(row, np.arange(1, n))
        out = [x.astype("<u4") for x in np.split(ids, cuts)]
        for r in np.unique(row[ids < 0]).tolist():
            whole: list[int] = []
            for i, k in zip(at[row == r].tolist(), ids[row == r].tolist()):
                whole += [k] if k >= 0 else self.byte_id[np.frombuffer(words[r][i].encode(), np.uint8)].tolist()
            out[r] = np.array(whole, "<u4")
        return out

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length."""
        n, size = len(words), len(words[0])
        sums, power = self._sums(words)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        took = np.zeros((size + 1, n), np.int64)
        for e in range(1, size + 1):
            for length in range(min(e, self.longest), 0, -1):
                h = sums[e] - sums[e - length] * power[length]
                at, hit = self._probe(h)
                sum_ = best[e - length] + np.where(hit, self.scores[at], self.penalty if length == 1 else -np.inf)
                better = sum_ > best[e]
                best[e] = np.where(better, sum_, best[e])
                back[e] = np.where(better, length, back[e])
                took[e] = np.where(better, np.where(hit, self.ids[at], self.unknown), took[e])
        out: list[list[int]] = [[] for _ in words]
        end = np.full(n, size)
        row = np.arange(n)
        while True:
            go = np.flatnonzero(end > 0)
            if not len(go):
                break
            ids, step = took[end[go], row[go]], back[end[go], row[go]]
            for r, i, e in zip(go.tolist(), ids.tolist(), end[go].tolist()):
                if i == self.unknown:
                    out[r] += self.byte_id[np.frombuffer(words[r][e - 1].encode(), np.uint8)][::-1].tolist()
                else:
                    out[r].append(i)
            end[go] -= step
        return [np.array(x[::-1], "<u4") for x in out]


class Encoder(ColumnEncoder):
    """Ids of text columns: words with one space or newline before them are known by their hashes; texts with other white space, or with
    a word mark of their own, are cut into chunks one by one."""

    special = [MARK]

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS) -> None:
        super().__init__(np.dtype("<u4"), True, cache_words)
        self.model = model
        self.first_kind = int(model.prefix)
        self.newline = model.byte_id[10:11].tolist()

    def chunks(self, text: str) -> list[str]:
        """Words that no piece joins, the newlines between lines as chunks of their own."""
        out: list[str] = []
        text = text.replace(" ", MARK)
        for k, line in enumerate(((MARK if self.model.prefix else "") + text).split("\n")):
            if k:
                out.append("\n")
            out += _CHUNK.findall(line)
        return out

    def _ids(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk; those of one length together."""
        by: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by.setdefault(len(c), []).append(i)
        out: list = [None] * len(chunks)
        for size, places in by.items():
            step = max(1, (1 << 20) // (size * min(size, self.model.longest) + 1))
            for i in range(0, len(places), step):
                part = places[i : i + step]
                for k, ids in zip(part, self.model.ids_of([chunks[k] for k in part])):
                    out[k] = ids
        return out

    def _fresh(self, raw: bytes, known: np.ndarray, start: list[int], end: list[int], kind: list[int], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        got = self._ids([(MARK if k == 1 else "") + raw[s:e].decode() for s, e, k in zip(start, end, kind)])
        got = [np.concatenate([np.array(self.newline, self.dtype), x]) if k == 2 else x for x, k in zip(got, kind)]
        return np.concatenate(got).astype(self.dtype), np.array([len(x) for x in got], np.int64)

    def _apart(self, text: str) -> np.ndarray:
        chunks = self.chunks(text)
        own = {c: x for c, x in zip(new, self._ids(new))} if (new := list(dict.fromkeys(chunks))) else {}
        return np.concatenate([own[c] for c in chunks]).astype(self.dtype) if chunks else np.zeros(0, self.dtype)


def decode(model: Model, ids: Iterable[int]) -> str:
    """The text of some ids; control pieces give nothing."""
    out = bytearray()
    for i in ids:
        if i in model.byte_of:
            out.append(model.byte_of[i])
        elif i not in model.hidden:
            out += model.pieces[i].encode()
    text = out.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if model.prefix and text.startswith(" ") else text


_encoders: dict[bytes, Encoder] = {}


def _encoder(proto: bytes) -> Encoder:
    if (key := zlib.crc32(proto).to_bytes(4, "little") + len(proto).to_bytes(8, "little")) not in _encoders:
        _encoders[key] = Encoder(Model(proto))
    return _encoders[key]


class Decoder:
    """Bytes of whole arrays of ids at once."""

    def __init__(self, model: Model) -> None:
        each = [bytes([model.byte_of[i]]) if i in model.byte_of else b"" if i in model.hidden else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)]
        self.size = np.array([len(x) for x in each])
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(each), np.uint8)
        self.prefix = model.prefix

    def texts(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each array stands for."""
        all_ = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        size = self.size[all_]
        end = np.cumsum(size)
        out = self.pool[np.repeat(self.start[all_] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cut = np.concatenate([[0], end])[np.cumsum([0, *(len(x) for x in ids)])].tolist()
        return [out[a + (self.prefix and out[a : a + 1] == b" ") : e] if e > a else b"" for a, e in zip(cut, cut[1:])]


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (whether decoding gives the text back) and,
    if asked for, ids as an array, of every document."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the model file

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        back = Decoder(enc.model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                texts = b.column(1).slice(i, 512)
                ids = enc.batch(texts)
                data, off = text_buffers(texts)
                plain = [data[a:e].tobytes().replace(MARK.encode(), b" ") for a, e in zip(off[:-1], off[1:])]
                cols = [
                    b.column(0).slice(i, 512),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([x == y for x, y in zip(back.texts(ids), plain)], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lean(go), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
