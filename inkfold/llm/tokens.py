"""Whole texts to token ids by the ``tokenizers`` library, with a bounded table of word parts.

A text is cut at white space into words, and a word into runs of letters, digits or other characters, which the tokenizer's own
pattern never joins, so that a text's ids are its parts' ids in a row. The parts of a whole Arrow column are found and hashed
without one Python object each; a table of 128-bit hashes gives their ids by vectorised probes, and only parts that it lacks go
to the library: ASCII and Latin-1 letters straight to its merging model, words with other characters or an apostrophe whole and
many at once, held apart by a special token. With a byte-level vocabulary the first part of a word is known together with the
space or newline before it; texts in which anything but one space or one newline parts two words are cut by a pattern instead,
one by one. Texts that hold the string of a special token, and those on which the two libraries' ideas of white space differ,
go whole. A file with another pattern or normaliser than the two known ones has its words looked up whole.

Null texts are empty. A text of more than ``SLICE_BYTES`` is worked on in pieces that begin at words, so that memory beside the
text and its ids does not grow with it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .words import SLICE_BYTES, SPACE, Words, lanes, mix, slices, stretches, text_buffers

#: Parts kept by each Python worker (about 50 bytes each); a table that holds more is emptied.
CACHE_WORDS = 1_000_000
#: Longer words are encoded each time.
LONGEST = 64
#: Words handed to the library in one call.
_CALL = 4_096
#: Characters that are white space to Python's ``\\s`` only.
_ODD = "\x1c\x1d\x1e\x1f"
_WIDE = tuple(c.encode() for c in ("\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"))
_LEAD = np.zeros(256, bool)
_LEAD[[s[0] for s in _WIDE]] = True
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Fixed value: the splitting pattern of the lower-casing vocabulary; its digits stand alone.
_LOWER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _OTHER, _WHOLE = 1, 2, 3, 4
_CLASS = np.full(256, _WHOLE, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _WHOLE
_CLASS[SPACE] = 0
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Byte-level vocabularies show a byte as a character: itself if it is printable, else one from U+0100 on, in order.
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_SHOW = np.arange(256, dtype="<u4")
_SHOW[sorted(set(range(256)) - set(_SHOWN))] = 256 + np.arange(256 - len(_SHOWN))
_KINDS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class WordTable:
    """Ids by 128-bit hash: open addressing over numpy arrays."""

    def __init__(self, dtype: np.dtype) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.a, self.b = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, self.dtype)
        self.slots = np.full(1 << 14, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(a), -1, np.int64)
        live = np.arange(len(a))
        mask = np.uint64(len(self.slots) - 1)
        at = (a & mask).astype(np.int64)
        while len(live):
            got = self.slots[at]
            same = (got >= 0) & (self.a[got] == a[live]) & (self.b[got] == b[live])
            out[live[same]] = got[same]
            go = (got >= 0) & ~same
            live, at = live[go], (at[go] + 1) & int(mask)
        return out

    def _link(self, places: np.ndarray) -> None:
        """Gives each place, not linked yet, a slot."""
        mask = len(self.slots) - 1
        at = (self.a[places] & np.uint64(mask)).astype(np.int64)
        while len(places):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = places[free]
            lost = self.slots[at] != places
            places, at = places[lost], (at[lost] + 1) & mask

    def hold(self, ids: np.ndarray) -> int:
        """Puts ids into the pool: where they begin."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """New, distinct hashes and where their ids are in the pool."""
        first, end = self.n, self.n + len(a)
        while end > len(self.a):
            for name in ("a", "b", "start", "size"):
                v = getattr(self, name)
                setattr(self, name, np.concatenate([v, np.zeros_like(v)]))
        self.a[first:end], self.b[first:end], self.start[first:end], self.size[first:end] = a, b, start, size
        self.n = end
        if 2 * end > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            first = 0
        self._link(np.arange(first, end, dtype=np.int32))


class ColumnEncoder:
    """Ids of whole text columns by a table of words or their parts. A kind of encoder says how a word falls into parts, which ids a
    part has that the table lacks, and what to do with texts that must not be taken word by word."""

    #: How a word is known: 0 as it stands, 1 behind a space, 2 behind a newline; and the first of a text.
    first_kind = 0
    #: Strings on which white space is another than here, and strings that make a text uneven.
    wide: tuple[bytes, ...] = ()
    special: list[str] = []
    parted: str | None = None

    def __init__(self, dtype: np.dtype, keep_space: bool, cache_words: int) -> None:
        self.dtype, self.keep_space, self.cache_words = dtype, keep_space, cache_words
        self.table = WordTable(dtype)

    def _parts(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words' parts: the bytes they are known by, where each begins and ends, its word, and whether it is a whole word
        for the library's own pattern."""
        return data, w.start, w.end, np.arange(len(w.start)), np.ones(len(w.start), bool)

    def _fresh(self, raw: bytes, known: np.ndarray, start: list[int], end: list[int], kind: list[int], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _apart(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def _words(self, data: np.ndarray, off: np.ndarray, before: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of some plain texts in a row, and n+1 offsets into them; ``before`` is the byte in front."""
        table = self.table
        if table.n > self.cache_words or table.used > 16 * self.cache_words:
            table.clear()
        w = Words(data, off)
        front = np.zeros(len(w.start), np.int64)
        if self.keep_space and len(front):
            prev = data[np.maximum(w.start - 1, 0)].astype(np.int64)
            prev = np.where(w.start == 0, before, prev)
            prev[w.word_off[:-1][(w.counts > 0) & (off[:-1] > 0)]] = -1  # first words of texts
            front = np.where(prev == 0x20, 1, np.where(prev == 0x0A, 2, np.where(prev == -1, self.first_kind, 0)))
        known, begin, end, word, whole = self._parts(data, w)
        n = len(begin)
        kind = np.where(begin == w.start[word], front[word], 0) if n else np.zeros(0, np.int64)
        a, b = lanes(known, begin, end)
        a = mix(a ^ _KINDS[kind])
        at = table.find(a, b)
        have = at >= 0
        lost = np.flatnonzero(~have)
        start, size = np.empty(n, np.int64), np.empty(n, np.int64)
        start[have], size[have] = table.start[at[have]], table.size[at[have]]
        if len(lost):
            order = lost[np.lexsort((b[lost], a[lost]))]
            new = np.ones(len(order), bool)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            one = order[new]
            ids, many = self._fresh(data.tobytes(), known, begin[one].tolist(), end[one].tolist(), kind[one].tolist(), whole[one].tolist())
            first = table.hold(ids) + np.cumsum(many) - many
            which = np.cumsum(new) - 1
            start[order], size[order] = first[which], many[which]
            short = end[one] - begin[one] <= LONGEST
            table.add(a[one[short]], b[one[short]], first[short], many[short])
        total = np.concatenate([[0], np.cumsum(size)])
        ids = table.pool[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, off)]

    def _uneven(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether a text must not be taken word by word."""
        out = np.zeros(len(off) - 1, bool)
        raw = None
        if self.keep_space and len(data):
            space = SPACE[data]
            bad = space & (data != 0x20) & (data != 0x0A)
            bad[1:] |= space[1:] & space[:-1]
            bad[off[:-1][off[:-1] < len(data)]] |= space[off[:-1][off[:-1] < len(data)]]
            bad[off[1:][off[1:] > 0] - 1] |= space[off[1:][off[1:] > 0] - 1]
            out = np.diff(np.concatenate([[0], np.cumsum(bad)])[off]) > 0
            if self.wide and _LEAD[data].any():
                raw = data.tobytes()
                out |= self._holds(raw, off, self.wide)
        raw = data.tobytes() if raw is None else raw
        return out | self._holds(raw, off, tuple(s.encode() for s in self.special))

    @staticmethod
    def _holds(raw: bytes, off: np.ndarray, strings: tuple[bytes, ...]) -> np.ndarray:
        out = np.zeros(len(off) - 1, bool)
        for s in strings:
            at = raw.find(s)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                if at + len(s) <= off[i + 1]:
                    out[i] = True
                    at = raw.find(s, int(off[i + 1]))
                else:
                    at = raw.find(s, at + 1)
        return out

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A plain text of any length, in pieces that begin at words."""
        out, before = [], -1
        for a, e in stretches(data, SLICE_BYTES):
            if a:  # white space
                before, a = int(data[a]), a + 1
            out.append(self._words(data[a:e], np.array([0, e - a]), before)[0])
        return np.concatenate(out) if out else np.zeros(0, self.dtype)

    def batch(self, texts: pa.Array | Iterable[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, then the end id."""
        col = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(list(texts), pa.large_string())
        data, off = text_buffers(col)
        tail = np.zeros(0, self.dtype) if end_id is None else np.asarray([end_id], self.dtype)
        out: list[np.ndarray] = []
        for i, j in slices(off):
            part, cuts = data[off[i] : off[j]], off[i : j + 1] - off[i]
            uneven = self._uneven(part, cuts)
            if j == i + 1 and len(part) > SLICE_BYTES:
                ids = self._apart(part.tobytes().decode()) if uneven[0] else self._long(part)
                out.append(np.concatenate([ids, tail]))
                continue
            ids, at = self._words(part, cuts)
            n = np.diff(at)
            full = np.repeat(np.arange(j - i) * len(tail), n) + np.arange(len(ids))
            laid = np.empty(len(ids) + (j - i) * len(tail), self.dtype)
            laid[full] = ids
            ends = at + np.arange(j - i + 1) * len(tail)
            if len(tail):
                laid[ends[1:] - 1] = tail[0]
            got = np.split(laid, ends[1:-1]) if j > i else []
            for k in np.flatnonzero(uneven).tolist():
                got[k] = np.concatenate([self._apart(part[cuts[k] : cuts[k + 1]].tobytes().decode()), tail])
            out += got
        return out


class TextEncoder(ColumnEncoder):
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` with special tokens' strings taken
    as ordinary text; None counts as empty."""

    wide = _WIDE

    def __init__(self, path: str, keep_space: bool, end_of_text: str = "<|endoftext|>", cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self._plain = None
        self.apart = Tokenizer.from_file(path)
        self.sep, self.sep_id = end_of_text, self.apart.token_to_id(end_of_text)
        self.special = [t.content for t in self.apart.get_added_tokens_decoder().values()]
        super().__init__(np.dtype("<u2" if self.apart.get_vocab_size() <= 1 << 16 else "<u4"), keep_space, cache_words)
        self.parted = self._known_pattern(path)
        self.newline = self._whole("\n") if keep_space else np.zeros(0, self.dtype)

    @staticmethod
    def _known_pattern(path: str) -> str | None:
        """How the file's own pattern cuts words: "bytes" (space, then letters, digits or others), "lower", or in no known way."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        if d["model"].get("type") != "BPE" or d["model"].get("dropout") or d["model"].get("byte_fallback"):
            return None
        cut, norm = d["pre_tokenizer"], d["normalizer"]
        if cut and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and norm is None:
            return "bytes"
        if cut and norm and [x["type"] for x in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]:
            steps = cut.get("pretokenizers", ())
            if [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == _LOWER_PATTERN and not steps[1]["use_regex"]:
                return "lower"
        return None

    @property
    def plain(self):
        """Takes special tokens' strings as text; loaded when it is needed."""
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self.path)
            self._plain.encode_special_tokens = True
        return self._plain

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each chunk has; no chunk holds a special token's string."""
        if self.sep_id is not None:
            got = self.apart.encode_batch_fast([self.sep.join(chunks) + self.sep], add_special_tokens=False)[0].ids
            ids = np.asarray(got, self.dtype)
            end = ids == self.sep_id
            places = np.flatnonzero(end)
            if len(places) == len(chunks):
                return ids[~end], np.diff(places, prepend=-1) - 1
        each = [self._whole(c) for c in chunks]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _parts(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(w.start)
        if self.parted is None or not n:
            return data, w.start, w.end, np.arange(n), np.ones(n, bool)
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        if len(lead):  # letters U+00C0 to U+00FF
            nxt = data[lead + 1]
            lead = lead[(nxt != 0x97) & (nxt != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
        if self.parted == "lower":
            known = _LOW[data]
            known[lead + 1] += np.where(known[lead + 1] < 0x9F, 32, 0).astype(np.uint8) if len(lead) else 0
        else:
            known = data
        first = np.zeros(len(data), bool)
        first[1:] = kind[1:] != kind[:-1]
        if self.parted == "lower":
            first |= kind == _DIGIT
        odd = kind == _WHOLE
        if odd.any():
            many = np.concatenate([[0], np.cumsum(odd)])
            whole = many[w.end] > many[w.start]
            step = np.zeros(len(data) + 1, np.int8)
            step[w.start[whole]] += 1
            step[w.end[whole]] -= 1
            first &= np.cumsum(step[:-1], dtype=np.int8) == 0
        else:
            whole = np.zeros(n, bool)
        first[w.start] = True
        first &= kind > 0
        start = np.flatnonzero(first)
        word = np.searchsorted(w.start, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(data)), w.end[word])
        return known, start, end, word, whole[word]

    def _fresh(self, raw: bytes, known: np.ndarray, start: list[int], end: list[int], kind: list[int], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the table lacks, in a row, and how many each has."""
        tokenize = self.apart.model.tokenize
        space = chr(_SHOW[0x20])
        out: list = [None] * len(start)
        slow = []
        shown = _SHOW[known].tobytes().decode("utf-32-le") if not all(whole) else ""
        for i, (s, e, k, x) in enumerate(zip(start, end, kind, whole)):
            if x:
                slow.append(i)
            else:
                out[i] = [t.id for t in tokenize(space + shown[s:e] if k == 1 else shown[s:e])]
        for i in range(0, len(slow), _CALL):
            part = slow[i : i + _CALL]
            ids, count = self._encode([(" " if kind[j] == 1 else "") + raw[start[j] : end[j]].decode() for j in part])
            for j, x in zip(part, np.split(ids, np.cumsum(count)[:-1])):
                out[j] = x.tolist()
        if len(self.newline):
            front = self.newline.tolist()
            out = [front + x if k == 2 else x for x, k in zip(out, kind)]
        count = np.array([len(x) for x in out], np.int64)
        return np.array([v for x in out for v in x], self.dtype), count

    def _apart(self, text: str) -> np.ndarray:
        """A text that is not plain."""
        if any(s in text for s in self.special) or (self.keep_space and any(x in text for x in _ODD)):
            return self._whole(text)
        chunks = _BYTE_LEVEL.findall(text) if self.keep_space else [text]
        return np.concatenate([self._encode(chunks[i : i + _CALL])[0] for i in range(0, len(chunks), _CALL)]) if chunks else np.zeros(0, self.dtype)

_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, keep_space: bool, cache_words: int = CACHE_WORDS) -> TextEncoder:
    """One encoder for each Python worker and file. It outlives the task, and so does the table of its words, which is bounded;
    an encoder of another file takes its place, so that a worker holds one."""
    if (key := (path, keep_space, cache_words)) not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(path, keep_space, cache_words=cache_words)
    return _encoders[key]
