"""Removal of passages that occur elsewhere, by a log-structured fingerprint index.

Every window of ``WINDOW`` words has an anchor: the least hash among its runs of ``ANCHOR`` words. Equal windows have equal
anchors, and neighbouring windows mostly share theirs, so an index of anchors is a twelfth of an index of windows. The index is
log-structured: each batch of documents becomes an immutable run of (hash, count), bucketed and sorted by hash, and is
merge-joined with every run before it, bucket by bucket; what is met there, or twice in the batch, is a candidate. Too many runs
are merged into one.

Candidates go into a Bloom filter of fixed size (``FILTER_BITS``, whatever the corpus holds); a second scan finds the windows
whose anchor is in it and takes their own hashes (96 bits), which verifies them: a window met twice in a stretch of the input
(``UNIT_BYTES``) is a repeat there and then, and one of it goes on with a weight of two; all others are counted exactly over all
documents by one shuffle. However common a passage is, each stretch sends at most one row of a window, so that no task gets a
share beyond that. A fuller filter means more rows to count, never another result.

An index that the caller keeps also holds the hashes of all windows of the calls before, in sorted runs of their own; the
candidates of a new call are merge-joined with every run, so that a window that history has even once is a repeat. The words of
the earlier documents stay as they were given back. Without such an index there is no history, and no window runs are written.

Windows are judged on the input, not on what is left. Null, empty and short texts keep all their words; rows with equal id and
text are documents of their own, so that their windows repeat; an empty table gives no rows; null ids are kept. Other columns are
carried in one struct, so that no name of theirs can clash. Texts of more than a slice are worked on in overlapping pieces: beside
the text itself memory grows with its repeated places alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import drop_path, scratch_path, shuffle_partitions, written
from .memory import lean
from .words import Piece, Words, hashed, joined, mix, runs, text_buffers

WINDOW, ANCHOR = 35, 12
#: The filter: SLICES parts of equal size, 32 MB in all.
FILTER_BITS, SLICES = 1 << 28, 64
_SLICE = FILTER_BITS // SLICES
MOST_RUNS = 4
#: Bytes of text within which repeats are found before the shuffle.
UNIT_BYTES = 4 << 20
_LANE = np.uint64(0x8CB92BA72F3D8DD7)


def _sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """op over every w neighbours."""
    if len(a) < w:
        return a[:0]
    s, b = 1, a
    while 2 * s <= w:
        b = op(b[:-s], b[s:])
        s *= 2
    return op(b[: len(b) - (w - s)], b[w - s :]) if w > s else b


class Windows:
    """The windows of a piece's texts and their anchors."""

    def __init__(self, p: Piece, window: int, anchor: int) -> None:
        self.h, self.word_off = p.h, p.word_off
        self.grams, self.gram_off = runs(self.h, p.word_off, anchor)
        span = window - anchor + 1
        self.n = np.maximum(np.diff(p.word_off) - window + 1, 0)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        low = _sliding(np.minimum, self.grams, span)
        self.at = np.arange(self.off[-1]) + np.repeat(self.gram_off[:-1] - self.off[:-1], self.n)  # windows among the gram places
        self.anchor = low[self.at] if len(low) else low
        self.span = span

    def anchors(self) -> np.ndarray:
        """Hashes of all runs of words that are the least of some window, one for each place."""
        if not len(self.at):
            return self.grams[:0]
        most = np.zeros(len(self.grams) + self.span - 1, np.uint64)
        most[self.at + self.span - 1] = self.anchor
        return self.grams[_sliding(np.maximum, most, self.span) == self.grams]


class RunIndex:
    """Sorted immutable runs of keys and n: bucketed tables in a folder of the shared store, so that runs are joined bucket by
    bucket without a shuffle; ``windows`` is the index of window hashes beside it."""

    def __init__(self, spark: SparkSession, path: str, keys: str = "h long") -> None:
        self.spark, self.path = spark, path
        self.schema, self.keys = f"{keys}, n long", [k.split()[0] for k in keys.split(",")]
        self.buckets = shuffle_partitions(spark)
        self.windows = RunIndex(spark, f"{path}/windows", "h long, g int") if len(self.keys) == 1 else None
        self.runs: list[str] = []
        self.found: list[str] = []
        self.made = 0

    def _write(self, hashes: DataFrame) -> str:
        """Counts become a run. The counting's own shuffle lays out the buckets, so its partitions must not be coalesced."""
        name = f"inkfold_run_{uuid.uuid4().hex}"
        held = self.spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        shuffle = self.spark.conf.get("spark.sql.shuffle.partitions")
        try:
            self.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.buckets))
            counted = hashes.groupBy(*self.keys).agg(F.sum("n").alias("n"))
            counted.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.path}/run-{self.made}").saveAsTable(name)
        finally:
            self.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
            self.spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        self.made += 1
        return name

    def _drop(self, name: str) -> None:
        where = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, where)

    def append(self, hashes: DataFrame, tell: bool = True) -> None:
        """Makes the batch's hashes (h, n) a run, merge-joined with the runs before; merges the runs if there are too many."""
        run = self._write(hashes)
        if tell:
            fresh = self.spark.table(run)
            met = fresh.where(F.col("n") > 1).select(*self.keys)
            for r in self.runs:
                met = met.union(fresh.join(self.spark.table(r).hint("merge"), self.keys, "left_semi").select(*self.keys))
            self.found.append(f"{self.path}/found-{self.made}")
            met.write.parquet(self.found[-1])
        self.runs.append(run)
        if len(self.runs) > MOST_RUNS:
            self.compact()

    def hits(self, hashes: DataFrame) -> DataFrame:
        """Merge-join of some hashes with every run: those that the index already has."""
        batch = hashes.select(*self.keys).distinct()
        found = [batch.join(self.spark.table(r).hint("merge"), self.keys, "left_semi") for r in self.runs]
        out = found[0] if found else batch.limit(0)
        for f in found[1:]:
            out = out.union(f)
        return out.distinct()

    def merged(self) -> DataFrame:
        """All runs as one: keys and n."""
        if not self.runs:
            return self.spark.createDataFrame([], self.schema)
        out = self.spark.table(self.runs[0])
        for r in self.runs[1:]:
            out = out.union(self.spark.table(r))
        return out.groupBy(*self.keys).agg(F.sum("n").alias("n")) if len(self.runs) > 1 else out

    def compact(self) -> None:
        """Merges the runs into one."""
        old = self.runs
        self.runs = [self._write(self.merged())] if old else []
        for r in old:
            self._drop(r)
        if len(self.found) > 1:
            self.found, old = [f"{self.path}/found-merged-{self.made}"], self.found
            self._found(old).distinct().write.parquet(self.found[0])
            for f in old:
                drop_path(self.spark, f)

    def _found(self, paths: list[str]) -> DataFrame:
        ddl = ", ".join(f.strip() for f in self.schema.split(",")[:-1])
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def repeated(self) -> DataFrame:
        """Hashes met at more than one place."""
        return self._found(self.found).distinct()


def anchor_hashes(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(h, n) of a column of texts; partial counts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in hashed(b.column(0), window - 1):
                h, n = np.unique(Windows(p, window, anchor).anchors(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.mapInArrow(lean(go), "h long, n long")


def window_hashes(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, g, n) of every window of a column of texts; partial counts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in hashed(b.column(0), window - 1):
                h1, h2 = _lanes(p.h, p.word_off, window)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.ones(len(h1), np.int64))], ["h", "g", "n"])

    return texts.mapInArrow(lean(go), "h long, g int, n long")


def _lanes(h: np.ndarray, word_off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits of each window: 64 and 32."""
    h1, _ = runs(h, word_off, window)
    h2, _ = runs(mix(h ^ _LANE), word_off, window)
    return h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice of the filter a hash belongs to and its two bits there."""
    return (h >> np.uint64(58)).astype(np.int64), ((h >> np.uint64(29)) % np.uint64(_SLICE)).astype(np.int64), (mix(h) % np.uint64(_SLICE)).astype(np.int64)


def filter_of(hashes: DataFrame) -> np.ndarray:
    """The Bloom filter as SLICES rows of bytes; each slice is filled where its hashes are."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            s, i, j = _places(h)
            for k in np.unique(s).tolist():
                bits = parts.setdefault(k, np.zeros(_SLICE, bool))
                own = s == k
                bits[i[own]] = True
                bits[j[own]] = True
        for k, bits in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    slot = F.shiftrightunsigned("h", 58)
    got = hashes.select("h").repartition(SLICES, slot).mapInArrow(lean(go), "slice int, bits binary").collect()  # SLICES rows
    out = np.zeros((SLICES, _SLICE // 8), np.uint8)
    for r in got:
        out[r["slice"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    s, i, j = _places(h)
    one = (bits[s, i >> 3] >> (i & 7).astype(np.uint8)) & 1
    return (one & (bits[s, j >> 3] >> (j & 7).astype(np.uint8))).astype(bool)


_HIT = "h long, g int, w byte, key long, tag int, at int, ats array<int>"
_HIT_NAMES = [x.split()[0] for x in _HIT.split(", ")]


def _met(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows (h, g, key, tag, at) of a stretch of the input. Those met once there as they are; of each of the others one without
    a place, of weight two; and all places of the others as one row for each document, under its own hash and of weight two."""
    h, g, key, tag, at = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(h)))
    one = order[first[n == 1]]
    some = order[first[n > 1]]
    again = np.sort(order[np.repeat(n > 1, n)])  # in order of document and place
    k, t = key[again], tag[again]
    cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])) if len(again) else again
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(again)).astype(np.int32)), pa.array(at[again]))
    gone = lambda x, m: pa.concat_arrays([x, pa.nulls(m, x.type)])
    a, b, c = len(one), len(some), len(cut)
    key_col = pa.concat_arrays([pa.array(key[one]), pa.nulls(b, pa.int64()), pa.array(k[cut])])
    tag_col = pa.concat_arrays([pa.array(tag[one]), pa.nulls(b, pa.int32()), pa.array(t[cut])])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[one], h[some], k[cut]])),
            pa.array(np.concatenate([g[one], g[some], t[cut]])),
            pa.array(np.repeat(np.array([1, 2], np.int8), [a, b + c])),
            key_col,
            tag_col,
            gone(pa.array(at[one]), b + c),
            pa.concat_arrays([pa.nulls(a + b, lists.type), lists]),
        ],
        _HIT_NAMES,
    )


def repeated_spans(docs: DataFrame, index: RunIndex, window: int = WINDOW, anchor: int = ANCHOR):
    """For documents with key, tag, text: (key, tag, list of word places where a repeated window starts), and the filter used."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(filter_of(index.repeated()))  # FILTER_BITS / 8 bytes

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bits.value
        for b in batches:
            keys, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for p in hashed(b.column(2), window - 1):
                x = Windows(p, window, anchor)
                size += p.size
                hit = np.flatnonzero(_in_filter(f, x.anchor)) if len(x.at) else x.at
                if len(hit):
                    h1, h2 = _lanes(x.h, x.word_off, window)
                    doc = np.searchsorted(x.off, hit, "right") - 1
                    held.append((h1[hit], h2[hit], keys[p.first + doc], tags[p.first + doc], (hit - x.off[doc] + p.base).astype(np.int32)))
                if held and size >= UNIT_BYTES:
                    yield _met(held)
                    held, size = [], 0
            if held:
                yield _met(held)

    met = docs.select("key", "tag", "text").mapInArrow(lean(go), _HIT)
    if index.windows.runs:  # read at once: runs may be merged before the result is asked for
        old = written(index.windows.hits(met.where("at IS NOT NULL")), "hits")
        met = met.unionByName(old.withColumn("w", F.lit(2).cast("byte")), allowMissingColumns=True)
    weight = F.sum("w").over(Window.partitionBy("h", "g"))
    hit = met.withColumn("weight", weight).where("weight > 1 AND key IS NOT NULL")
    spans = hit.groupBy("key", "tag").agg(F.collect_set("at").alias("at"), F.flatten(F.collect_set("ats")).alias("ats"))
    return spans.select("key", "tag", F.concat("at", "ats").alias("at")), bits


def dedup(docs: DataFrame, index: RunIndex | None = None, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 2, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; with texts instead row, a struct of all columns of ``docs`` with the kept text
    as text, and the last three.

    The documents join the index in so many batches; windows that an index given here has from earlier calls (of the same
    ``window`` and ``anchor``) count as repeats. A text of which nothing is removed keeps its own white space."""
    spark = docs.sparkSession
    kept_index = index is not None
    index = index or RunIndex(spark, scratch_path(spark, "runs"))
    text = F.col("text").cast("string")
    kept_columns = docs.columns if with_text else ["doc_id"]
    # a row is known by 96 bits of its id and text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"), (F.coalesce(F.crc32(text.cast("binary")), F.lit(0)) - F.lit(1 << 31)).cast("int").alias("tag"))
    parts = [rows.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == k).select("text") for k in range(batches)]
    for part in parts:
        index.append(anchor_hashes(part, window, anchor))
    spans, bits = repeated_spans(rows, index, window, anchor)
    if kept_index:
        for part in parts:
            index.windows.append(window_hashes(part, window), tell=False)
    row_type = rows.schema["row"]

    def flag(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether a text has a candidate window; the digest of those that have none."""
        f = bits.value
        for b in bs:
            maybe = np.zeros(b.num_rows, bool)
            count = np.zeros(b.num_rows, np.int64)
            for p in hashed(b.column(1), window - 1):
                x = Windows(p, window, anchor)
                if p.end == p.first + 1:
                    count[p.first] += p.fresh
                else:
                    count[p.first : p.end] = np.diff(p.word_off)
                if len(x.at):
                    per = np.concatenate([[0], np.cumsum(_in_filter(f, x.anchor))])
                    maybe[p.first : p.end] |= per[x.off[1:]] > per[x.off[:-1]]
            data, off = text_buffers(b.column(1))
            sha = [None if maybe[d] else _digest(joined(data[off[d] : off[d + 1]])) for d in range(b.num_rows)]
            text = b.column(1)
            if not with_text:
                text = pc.if_else(pa.array(maybe), text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([b.column(0), text, b.column(2), b.column(3), pa.array(count), pa.array(sha, pa.string())], ["row", "text", "key", "tag", "n_words", "sha"])

    flagged = rows.mapInArrow(lean(flag), StructType([row_type, *StructType.fromDDL("text string, key long, tag int, n_words long, sha string").fields]))
    both = flagged.join(spans, ["key", "tag"], "left").select("row", "text", "n_words", "sha", "at")

    def finish(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bs:
            sha = b.column(3).to_pylist()
            data, off = text_buffers(b.column(1))
            at = b.column(4)
            removed = np.zeros(b.num_rows, np.int64)
            cut = np.zeros(b.num_rows, bool)
            texts: list[str | None] = [None] * b.num_rows
            for d in range(b.num_rows):
                raw = data[off[d] : off[d + 1]]
                if at[d].is_valid:
                    pieces, removed[d] = _kept(raw, at[d].values.to_numpy(zero_copy_only=False), window)
                    sha[d], cut[d] = _digest(pieces), True
                    texts[d] = b"".join(pieces).decode() if with_text else None
                elif sha[d] is None:
                    sha[d] = _digest(joined(raw))
            new = pc.if_else(pa.array(cut), pa.array(texts, b.column(1).type), b.column(1)) if with_text else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), new, b.column(2), pa.array(removed), pa.array(sha, pa.string())], ["row", "kept", "n_words", "n_removed", "kept_sha256"])

    out = both.mapInArrow(lean(finish), StructType([row_type, *StructType.fromDDL("kept string, n_words long, n_removed long, kept_sha256 string").fields]))
    own = ("n_words", "n_removed", "kept_sha256")
    return out.select(F.col("row").withField("text", F.col("kept")).alias("row"), *own) if with_text else out.select("row.doc_id", *own)


def _digest(pieces: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for p in pieces:
        sha.update(p)
    return sha.hexdigest()


def _kept(raw: np.ndarray, at: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """The words of a text that no window from these places covers, joined by one space, in pieces; how many are left out."""
    w = Words(raw, np.array([0, len(raw)]))
    cover = np.zeros(len(w.start) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + window, len(w.start)), -1)
    keep = np.cumsum(cover[:-1]) == 0
    start, end = w.start[keep], w.end[keep]
    out = []
    for i in range(0, len(start), 1 << 16):
        a = int(start[i])
        part = raw[a : end[min(i + (1 << 16), len(end)) - 1]].tobytes()
        words = [part[x - a : y - a] for x, y in zip(start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist())]
        out.append((b" " if i else b"") + b" ".join(words))
    return out, int(len(keep) - len(start))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from all of ``documents`` the words of 35-word windows that also start anywhere else."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
