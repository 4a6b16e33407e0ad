"""Best-fit packing of documents into sequences by exact-complement hashing.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus holds:
longest first, a length's gap is filled by single lengths, pairs and triples whose sums are looked up exactly, as often as
the availability counts allow; what no exact sum fills is packed best-fit, longest first. The plan comes out as ranges of
ranks within a length, so that each piece finds its sequence from its rank by one small, bounded broadcast join.

Null texts are empty documents (their end id alone); null ids are kept; repeated rows are packed once each; empty tables give no
pieces; other columns are not read. A long text is tokenised piece by piece and held with its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from . import tokens
from .memory import lean

CAPACITY = 4096
#: Ranks are dealt within (length, salt); so many salts in all at most, besides one for each length.
MOST_SALTS, LEAST_ROWS = 50_000, 256


class Planner:
    """Packs a histogram. ``runs``: (length, first rank, end rank, first sequence, offset, pieces in a row)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.cap = capacity
        self.c = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.c[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self._gaps: dict[int, list[list[int]]] = {}

    def _take(self, length: int, bins: int, seq: int, offset: int, each: int) -> None:
        n = bins * each
        self.runs.append((length, int(self.used[length]), int(self.used[length]) + n, seq, offset, each))
        self.used[length] += n
        self.c[length] -= n

    def _pair(self, total: int, c: np.ndarray) -> tuple[int, int] | None:
        """The pair of available lengths with this sum that has the longest member."""
        if total < 2:
            return None
        has = c[1:total] > 0
        both = np.flatnonzero(has & has[::-1]) + 1
        for a in both[::-1].tolist():
            if a * 2 != total or c[a] >= 2:
                return a, total - a
            # the middle needs two of its kind
        return None

    def _fill(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap exactly: one, two or three of those available."""
        c = self.c
        if c[gap] > 0:
            return (gap,)
        if two := self._pair(gap, c):
            return two
        for a in (np.flatnonzero(c[1 : gap - 1] > 0) + 1)[::-1].tolist() if gap > 2 else ():
            if 3 * a < gap:
                break  # the longest of three is at least a third
            c[a] -= 1
            two = self._pair(gap - a, c)
            c[a] += 1
            if two:
                return a, *two
        return None

    def _place(self, lengths: tuple[int, ...], bins: int) -> None:
        offset, i = 0, 0
        while i < len(lengths):
            each = lengths.count(lengths[i])
            self._take(lengths[i], bins, self.sequences, offset, each)
            offset += each * lengths[i]
            i += each
        self.sequences += bins

    def exact(self) -> None:
        """Consumes the combinations that fill a sequence exactly."""
        if self.c[self.cap]:
            self._place((self.cap,), int(self.c[self.cap]))
        for length in range(self.cap - 1, 0, -1):
            while self.c[length] > 0:
                self.c[length] -= 1
                rest = self._fill(self.cap - length)
                self.c[length] += 1
                if rest is None:
                    break
                lengths = tuple(sorted((length, *rest), reverse=True))
                self._place(lengths, min(int(self.c[x]) // lengths.count(x) for x in lengths))

    def best_fit(self) -> None:
        """The rest, longest first, each into the fullest sequences that have room; equal sequences move together."""
        room = np.zeros(self.cap + 1, np.int64)  # open sequences by gap
        for length in range(self.cap, 0, -1):
            while self.c[length] > 0:
                fits = np.flatnonzero(room[length:])
                n = int(self.c[length])
                if not len(fits):
                    each = min(self.cap // length, n)
                    bins = n // each
                    self._take(length, bins, self.sequences, 0, each)
                    self._open(room, self.cap - each * length, self.sequences, bins)
                    self.sequences += bins
                    continue
                gap = int(fits[0]) + length
                seq, bins = self._gaps[gap].pop()
                room[gap] -= bins
                each = min(gap // length, n)
                take = min(bins, n // each)
                self._take(length, take, seq, self.cap - gap, each)
                self._open(room, gap - each * length, seq, take)
                self._open(room, gap, seq + take, bins - take)

    def _open(self, room: np.ndarray, gap: int, seq: int, bins: int) -> None:
        if bins and gap:
            self._gaps.setdefault(gap, []).append([seq, bins])
            room[gap] += bins

    def plan(self) -> list[tuple[int, int, int, int, int, int]]:
        self.exact()
        self.best_fit()
        return self.runs


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises every whole text and cuts only documents of more than ``capacity`` tokens.
    doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, keep_space=False)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out: list[tuple] = []
                ids = enc.batch(b.column(1).slice(i, 256), end_id)
                for doc, x in zip(b.column(0).slice(i, 256).to_pylist(), ids):
                    x = x.astype("<u4")
                    for p in range(-(-len(x) // capacity)):
                        y = x[p * capacity : (p + 1) * capacity]
                        out.append((doc, p, p * capacity, len(y), zlib.crc32(y.tobytes())))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32, uid); reads them more than once, so they
    should be a written table. A length may hold any share of the rows, and so may one document repeated: ranks are dealt in groups
    salted by uid, which is another for each row."""
    spark = rows.sparkSession
    total = rows.count()
    target = max(LEAST_ROWS, total // MOST_SALTS)
    hist = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = spark.createDataFrame([(k, -(-n // target)) for k, n in hist.items() if n > target] or [(-1, 1)], "length long, salts long")
    keyed = rows.join(F.broadcast(salts), "length", "left").withColumn(
        "salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1).cast("long")))
    )
    groups = sorted(((r["length"], r["salt"], r["n"]) for r in keyed.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()))  # capacity + MOST_SALTS rows at most
    bases, at, last = [], 0, None
    for length, salt, n in groups:
        at = 0 if length != last else at
        bases.append((length, salt, at))
        at, last = at + n, length
    runs = Planner(hist, capacity).plan()
    base = spark.createDataFrame(bases or [(-1, 0, 0)], "length long, salt long, base long")
    plan = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in runs] or [(-1, 0, 0, 0, 0, 1)], "length long, lo long, hi long, seq long, off long, each long")
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "uid")
    ranked = keyed.withColumn("rn", F.row_number().over(w) - 1).join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("rn"))
    p = F.broadcast(plan.withColumnRenamed("length", "of"))
    hit = ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return hit.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("off") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(written(pieces(docs, path, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all of ``documents`` into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
