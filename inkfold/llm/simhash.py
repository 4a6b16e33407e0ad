"""SimHash fingerprints and a permuted block index over them.

A fingerprint's bit is the sign of the sum of votes that the text's terms cast with the bits of their hashes; a term votes
as often as it occurs, so that its weight is its count. Terms are runs of words (``TERM_WORDS``); a text of fewer words
than the longest run has the shorter runs alone, and a text without words the zero fingerprint. Votes are counted by
histograms of hash bytes: for each text and byte place, 256 counters times a 256 x 8 table of signs.

``near_prints`` finds for every distinct fingerprint all others up to a Hamming radius: bits are cut into blocks, radius differing
bits leave ``blocks - radius`` blocks alike, so a table for each such choice of blocks, permuted to the front as the key, meets
every pair (Manku, Jain, Das Sarma 2007). No pair is missed, whatever the fingerprints. A key's prints are compared in blocks of
``BLOCK_ROWS``, each pair of blocks a task's group of its own, so that a common key is dealt over many tasks; what leaves a task is a
number of neighbours for each print and a spanning forest, never the pairs. A pair that meets in several tables counts in the first.

Null texts are empty texts; repeated rows are fingerprinted each and are one fingerprint in the index; null ids come first; an empty
table gives no rows; other columns are not read. Long texts are taken in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written
from .chosen_path import _forest
from .components import components
from .groups import grouped
from .memory import lean
from .spread import shard_of, split_points
from .words import hashed, mix, runs

BITS = 128
#: Bits by which near fingerprints differ at most; prints of a key that are compared in one group.
RADIUS, BLOCK_ROWS = 3, 1_024
#: (words of a term, weight of one occurrence)
TERM_WORDS = ((1, 1), (2, 2), (3, 3))
_SIGN = (((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1) * 2 - 1).astype(np.float64)
_SALT = 0xA24BAED4963EE407


def _votes(h: np.ndarray, off: np.ndarray, texts: int, bits: int) -> np.ndarray:
    out = np.zeros((texts, bits))
    if not len(h):
        return out
    base = np.repeat(np.arange(texts) * 256, np.diff(off))
    for lane in range(bits // 64):
        v = mix(h ^ np.uint64(lane * _SALT % 2**64)) if lane else h
        for byte in range(8):
            seen = np.bincount(base + ((v >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), minlength=texts * 256)
            out[:, lane * 64 + byte * 8 : lane * 64 + byte * 8 + 8] = seen.reshape(texts, 256) @ _SIGN
    return out


def fingerprints(texts: pa.Array, bits: int = BITS, terms: tuple = TERM_WORDS) -> np.ndarray:
    """Fingerprints of whole texts as rows of bits / 64 unsigned numbers."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    longest = max(k for k, _ in terms)
    votes, row = np.zeros((0, bits)), -1
    for p in hashed(texts, longest - 1, lower=True):
        if p.first != row:
            votes, row = np.zeros((p.end - p.first, bits)), p.first
        for k, weight in terms:
            # of the words that came with the piece before, a shorter run was counted there
            skip = max(0, len(p.h) - p.fresh - (k - 1))
            h, cut = p.h[skip:], np.maximum(p.word_off - skip, 0)
            g, goff = (h, cut) if k == 1 else runs(h, cut, k)
            votes += weight * _votes(g, goff, p.end - p.first, bits)
        out[p.first : p.end] = np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)
    return out


def as_hex(prints: np.ndarray) -> list[str]:
    return ["".join(f"{int(x):016x}" for x in row) for row in prints[:, ::-1]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of bits that differ."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (64 * a.shape[1])


def fingerprint_table(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint (hex, highest bit first) of every document; null texts have the zero fingerprint."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_hex(fingerprints(b.column(1), bits)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(go), "doc_id long, fingerprint string")


def near_prints(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """Of every distinct fingerprint: fingerprint, class_print (the same for prints joined by steps of at most ``radius`` bits) and
    n_near (other prints within the radius). More blocks make longer keys, so fewer chance meetings, and more tables: C(blocks,
    radius). Null fingerprints take no part."""
    blocks = blocks or radius + 1
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    spark = prints.sparkSession
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = np.array([[sum(1 << (b - 64 * lane) for b in range(max(a, 64 * lane), min(e, 64 * lane + 64))) for lane in range(bits // 64)] for a, e in zip(cuts, cuts[1:])], np.uint64)
    tables = list(combinations(range(blocks), blocks - radius))
    chosen = np.array([np.bitwise_or.reduce(masks[list(t)], axis=0) if t else np.zeros(bits // 64, np.uint64) for t in tables])
    one = written(prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct(), "prints")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = from_hex(b.column(0).to_pylist(), bits)
            for t, mask in enumerate(chosen):
                key = np.full(len(v), np.uint64(t + 1) * np.uint64(_SALT % 2**64))
                for lane in range(v.shape[1]):
                    key = mix(key ^ mix((v[:, lane] & mask[lane]) + np.uint64(lane)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(key.view(np.int64)), b.column(0)], ["t", "key", "fingerprint"])

    rows = written(one.mapInArrow(lean(keyed), "t int, key long, fingerprint string"), "tables")
    size = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("chunks"))
    met = rows.join(size, ["t", "key"])
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    dealt = met.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("t", "key", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "fingerprint")
    laid = dealt.repartition(shuffle_partitions(spark), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["t", "key", "i", "j"]):
            names = g.column(5).to_pylist()
            own = g.column(4).to_numpy()
            t, i, j = (g.column(k)[0].as_py() for k in (0, 2, 3))
            if i != j and len(np.unique(own)) < 2:
                continue
            v = from_hex(names, bits)
            near = np.zeros((len(v), len(v)), bool)
            for k in range(0, len(v), 128):
                x = v[k : k + 128, None, :] ^ v[None, :, :]
                close = np.bitwise_count(x).sum(axis=2) <= radius
                # counted in the first table whose blocks are all alike
                alike = np.stack([((x & m) == 0).all(axis=2) for m in chosen[: t + 1]])
                near[k : k + 128] = close & (alike.argmax(axis=0) == t) & alike[t]
            np.fill_diagonal(near, False)
            if i != j:
                near &= own[:, None] != own[None, :]
            n = near.sum(axis=1)
            if n.any():
                root = _forest(near)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([names[r] for r in root]), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    found = written(laid.mapInArrow(lean(compare), "a string, b string, n long"), "near")
    label = components(found.where("a <> b").select("a", "b"))
    count = found.groupBy("a").agg(F.sum("n").alias("n_near"))
    out = one.join(label.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").join(count.withColumnRenamed("a", "fingerprint"), "fingerprint", "left")
    return out.select("fingerprint", F.coalesce("label", "fingerprint").alias("class_print"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def from_hex(names: list[str], bits: int = BITS) -> np.ndarray:
    """Rows of bits / 64 numbers of hex fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join(names)), ">u8").reshape(-1, bits // 64) if names else np.zeros((0, bits // 64))
    return raw[:, ::-1].astype(np.uint64)


def near_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every document with its fingerprint, class_print and n_near."""
    prints = written(fingerprint_table(docs), "fingerprints")
    return prints.join(near_prints(prints, radius), "fingerprint").select("doc_id", "fingerprint", "class_print", "n_near")


def edited_prints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the beginning of the next document's.

    Documents stand in order of (doc_id, text), null ids first; the last is followed by the lowest id. Null texts are
    empty. Rows are dealt by ranges of doc_id that begin at existing ids, so that the first document of a range, dealt to
    the range before it too, is all that a range needs of its neighbour."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    points = split_points(docs, "doc_id", parts)
    first = docs.agg(F.min("doc_id")).first()[0]
    own = shard_of(F.col("doc_id"), points)
    heads = [x for x in [first, *points] if x is not None]
    last = len(points)
    shard = F.when(F.col("doc_id").isin(heads), F.array(own, F.when(F.col("doc_id") == F.lit(first), F.lit(last)).otherwise(own - 1))).otherwise(F.array(own)) if heads else F.array(own)
    dealt = docs.select("doc_id", "text", F.posexplode(shard).alias("ahead", "shard"))
    laid = dealt.repartitionById(parts, F.col("shard")).sortWithinPartitions("ahead", "doc_id", "text").select("doc_id", "text", "ahead")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def out(ids: list, texts: list[str]) -> pa.RecordBatch:
            """Of all rows but the last."""
            edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
            fp, fe = fingerprints(pa.array(texts, pa.string()), bits), fingerprints(pa.array(edited, pa.string()), bits)
            cols = [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(e.encode()).hexdigest() for e in edited], as_hex(fp[:-1]), as_hex(fe), likeness(fp[:-1], fe), likeness(fp[:-1], fp[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        ids: list = []
        texts: list[str] = []
        size, ended = 0, False
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                for doc, text, ahead in zip(*(c.column(k).to_pylist() for k in range(3))):
                    if ended:
                        continue
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
                    ended = ahead == 1
                    if len(ids) > 1 and (size > 1 << 20 or ended):
                        yield out(ids, texts)
                        ids, texts, size = ids[-1:], texts[-1:], len(text)
        if ids and not ended:  # nothing follows: no document has an id, or the first is the only one
            yield out(ids + ids[:1], texts + texts[:1])

    return laid.mapInArrow(lean(go), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of ``documents``, of their edited texts, and their likeness to both the edited and the next text."""
    return edited_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all of ``documents``: how many other fingerprints lie within three bits, and the class they make."""
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
