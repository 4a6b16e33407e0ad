"""Token-ID store: each document's ids as a zstandard frame of its own under one shared, trained dictionary.

Format: a folder with three Parquet tables, written by Spark and so readable from any store that Spark reads.

``dictionary``  one row: version, sha256 of the dictionary, the dictionary, bytes of an id, vocabulary's end id.
``blocks``      rows in ascending document order (shard, block): a payload of concatenated frames and, beside it, the
                offset index: ids of the documents, n+1 offsets into the payload, tokens of each, the dictionary's hash
                and the number of tokens before the block in its shard. Parquet's column index over ``first_doc`` and
                ``last_doc`` lets a reader of one document open one block and inflate one frame.
``shards``      one row for each shard: tokens and documents in it and before it.

Rows with equal ids stay separate documents, in order of their ids' checksum; null ids come first; null texts are empty
texts; empty tables give empty stores; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_partitions
from . import tokens
from .memory import lean
from .spread import shard_of, split_points

VERSION = 1
#: The dictionary is trained on about so many documents, twice that at most, of so many characters at most; the bound is fixed, so that
#: the driver holds at most 32 MB. Frames need no dictionary that has seen their words.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2_000, 8_000, 64 << 10
BLOCK_BYTES = 256 << 10
LEVEL = 3


def _train(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # too few or too uniform samples: frames without a dictionary
        return b""


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from the serialised ids of a bounded sample, documents of which an id's hash is low."""
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select(F.xxhash64("doc_id").alias("h"), "text")
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = short.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))  # about SAMPLE_DOCS rows or fewer
    rows = some.orderBy("h", "text").limit(2 * SAMPLE_DOCS).select("text").collect()
    enc = tokens.TextEncoder(path, keep_space=True)
    return _train([x.tobytes() for x in enc.batch([r["text"] for r in rows], end_id)])


def write(docs: DataFrame, out: str, path: str, end_id: int, parts: int | None = None) -> None:
    """Encodes every whole text and writes the store to ``out``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    zdict = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(zdict).hexdigest()
    shared = spark.sparkContext.broadcast(zdict)  # 64 KB at most
    parts = parts or shuffle_partitions(spark)
    points = split_points(docs, "doc_id", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = tokens.encoder(path, keep_space=True)
        z = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for b in batches:
            texts = b.column(1)
            for i in range(0, b.num_rows, 256):
                ids = enc.batch(texts.slice(i, 256), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, 256),
                        b.column(2).slice(i, 256),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([z.compress(x.tobytes()) for x in ids], pa.binary()),
                    ],
                    ["doc_id", "shard", "n", "crc", "frame"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "first_doc", "last_doc", "dict_sha256", "start_in_shard", "doc_ids", "offsets", "n_tokens", "payload"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        held: list[tuple] = []
        size = block = start = 0
        shard = None

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block, start
            ends = np.cumsum([0, *(len(x[3]) for x in held)]).tolist()
            ids = [x[0] for x in held]
            row = [shard, block, ids[0], ids[-1], digest, start, ids, ends, [x[2] for x in held], b"".join(x[3] for x in held)]
            start += sum(x[2] for x in held)
            held, size, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "shard", "n", "frame"))):
                if held and (size + len(x[3]) > BLOCK_BYTES or x[1] != shard):
                    yield flush()
                if x[1] != shard:
                    shard, block, start = x[1], 0, 0
                held.append(x)
                size += len(x[3])
        if held:
            yield flush()

    frames = docs.withColumn("shard", shard_of(F.col("doc_id"), points)).mapInArrow(lean(encode), "doc_id long, shard int, n long, crc long, frame binary")
    laid = frames.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "doc_id", "crc", "frame")
    laid.select("doc_id", "shard", "n", "frame").mapInArrow(
        lean(blocks),
        "shard int, block int, first_doc long, last_doc long, dict_sha256 string, start_in_shard long, doc_ids array<long>, offsets array<long>, n_tokens array<long>, payload binary",
    ).write.option("compression", "none").parquet(f"{out}/blocks")
    width = 2 if tokens.TextEncoder(path, True).dtype.itemsize == 2 else 4
    spark.createDataFrame([(VERSION, digest, bytearray(zdict), width, end_id)], "version int, sha256 string, dictionary binary, id_bytes int, end_id int").coalesce(1).write.parquet(f"{out}/dictionary")
    per = spark.read.parquet(f"{out}/blocks").select("shard", F.size("doc_ids").cast("long").alias("docs"), F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    (
        per.groupBy("shard")
        .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        .select("shard", "docs", "tokens", *(F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(f"{c}_before") for c in ("docs", "tokens")))
        .write.parquet(f"{out}/shards")
    )


def _opened(spark: SparkSession, out: str) -> tuple[bytes, str, np.dtype]:
    r = spark.read.parquet(f"{out}/dictionary").first()
    if hashlib.sha256(bytes(r["dictionary"])).hexdigest() != r["sha256"]:
        raise ValueError(f"the dictionary in {out} does not have the hash it was written with")
    return bytes(r["dictionary"]), r["sha256"], np.dtype("<u2" if r["id_bytes"] == 2 else "<u4")


def _inflate(zdict: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zdict) if zdict else None)


def read(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids as little-endian binary of
    unsigned 32-bit numbers. A frame whose length or dictionary hash is not the index's raises."""
    zdict, digest, kind = _opened(spark, out)
    shared = spark.sparkContext.broadcast(zdict)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _inflate(shared.value)
        for b in batches:
            cols = [b.column(c) for c in ("shard", "dict_sha256", "start_in_shard", "doc_ids", "offsets", "n_tokens", "payload")]
            for i in range(b.num_rows):
                shard, sha, start, ids, offsets, n, payload = (c[i].as_py() for c in cols)
                if sha != digest:
                    raise ValueError("a block was written with another dictionary")
                got = [np.frombuffer(z.decompress(payload[a:e]), kind).astype("<u4") for a, e in zip(offsets, offsets[1:])]
                if [len(x) for x in got] != n:
                    raise ValueError("a frame holds another number of ids than its index says")
                starts = start + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                arrays = [pa.array(ids, pa.int64()), pa.array([shard] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64())]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.tobytes() for x in got], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    blocks = spark.read.parquet(f"{out}/blocks").select("shard", "dict_sha256", "start_in_shard", "doc_ids", "offsets", "n_tokens", "payload")
    rows = blocks.mapInArrow(lean(decode), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    shards = spark.read.parquet(f"{out}/shards").select("shard", "tokens_before")  # one row for each shard
    keep = ["doc_id", (F.col("start") + F.col("tokens_before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return rows.join(F.broadcast(shards), "shard").select(*keep)


def lookup(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """Short-document access: opens the blocks whose range holds the id and inflates that document's frames alone."""
    zdict, _, kind = _opened(spark, out)
    z = _inflate(zdict)
    hit = spark.read.parquet(f"{out}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("doc_ids", "offsets", "payload").collect()
    return [np.frombuffer(z.decompress(bytes(r["payload"][r["offsets"][i] : r["offsets"][i + 1]])), kind).astype("<u4") for r in hit for i, d in enumerate(r["doc_ids"]) if d == doc_id]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all of ``documents`` and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    out = scratch_path(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(spark, out, with_ids=False)
