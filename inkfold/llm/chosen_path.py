"""Jaccard self-join of word shingles by chosen paths.

Sets are the distinct hashes of all runs of five words of a text (of all its words, if it has one to four). Documents with the
same set are one class from the start. Each set is embedded as 64 tokens, the minima of the whole set under 64 hash functions,
so that two sets share each token with a probability of their similarity, however few shingles they have. The embedded sets are
then split recursively (Christiani, Pagh 2017; Christiani, Pagh, Sivertsen 2018): a node of the recursion samples one of the 64
coordinates by a hash of its path, and another with probability ``SECOND``, and sends a set to one child for each of them, that of
the token which the set has there. Two sets at 0.8 so share 0.8 * (1 + SECOND) children of a node, one on average, and their
common path seldom dies out. Nodes of ``LIMIT`` sets or fewer go no deeper, nor does any after ``DEPTH`` steps. The search is
repeated in ``RUNS`` runs with a root coordinate of their own each: a pair at 0.8 that needs the full depth is missed with
probability 2e-4, and every pair that needs less of it more seldom; the tests measure recall for 8 to 30 words.

Within the buckets left, pairs that agree in enough of the 64 tokens, taken byte-wide, join a cluster (a pair of similarity 0.8
fails that with a probability of 2e-8). Each cluster is then brute-forced once, with its exact sets, in blocks: a large cluster is
dealt over pairs of blocks of about ``BLOCK_TOKENS`` tokens, so that neither a task nor its memory grows with it, and only counts
of links and a spanning forest leave a task, never all pairs. The counts are part of the result, so within a cluster all pairs of
different sets are compared, as products of tables.

Classes are the connected components of the links. Null and empty texts have no shingles and stay alone; documents with equal
sets are linked; repeated rows are documents of their own; null ids count as the greatest; an empty table gives no rows; other
columns are not read. Sets and rows are known by 128 bits. A text's set is held in memory whole: some 60 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written
from .components import components
from .groups import grouped
from .memory import lean
from .substrings import _in_filter, filter_of
from .words import Words, mix, runs, worded

SHINGLE, THRESHOLD = 5, 0.8
RUNS, DEPTH, LIMIT = 12, 4, 64
#: Tokens of an embedded set; how often a node samples a second one; tasks that a crowded node's sets are dealt over.
COORDS, SECOND, SALTS = 64, 0.25, 32
#: Coordinates of 64 that a pair must share to be compared exactly.
AGREE = 32
#: Sets of a bucket that are compared by their coordinates in one task; tokens and sets of a block in the exact comparison.
BUCKET_ROWS, BLOCK_TOKENS, BLOCK_ROWS = 512, 200_000, 1_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240301))
_XOR, _ODD = _rng.integers(0, 2**64 - 1, COORDS, np.uint64), _rng.integers(0, 2**63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The coordinate that each run's root samples: drawn without replacement, so that no run repeats another.
_ROOTS = _rng.permutation(COORDS)[:RUNS]
#: Paths expanded at a time.
_PATHS = 4_096


def shingle_sets(w: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    h = w.hashes()
    g, off = runs(h, w.word_off, size)
    n = np.diff(w.word_off)
    out = [np.unique(g[a:e]) for a, e in zip(off[:-1].tolist(), off[1:].tolist())]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            s, so = runs(h, w.word_off, k)
            for i in short.tolist():
                out[i] = s[so[i] : so[i] + 1]
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    v = mix(s + _STEP)
    u = mix(v ^ _STEP)
    both = np.array([np.add.reduce(v) ^ np.uint64(len(s)), np.add.reduce(u) ^ np.bitwise_xor.reduce(v)], np.uint64)
    one, two = mix(both).view(np.int64).tolist()
    return one, two


def _sketches(sets: list[np.ndarray]) -> list[bytes | None]:
    """Of each set the hash of its least token under each of COORDS hash functions; None for an empty one."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[bytes | None] = [None] * len(sets)
    if not full:
        return out
    tokens = mix(np.concatenate([sets[i] for i in full]))
    first = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    m = np.empty((len(full), COORDS), np.uint32)
    v = np.empty_like(tokens)
    for k in range(COORDS):
        np.bitwise_xor(tokens, _XOR[k], out=v)
        v *= _ODD[k]
        m[:, k] = mix(np.minimum.reduceat(v, first))
    for r, i in enumerate(full):
        out[i] = m[r].tobytes()
    return out


def row_key() -> Column:
    """Of a document: 128 bits, equal only for repeated rows."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part("doc_id"), F.lit(","), part("text")).cast("binary")))


def _source(docs: DataFrame) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.select(row_key().alias("key"), "doc_id", "text")


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """key, doc_id, id and id2 (digest of the set), n, sketch of every document; ids and sketch are null without shingles."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in worded(b.column(2), lower=True):
                sets = shingle_sets(w, size)
                digests = [_digest(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        b.column(1).slice(i, j - i),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_sketches(sets), pa.binary()),
                    ],
                    ["key", "doc_id", "id", "id2", "n", "sketch"],
                )

    return _source(docs).mapInArrow(lean(go), "key binary, doc_id long, id long, id2 long, n long, sketch binary")


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and one row for each set: id, n, sketch, first (least document), copies. Where two sets share the 64 bits of id
    they get ids from all their bits."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key")))
    while True:
        grouped_sets = rows.where("id IS NOT NULL").groupBy("id").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), first.alias("first"), F.count("*").alias("copies"), F.min("id2").alias("lo"), F.max("id2").alias("hi")
        )
        sets = written(grouped_sets, "sets")
        clash = sets.where("lo <> hi").select("id")
        if clash.isEmpty():
            return rows, sets.drop("lo", "hi")
        again = rows.join(clash.withColumn("clash", F.lit(True)), "id", "left")
        rows = written(again.withColumn("id", F.when(F.col("clash"), F.xxhash64("id", "id2")).otherwise(F.col("id"))).drop("clash"), "sketches")


def _child(path: np.ndarray, token: np.ndarray, coord: np.ndarray) -> np.ndarray:
    """The path to the child that holds this token at this coordinate."""
    return mix(path * _STEP + mix(token.astype(np.uint64) ^ _XOR[coord]))


def children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes (one path hash each) and the embedded set at each: which node, and the path, of every child."""
    h = mix(path ^ _STEP)
    one = (h % np.uint64(COORDS)).astype(np.int64)
    more = np.flatnonzero((h >> np.uint64(40)) < np.uint64(int(SECOND * 2**24)))
    two = (one[more] + 1 + ((h[more] >> np.uint64(16)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
    at, coord = np.concatenate([np.arange(len(path)), more]), np.concatenate([one, two])
    return at, _child(path[at], tokens[at, coord], coord)


def _tokens_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, COORDS)


_NODE = "p long, id long"


def _nodes(p: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(ids)], ["p", "id"])


def roots(sets: DataFrame) -> DataFrame:
    """(p, id): the child of each run's root."""
    start = mix((np.arange(RUNS, dtype=np.uint64) + np.uint64(1)) * _STEP)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ids = _tokens_of(b.column(1)), b.column(0).to_numpy()
            for r, c in enumerate(_ROOTS):
                yield _nodes(_child(start[r : r + 1], m[:, c], c), ids)

    return sets.select("id", "sketch").mapInArrow(lean(go), _NODE)


def deeper(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, id): the children of the nodes (p, id)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ids, paths = _tokens_of(b.column(1)), b.column(0).to_numpy(), b.column(2)
            own = np.repeat(np.arange(len(ids)), np.diff(paths.offsets.to_numpy()))
            at_path = paths.flatten().to_numpy().view(np.uint64)
            for i in range(0, len(own), _PATHS):
                row = own[i : i + _PATHS]
                at, p = children(at_path[i : i + _PATHS], m[row])
                yield _nodes(p, ids[row[at]])

    # a set is at a few nodes of a level, so the lists are short
    at = nodes.groupBy("id").agg(F.collect_list("p").alias("ps")).join(sets.select("id", "sketch"), "id").select("id", "sketch", "ps")
    return at.mapInArrow(lean(go), _NODE)


def sized(nodes: DataFrame) -> DataFrame:
    """(p, id, size): the nodes (a written table) with as many sets as come there, without those of one. Crowded nodes, at most eight
    for each partition, are salted, so that no task gets all rows of a node."""
    spark = nodes.sparkSession
    sizes = written(nodes.groupBy("p").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    most = max(LIMIT, total // (8 * shuffle_partitions(spark)))
    crowded = spark.sparkContext.broadcast(np.sort(np.array([r["p"] for r in sizes.where(F.col("size") > most).select("p").collect()], np.int64)))

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = crowded.value
        for b in batches:
            p, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            salt = np.zeros(len(p), np.int32)
            if len(names):
                here = names[np.minimum(np.searchsorted(names, p), len(names) - 1)] == p
                salt = np.where(here, (mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), salt)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(salt)], ["p", "id", "salt"])

    salts = F.when(F.col("size") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    laid = sizes.select("p", "size", F.explode(salts).alias("salt"))
    return nodes.mapInArrow(lean(salted), "p long, id long, salt int").join(laid, ["p", "salt"]).select("p", "id", "size")


def buckets(sets: DataFrame) -> DataFrame:
    """(bucket, id, size): where the paths end, without buckets of one set and with one of those that hold the same sets."""
    found: DataFrame | None = None
    left = roots(sets)
    for d in range(1, DEPTH + 1):
        here = written(sized(written(left, "paths")), "nodes")
        ends = (here if d == DEPTH else here.where(F.col("size") <= LIMIT)).select(F.col("p").alias("bucket"), "id", "size")
        found = ends if found is None else found.union(ends)
        big = here.where(F.col("size") > LIMIT)
        if d == DEPTH or big.isEmpty():
            break
        left = deeper(big, sets)
    same = found.groupBy("bucket").agg(F.first("size").alias("size"), F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(F.xxhash64("id")).alias("x"))
    one = same.groupBy("size", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket")
    return found.join(one, "bucket")


def _forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric table of links, the least member of each one's component."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cluster_edges(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the sets in a bucket that agree in enough coordinates."""
    spark = sets.sparkSession

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _tokens_of(b.column(1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in m], pa.binary())], ["id", "sketch"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        size = 0
        for g in grouped(batches, ["bucket", "i", "j"]):
            ids = g.column(g.schema.get_field_index("id")).to_numpy()
            if len(ids) < 2:
                continue
            m = np.frombuffer(b"".join(g.column(g.schema.get_field_index("sketch")).to_pylist()), np.uint8).reshape(len(ids), COORDS)
            near = np.empty((len(m), len(m)), bool)
            for k in range(0, len(m), 64):
                near[k : k + 64] = (m[k : k + 64, None, :] == m[None, :, :]).sum(axis=2) >= AGREE
            root = _forest(near)
            other = np.flatnonzero(root != np.arange(len(root)))
            if len(other):
                a.append(ids[root[other]])
                b.append(ids[other])
                size += len(other)
            if size > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    bytes8 = sets.select("id", "sketch").mapInArrow(lean(narrow), "id long, sketch binary")
    chunks = F.ceil(F.col("size") / BUCKET_ROWS).cast("int")
    rows = members.join(bytes8, "id")
    dealt = _block_pairs(rows.withColumn("chunks", chunks), "bucket")
    parts = shuffle_partitions(spark)
    return dealt.select("bucket", "i", "j", "id", "sketch").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(lean(go), "a long, b long")


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Each row once for each pair of blocks i <= j of its group that its own block is in; chunks blocks to a group."""
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("i", F.least("own", "x")).withColumn("j", F.greatest("own", "x")).drop("x", "chunks")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0/1 tables over slices of the tokens both sides have."""
    ta, tb = np.concatenate(a), np.concatenate(b)
    seen, place = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    na = np.bincount(place[: len(ta)], minlength=len(seen))
    nb = np.bincount(place[len(ta) :], minlength=len(seen))
    use = np.flatnonzero((na > 0) & (nb > 0)) if a is not b else np.flatnonzero(na > 1)
    code = np.full(len(seen), -1)
    code[use] = np.arange(len(use))
    ca, cb = code[place[: len(ta)]], code[place[len(ta) :]]
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    out = np.zeros((len(a), len(b)), np.float32)
    wide = max(1, (8 << 20) // (len(a) + len(b)))
    order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    sa, sb = ca[order_a], cb[order_b]
    for lo in range(0, len(use), wide):
        hi = min(lo + wide, len(use))
        x = np.zeros((len(a), hi - lo), np.float32)
        y = np.zeros((len(b), hi - lo), np.float32)
        p = order_a[np.searchsorted(sa, lo) : np.searchsorted(sa, hi)]
        q = order_b[np.searchsorted(sb, lo) : np.searchsorted(sb, hi)]
        x[ra[p], ca[p] - lo] = 1
        y[rb[q], cb[q] - lo] = 1
        out += x @ y.T
    return out


def exact_links(docs: DataFrame, clusters: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Brute force within clusters (id, cluster, n, key, copies), key being a row that has the set: rows (a, b, links) - for b
    not null a spanning edge of links, else the number of documents that a's set is linked to in one pair of blocks."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(filter_of(clusters.select(F.xxhash64("key").alias("h"))))  # fixed size

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bits.value
        for b in batches:
            b = b.filter(pa.array(_in_filter(f, b.column(2).to_numpy().view(np.uint64))))
            for i, j, w in worded(b.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(w, size)], pa.binary())], ["key", "tokens"])

    sets = _source(docs).select("key", "text", F.xxhash64("key").alias("hash")).mapInArrow(lean(load), "key binary, tokens binary").dropDuplicates(["key"])
    many = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_ROWS)).cast("int").alias("chunks"))
    rows = sets.join(clusters, "key").select("id", "cluster", "copies", "tokens").join(many, "cluster")
    dealt = _block_pairs(rows, "cluster")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

        for g in grouped(batches, ["cluster", "i", "j"]):
            col = {n: g.column(k) for k, n in enumerate(g.schema.names)}
            ids, own, copies = (col[n].to_numpy() for n in ("id", "own", "copies"))
            tokens = [np.frombuffer(t, np.uint64) for t in col["tokens"].to_pylist()]
            i, j = col["i"][0].as_py(), col["j"][0].as_py()
            left = np.flatnonzero(own == i)
            right = np.flatnonzero(own == j) if i != j else left
            if not len(left) or not len(right) or len(ids) < 2:
                continue
            sa = [tokens[k] for k in left]
            sb = sa if i == j else [tokens[k] for k in right]
            both = _common(sa, sb)
            na, nb = np.array([len(x) for x in sa], np.float64), np.array([len(x) for x in sb], np.float64)
            near = both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-9
            if i == j:
                np.fill_diagonal(near, False)
            links = np.zeros(len(ids), np.int64)
            links[left] += near @ copies[right]
            full = np.zeros((len(ids), len(ids)), bool)
            full[np.ix_(left, right)] = near
            if i != j:
                links[right] += near.T @ copies[left]
                full |= full.T
            root = _forest(full)
            out += [(ids[root[k]], ids[k], 0) for k in np.flatnonzero(root != np.arange(len(root))).tolist()]
            out += [(ids[k], None, links[k]) for k in np.flatnonzero(links).tolist()]
            if len(out) > 10_000:
                yield flush()
        if out:
            yield flush()

    parts = shuffle_partitions(spark)
    laid = dealt.select("cluster", "i", "j", "id", "own", "copies", "tokens").repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    return laid.mapInArrow(lean(go), "a long, b long, links long")


def near_classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its class and its links: key, doc_id, class_id (the least doc_id of the class), n_links (documents
    whose sets are at least ``threshold`` alike, copies included), n_shingles, keep (whether the row stays for its class: the
    one with the least doc_id; a repeated row stays if its twin does)."""
    docs = docs.select("doc_id", "text")
    rows, sets = distinct_sets(written(sketches(docs, size), "sketches"))
    label = components(cluster_edges(buckets(sets), sets))
    clusters = written(label.select("id", F.col("label").alias("cluster")).join(sets.select("id", "n", F.col("first.key").alias("key"), "copies"), "id"), "clusters")
    found = written(exact_links(docs, clusters, size, threshold), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    label = components(found.where("b IS NOT NULL").select("a", "b"))
    reps = sets.select("id", "first", "copies").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = reps.groupBy("label").agg(F.min("first").alias("least"))
    known = reps.join(least, "label").join(links, "id", "left").select("id", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = rows.select("key", "doc_id", "id", F.col("n").alias("n_shingles")).join(known, "id", "left")
    return out.select(
        "key",
        "doc_id",
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "n_shingles",
        (F.col("least").isNull() | (F.col("least.key") == F.col("key"))).alias("keep"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all of ``documents``: five-word shingles, similarity 0.8 or more."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
