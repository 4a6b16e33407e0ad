"""Exact top-k inner-product search with one KD-tree for each shard.

Vectors are integers here, so scores are exact. Space is cut into at most ``CELLS`` cells by median splits of the widest dimension
over a bounded pilot set; every row goes to its cell, and a cell's rows are dealt over shards of ``SHARD_ROWS`` or so. Each shard's
tree is built once and stored: it splits at the median of the widest dimension until leaves are small, and every node keeps the
tight box of its points. A query walks a tree best-first: a node's bound is the largest inner product that any point of its box
could reach, and a node is opened only while its bound is not below the query's kth best score so far.

That kth score is propagated: a query begins with the one it reaches over the pilot, is then searched in the cell of the greatest
bound, and goes with the score it has there to those of the other cells alone whose box reaches it. Pruning is strict, so rows
that tie with the kth score are all seen and the smaller id wins. Where the vectors have no structure few boxes can be left out,
and the work grows with queries times rows; no method is exact and does less there.

Queries of a shard come in blocks of ``BLOCK_ROWS``, each a task with one stored tree, so that memory does not grow with either
side. Vectors that are null, empty or hold null or non-finite components take no part; rows of different dimension never meet. Ids
are what is searched: a candidate with several rows counts once, by the best score that any of its rows reaches with any row of the
query's id; a repeated row changes nothing. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, PILOT_ROWS, CELLS = 8_192, 4_096, 128, 2_048, 64


class Tree:
    """A KD-tree over integer rows; nodes are ranges of a permutation."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(rows))
        lo, hi, child, span = [], [], [], []

        def build(a: int, b: int) -> int:
            part = rows[self.order[a:b]]
            me = len(lo)
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            span.append((a, b))
            child.append((-1, -1))
            wide = int((hi[me] - lo[me]).argmax())
            if b - a > leaf and hi[me][wide] > lo[me][wide]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, wide], mid, kind="introselect")]
                child[me] = (build(a, a + mid), build(a + mid, b))
            return me

        build(0, len(rows))
        self.rows = rows[self.order]
        self.lo, self.hi, self.child, self.span = np.array(lo), np.array(hi), child, span

    def bounds(self, q: np.ndarray, nodes: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.maximum(self.lo[nodes] * q, self.hi[nodes] * q).sum(axis=1)

    def search(self, q: np.ndarray, ids: np.ndarray, own: int | None, k: int, floor: int | None, alone: bool = False) -> list[tuple[int, int]]:
        """The k best (score, -id), best first, of those not below ``floor``, each id once; ``own`` is left out. ``alone``: whether
        no id has two rows."""
        best: list[tuple[int, int]] = []
        held: dict[int, int] = {}
        bar = floor
        queue = [(-int(self.bounds(q, slice(0, 1))[0]), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if bar is not None and -bound < bar:
                break
            left, right = self.child[node]
            if left >= 0:
                pair = np.array([left, right])
                for n, s in zip((left, right), self.bounds(q, pair).tolist()):
                    if bar is None or s >= bar:
                        heapq.heappush(queue, (-s, n))
                continue
            a, b = self.span[node]
            score = self.rows[a:b] @ q
            at = np.flatnonzero(score >= bar) if bar is not None else np.arange(b - a)
            if own is not None:
                at = at[ids[self.order[a:b][at]] != own]
            if alone and len(at) > 4 * k:  # all that reach the kth best of these
                keep = np.partition(score[at], len(at) - k)[len(at) - k]
                at = at[score[at] >= keep]
            for s, i in zip(score[at].tolist(), ids[self.order[a:b][at]].tolist()):
                if i in held:
                    if s > held[i]:
                        best[best.index((held[i], -i))] = (s, -i)
                        heapq.heapify(best)
                        held[i] = s
                elif len(best) < k:
                    heapq.heappush(best, (s, -i))
                    held[i] = s
                elif (s, -i) > best[0]:
                    del held[-heapq.heapreplace(best, (s, -i))[1]]
                    held[i] = s
            if len(best) == k and (bar is None or best[0][0] > bar):
                bar = best[0][0]
        return sorted(best, reverse=True)


def _matrix(col: pd.Series) -> np.ndarray:
    """Rows as float64 where products stay exact in it, else as integers."""
    m = np.array(col.tolist(), np.int64)
    big = int(np.abs(m).max()) if m.size else 0
    return m.astype(np.float64) if big * big * m.shape[1] < 2**52 else m


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sides of a product in the kind that is exact for both."""
    if a.dtype == np.float64 and b.dtype == np.float64:
        return a, b
    return a.astype(np.int64), b.astype(np.int64)


class Cells:
    """Median splits of one dimension's pilot rows, and the pilot itself."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, cells: int) -> None:
        self.ids, first = np.unique(ids, return_index=True)
        self.rows = rows[first]  # one row of an id: its score is a floor of the id's
        self.cuts: dict[int, tuple[int, float]] = {}  # node to dimension and value; children 2n and 2n + 1
        self.levels = max(0, int(np.ceil(np.log2(max(1, cells)))))

        def split(node: int, part: np.ndarray, left: int) -> None:
            if not left or len(part) < 2:
                return
            wide = int((part.max(axis=0) - part.min(axis=0)).argmax())
            mid = float(np.median(part[:, wide]))
            self.cuts[node] = wide, mid
            low = part[:, wide] <= mid
            split(2 * node, part[low], left - 1)
            split(2 * node + 1, part[~low], left - 1)

        split(1, rows, self.levels)

    def cell(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.ones(len(rows), np.int64)
        for _ in range(self.levels):
            for n in np.unique(node).tolist():
                if n in self.cuts:
                    wide, mid = self.cuts[n]
                    at = node == n
                    node[at] = 2 * n + (rows[at, wide] > mid)
        return node

    def floor(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray | None:
        """The kth score of each query over the pilot without its own id; None if the pilot is too small."""
        if len(self.ids) <= k:
            return None
        q, p = _both(queries, self.rows)
        s = np.where(own[:, None] == self.ids[None, :], np.iinfo(np.int64).min, (q @ p.T).astype(np.int64))
        return np.sort(s, axis=1)[:, -k]


def _best(rows: list[tuple[int, int, int]], k: int) -> pd.DataFrame:
    """Of (query, id, score) the k best of each query, each id once."""
    d = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    d = d.groupby(["query_id", "vec_id"], as_index=False)["score"].max().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return d.groupby("query_id").head(k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, most_cells: int = CELLS) -> DataFrame:
    """For each query id (id, v) its k best candidates (id, v) with another id: query_id, rank, vec_id, score.
    ``v`` is an array of longs without nulls."""
    spark = candidates.sparkSession
    n = candidates.count()
    pilot = candidates.orderBy(F.xxhash64("id"), "id", "v").limit(PILOT_ROWS).collect()
    by_dim: dict[int, tuple[list, list]] = {}
    for r in pilot:
        ids, rows = by_dim.setdefault(len(r["v"]), ([], []))
        ids.append(r["id"])
        rows.append(r["v"])
    cells = min(most_cells, -(-n // shard_rows))
    none = Cells(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), 1)
    shared = spark.sparkContext.broadcast({d: Cells(np.array(i), np.array(v, np.int64), cells) for d, (i, v) in by_dim.items()})  # PILOT_ROWS rows

    def routed(batches):
        for b in batches:
            dims = b["v"].map(len)
            cell = np.ones(len(b), np.int64)
            for d in dims.unique():
                at = np.flatnonzero(dims == d)
                cell[at] = shared.value.get(d, none).cell(np.array(b["v"].iloc[at].tolist(), np.int64))
            yield b.assign(dim=dims.astype("int32"), cell=cell)

    rows = written(candidates.select("id", "v").mapInPandas(routed, "id long, v array<long>, dim int, cell long"), "routed")
    # a cell that many like rows share has many shards: cells x dimensions rows at most
    shards = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shards = written(shards, "shards")
    dealt = rows.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(key: tuple, c: pd.DataFrame) -> pd.DataFrame:
        m, ids = _matrix(c["v"]), c["id"].to_numpy(np.int64)
        tree = Tree(m)
        out = {"dim": key[0], "cell": key[1], "shard": key[2], "lo": [m.min(axis=0).astype(np.int64).tolist()], "hi": [m.max(axis=0).astype(np.int64).tolist()]}
        return pd.DataFrame(out | {"tree": [pickle.dumps((tree, ids, len(np.unique(ids)) == len(ids)))]})

    trees = written(dealt.groupBy("dim", "cell", "shard").applyInPandas(build, "dim int, cell long, shard int, lo array<long>, hi array<long>, tree binary"), "trees")

    def hull(key: tuple, c: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.array(c["lo"].tolist()).min(axis=0), np.array(c["hi"].tolist()).max(axis=0)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "shards": [len(c)], "lo": [lo.tolist()], "hi": [hi.tolist()]})

    boxes = trees.select("dim", "cell", "lo", "hi").groupBy("dim", "cell").applyInPandas(hull, "dim int, cell long, shards int, lo array<long>, hi array<long>")
    hulls: dict[int, list] = {}
    for r in boxes.collect():  # cells x dimensions rows at most
        hulls.setdefault(r["dim"], []).append((r["cell"], r["shards"], r["lo"], r["hi"]))
    space = spark.sparkContext.broadcast({d: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v]), np.array([x[3] for x in v])) for d, v in hulls.items()})

    def sent(first: bool):
        """Queries (id, v, floor) to the shards of the cell of the greatest bound, or of the other cells that reach the floor."""

        def go(batches):
            lowest = np.iinfo(np.int64).min
            for b in batches:
                out = []
                dims = b["v"].map(len)
                for d in dims.unique():
                    if d not in space.value:
                        continue
                    names, shards, lo, hi = space.value[d]
                    at = np.flatnonzero(dims == d)
                    q, own = np.array(b["v"].iloc[at].tolist(), np.int64), b["id"].to_numpy()[at]
                    floor = shared.value[d].floor(q, own, k) if first and d in shared.value else None
                    floors = b["floor"].to_numpy(np.int64)[at] if not first else floor if floor is not None else np.full(len(at), lowest)
                    for j, (v, i, f) in enumerate(zip(q, own.tolist(), floors.tolist())):
                        bound = np.maximum(lo * v, hi * v).sum(axis=1)
                        top = int(bound.argmax())
                        go_to = [top] if first else [c for c in np.flatnonzero(bound >= f).tolist() if c != top]
                        out += [(int(d), int(names[c]), s, i, b["v"].iloc[at[j]], f) for c in go_to for s in range(int(shards[c]))]
                yield pd.DataFrame(out, columns=["dim", "cell", "shard", "id", "v", "floor"])

        return go

    def search(key: tuple, t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(t) and len(q):
            tree, ids, alone = pickle.loads(t["tree"].iloc[0])
            tree.rows, qm = _both(tree.rows, _matrix(q["v"]))
            lowest = np.iinfo(np.int64).min
            for own, v, f in zip(q["id"].tolist(), qm, q["floor"].tolist()):
                out += [(own, -i, int(s)) for s, i in tree.search(v, ids, own, k, None if f == lowest else f, alone)]
        return _best(out, k)

    where = "dim int, cell long, shard int, id long, v array<long>, floor long"
    keys = ["dim", "cell", "shard", "block"]

    def found(asked: DataFrame, name: str) -> DataFrame:
        asked = written(asked, name)
        blocks = asked.groupBy("dim", "cell", "shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        q = asked.join(blocks, ["dim", "cell", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        t = trees.select("dim", "cell", "shard", "tree").join(blocks, ["dim", "cell", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return t.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")

    def best(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # the best of each partition alone are shuffled

    asked = queries.select("id", "v").distinct()
    near = written(found(asked.mapInPandas(sent(True), where), "first"), "near")
    kth = near.groupBy("query_id").agg(F.count_distinct("vec_id").alias("many"))
    low = best(near).groupBy("query_id").agg(F.min("score").alias("kth")).join(kth, "query_id").where(F.col("many") >= k).select(F.col("query_id").alias("id"), "kth")
    rest = asked.join(low, "id", "left").select("id", "v", F.coalesce("kth", F.lit(-(2**63)).cast("long")).alias("floor"))
    far = found(rest.mapInPandas(sent(False), where), "rest")
    return best(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")


def quantized(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector is null, empty or holds a null or non-finite one."""
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products for every fiftieth vector of ``embeddings`` against all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return top_k(rows, rows.where(F.col("id") % 50 == 0), 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         max(CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  GROUP BY 1, 2
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
