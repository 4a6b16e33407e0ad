"""A hashed maximum-entropy language model with class-factored soft-max.

log P(token | history) = log P(class | history) + log P(member | class, history) + log P(token | member). Both soft-max have
``WIDE`` outcomes whose logits sum weight rows found by hashing features of the history: for classes the word before, the one
before that and the third before (skips), and the pair of the last two; for members the word before and that pair, each together
with the class. The end token and the most frequent words are classes of their own; all others share classes by their last two
bytes, cut into ranges of equal training mass, so that a word never seen has a class too. Within a class the most frequent words
are members of their own, whose probability is the soft-max alone; the rest is the last member, in which a token has its smoothed
share of the counts and an unseen one the unseen share.

Training is distributed: in each round every task runs mini-batch Adagrad steps from the shared weights over its documents,
and each weight row becomes the mean of the tasks' rows weighted by how often each task met it. The rounds' document sets are
disjoint and cover all training documents. What is gathered (counts of all words, gradients of all tasks) grows with the input;
what is broadcast does not: the weights, 65,536 suffixes, and the ``HEAD`` most frequent tokens. Counts of all other tokens
are joined by a shuffle, exactly, so that the head's size changes where a count comes from and not what it is. The number of
tasks, and so the averaging, follows ``spark.sql.shuffle.partitions``.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token a document, known by a 64-bit hash. Null texts are
empty; null ids are not held out; repeated rows are scored each; an empty table gives no rows; other columns are not read. Memory
grows with the longest text by some 40 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written
from .langid import held_out
from .memory import lean
from .words import Words, worded

#: Classes, members of a class, and classes of one word.
WIDE, SINGLES = 32, 12
REST = WIDE - 1
#: Hashed weight rows of the classes, then their bias; hashed rows of the members, then a bias for each class.
ROWS, ROWS2 = 1 << 14, 1 << 15
BIAS, MEMBER = ROWS, ROWS + 1
BIAS2 = MEMBER + ROWS2
ALL_ROWS = BIAS2 + WIDE
HEAD = 1 << 18
ROUNDS, BATCH, RATE = 2, 8_192, 0.25
BLOCKS = 64
#: Bytes of text whose distinct words are counted together.
SLICE = 2 << 20

END, START = np.uint64(0xE4D0F7EC5A1B3C2D), np.uint64(0x57A27D0F9E3779B1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SHIFT, _SHIFT2 = np.uint64(64 - 14), np.uint64(64 - 15)
#: Logit of a member that no word has.
_NEVER = -20.0


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a slice's texts in a row, the last two bytes of each, and n+1 offsets into them."""
    h = w.hashes()
    n, docs = len(h), len(w.word_off) - 1
    off = w.word_off + np.arange(docs + 1)
    tok = np.full(n + docs, END, np.uint64)
    tail = np.zeros(n + docs, np.int32)
    at = np.arange(n) + np.repeat(np.arange(docs), np.diff(w.word_off))
    tok[at] = h
    if n:
        last = w.data[w.end - 1].astype(np.int32)
        one = w.end - w.start > 1
        tail[at] = last * 256 + np.where(one, w.data[np.maximum(w.end - 2, 0)], 0)
    return tok, tail, off


@dataclass
class History:
    """Weight rows of each token's history, and what the members' rows are hashed from."""

    rows: list[np.ndarray]
    before: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, tok: np.ndarray, off: np.ndarray) -> History:
        first = off[:-1]
        before, p = [], tok
        for _ in range(3):
            p = np.concatenate([[START], p[:-1]])
            p[first] = START
            before.append(p)
        a, b, c = before
        pair = ((a * _C[3]) ^ (b + _C[4])) * _C[0]
        rows = [((x * k) >> _SHIFT).astype(np.uint16) for x, k in ((a, _C[0]), (b, _C[1]), (c, _C[2]))]
        return cls([*rows, (pair >> _SHIFT).astype(np.uint16)], a, pair)

    def members(self, at: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        """Rows for the members of the tokens at these places, which have these classes."""
        salt = (classes.astype(np.uint64) + np.uint64(1)) * _C[4]
        return [(((x[at] ^ salt) * k) >> _SHIFT2).astype(np.uint16) for x, k in ((self.before, _C[1]), (self.pair, _C[2]))]


@dataclass
class Lexicon:
    """What tokens are known by: bounded arrays, the same at every size of corpus."""

    n: int
    distinct: int
    head: np.ndarray  # sorted hashes
    head_count: np.ndarray
    head_class: np.ndarray
    head_member: np.ndarray
    suffix_class: np.ndarray  # of 65,536
    member_mass: np.ndarray  # training tokens of each class and member
    rest_types: np.ndarray  # distinct training tokens of each class's last member

    def __post_init__(self) -> None:
        self._slots = np.full(1 << 21, -1, np.int32)
        self._slots[(self.head >> np.uint64(43)).astype(np.int64)] = np.arange(len(self.head))

    def find(self, tok: np.ndarray) -> np.ndarray:
        """Place of each token in the head, or -1."""
        if not len(self.head):
            return np.full(len(tok), -1, np.int64)
        at = self._slots[(tok >> np.uint64(43)).astype(np.int64)].astype(np.int64)
        lost = np.flatnonzero((at >= 0) & (self.head[at] != tok))
        if len(lost):
            p = np.minimum(np.searchsorted(self.head, tok[lost]), len(self.head) - 1)
            at[lost] = np.where(self.head[p] == tok[lost], p, -1)
        return at

    def class_of(self, at: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each token."""
        if not len(self.head):
            return self.suffix_class[tail].astype(np.int64), np.full(len(tail), REST)
        known = at >= 0
        return np.where(known, self.head_class[at], self.suffix_class[tail]).astype(np.int64), np.where(known, self.head_member[at], REST).astype(np.int64)

    @property
    def log_base(self) -> float:
        return math.log10(self.n + 0.5 * (self.distinct + 1))

    @property
    def log_rest(self) -> np.ndarray:
        """log10 of the denominators of P(token | last member) by class."""
        return np.log10(self.member_mass[:, REST] + 0.5 * (self.rest_types + 1))

    def start(self) -> np.ndarray:
        """Weights before training: the logs of the shares."""
        w = np.zeros((ALL_ROWS, WIDE), np.float32)
        w[BIAS] = np.log(self.member_mass.sum(axis=1) + 0.5)
        w[BIAS] -= w[BIAS].max()
        member = np.log(self.member_mass + 0.5)
        member -= member.max(axis=1, keepdims=True)
        member[:, :REST][self.member_mass[:, :REST] == 0] = _NEVER
        w[BIAS2:] = member
        return w


def counts(docs: DataFrame) -> DataFrame:
    """h, tail, n of every training token; ``docs`` has text alone."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in worded(b.column(0), lower=True, most=SLICE):
                tok, tail, _ = tokens_of(w)
                h, first, n = np.unique(tok, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail[first]), pa.array(n.astype(np.int64))], ["h", "tail", "n"])

    return docs.mapInArrow(lean(go), "h long, tail int, n long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def lexicon(seen: DataFrame, head: int = HEAD) -> Lexicon:
    """From the written counts: totals, the most frequent tokens (all whose count reaches a level that at most ``head``
    tokens reach), and classes."""
    level = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r["l"], r["k"]) for r in seen.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 1,024 at most
    total, cut = 0, None
    for at, k in steps:
        if total + k > head:
            break
        total, cut = total + k, at
    top = seen.where(level >= cut).toArrow() if cut is not None else seen.limit(0).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, n, tail = h[order], top.column("n").to_numpy()[order], top.column("tail").to_numpy()[order]
    mass2, types2 = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for r in seen.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # 65,536 at most
        mass2[r["tail"]], types2[r["tail"]] = r["n"], r["k"]
    distinct, everything = int(types2.sum()), int(mass2.sum())
    # the end token and the most frequent others have classes of their own
    often = np.lexsort((h, -n))
    singles = [*np.flatnonzero(h == END).tolist(), *(int(i) for i in often[:SINGLES] if h[i] != END)][:SINGLES]
    for i in singles:
        mass2[tail[i]] -= n[i]
        types2[tail[i]] -= 1
    # suffixes in order of the last byte, cut into ranges of equal mass
    run = np.cumsum(mass2 + 1e-9)
    suffix = SINGLES + np.minimum((run - mass2 / 2) / run[-1] * (WIDE - SINGLES), WIDE - SINGLES - 1).astype(np.int64)
    cls = suffix[tail] if len(tail) else np.zeros(0, np.int64)
    member = np.full(len(tail), REST)
    mass, types = np.zeros((WIDE, WIDE)), np.bincount(suffix, types2, WIDE)
    mass[:, REST] = np.bincount(suffix, mass2, WIDE)
    for k, i in enumerate(singles):
        cls[i] = k
        mass[k, REST], types[k] = n[i], 1
    taken = np.zeros(WIDE, np.int64)
    taken[:SINGLES] = REST
    for i in often.tolist():  # the most frequent of each class, until all classes are full
        c = cls[i]
        if taken[c] < REST:
            member[i] = taken[c]
            mass[c, taken[c]] = n[i]
            mass[c, REST] -= n[i]
            types[c] -= 1
            taken[c] += 1
            if (taken == REST).all():
                break
    return Lexicon(everything, distinct, h, n, cls.astype(np.int16), member.astype(np.int16), suffix.astype(np.int16), mass, types)


def _logits(w: np.ndarray, base: int, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Sums of weight rows, less the greatest of each token."""
    part = w[base : base + (ROWS if base == 0 else ROWS2)]
    z = np.take(part, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(part, r, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the share of each row's outcome ``at``."""
    own = z[np.arange(len(z)), at]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def _miss(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gradient: shares less one for each row's outcome."""
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), at] -= 1
    return z


#: Rows met so often in a batch are summed one by one; the others all at once, occurrence by occurrence.
_OFTEN = 6


def sums_by(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, how often each occurs, and the sum of its rows of g."""
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    n = np.diff(np.append(first, len(ids)))
    out = np.take(g, order[first], axis=0)
    for k in range(1, _OFTEN):
        at = np.flatnonzero((n > k) & (n <= _OFTEN))
        if not len(at):
            break
        out[at] += np.take(g, order[first[at] + k], axis=0)
    for at in np.flatnonzero(n > _OFTEN).tolist():
        out[at] = np.take(g, order[first[at] : first[at] + n[at]], axis=0).sum(axis=0)
    return sorted_ids[first], n, out


class Steps:
    """One task's Adagrad steps from the shared weights."""

    def __init__(self, weights: np.ndarray) -> None:
        self.w = weights.copy()
        self.square = np.full(len(weights), 1e-2, np.float32)
        self.met = np.zeros(len(weights), np.int64)

    def _step(self, base: int, ids: np.ndarray, g: np.ndarray) -> None:
        at, n, step = sums_by(ids, g)
        at = at.astype(np.int64) + base
        # steps are means times the root of their count
        self.square[at] += np.einsum("ij,ij->i", step, step) / (n * step.shape[1])
        step *= (RATE / np.sqrt(self.square[at] * n)).astype(np.float32)[:, None]
        self.w[at] -= step
        self.met[at] += n

    def batch(self, hist: History, cls: np.ndarray, member: np.ndarray, s: slice) -> None:
        rows = [r[s] for r in hist.rows]
        g = _miss(_logits(self.w, 0, rows, self.w[BIAS]), cls[s])
        inner = np.flatnonzero(cls[s] >= SINGLES)
        if len(inner):
            c = cls[s][inner]
            rows2 = hist.members(inner + s.start, c)
            g2 = _miss(_logits(self.w, MEMBER, rows2, self.w[BIAS2 + c]), member[s][inner])
        for r in rows:
            self._step(0, r, g)
        self._step(BIAS, np.zeros(len(g), np.uint16), g)
        if len(inner):
            for r in rows2:
                self._step(MEMBER, r, g2)
            self._step(BIAS2, c.astype(np.uint16), g2)


def train_round(docs: DataFrame, lex, weights: np.ndarray) -> np.ndarray:
    """One round over ``docs`` (text alone): each task's steps from the same weights, then the weighted mean of their rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # ALL_ROWS x WIDE
    per = -(-ALL_ROWS // BLOCKS)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx: Lexicon = lex.value
        steps = Steps(shared.value)
        for b in batches:
            for _, _, words in worded(b.column(0), lower=True, most=SLICE):
                tok, tail, off = tokens_of(words)
                hist = History.of(tok, off)
                cls, member = lx.class_of(lx.find(tok), tail)
                for i in range(0, len(tok), BATCH):
                    steps.batch(hist, cls, member, slice(i, min(i + BATCH, len(tok))))
        w, met = steps.w, steps.met
        if met.any():
            for k in range(BLOCKS):
                a, e = k * per, min((k + 1) * per, ALL_ROWS)
                if a < e:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w[a:e].astype(np.float32).tobytes()], pa.binary()), pa.array([met[a:e].tobytes()], pa.binary())], ["block", "w", "met"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for k, w, met in zip(*(b.column(i).to_pylist() for i in range(3))):
                n = np.frombuffer(met, np.int64).astype(np.float64)
                v = np.frombuffer(w, np.float32).reshape(-1, WIDE) * n[:, None]
                if k in total:
                    total[k][0] += v
                    total[k][1] += n
                else:
                    total[k] = [v, n]
        for k, (v, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.divide(v, np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())], ["block", "w", "met"])

    schema = "block int, w binary, met binary"
    parts = min(BLOCKS, shuffle_partitions(spark))
    got = docs.coalesce(max(1, shuffle_partitions(spark))).mapInArrow(lean(go), schema).repartition(parts, "block").mapInArrow(lean(mean), schema).collect()  # one row for each block
    out = weights.copy()
    for r in got:
        a = r["block"] * per
        n = np.frombuffer(bytes(r["met"]), np.int64)
        v = np.frombuffer(bytes(r["w"]), np.float32).reshape(-1, WIDE)
        out[a : a + len(n)][n > 0] = v[n > 0]
    return out


def score_parts(docs: DataFrame, lex, weights: np.ndarray) -> DataFrame:
    """For each document what its frequent tokens give, and its other tokens (hash and count) for the join with all counts."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "uid long, doc_id long, n_tokens long, n_head long, base_part double, score_part double, tail array<long>, tail_n array<long>"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx: Lexicon = lex.value
        w = shared.value
        head_log = np.log10(lx.head_count + 0.5)
        log_base, log_rest = lx.log_base, lx.log_rest
        for b in batches:
            for i, j, words in worded(b.column(2), lower=True, most=SLICE):
                tok, tail, off = tokens_of(words)
                hist = History.of(tok, off)
                at = lx.find(tok)
                cls, member = lx.class_of(at, tail)
                known = at >= 0
                own = np.where(known, head_log[at] if len(head_log) else 0.0, 0.0)
                picked = np.empty(len(tok))
                for k in range(0, len(tok), BATCH):
                    s = slice(k, min(k + BATCH, len(tok)))
                    picked[s] = _log_softmax(_logits(w, 0, [r[s] for r in hist.rows], w[BIAS]), cls[s])
                    inner = np.flatnonzero(cls[s] >= SINGLES) + k
                    if len(inner):
                        c = cls[inner]
                        picked[inner] += _log_softmax(_logits(w, MEMBER, hist.members(inner, c), w[BIAS2 + c]), member[inner])
                picked /= math.log(10)
                inside = np.where((cls >= SINGLES) & (member == REST), own - log_rest[cls], 0.0)
                n = np.diff(off)
                sums = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every document has its end token
                doc = np.repeat(np.arange(j - i), n)[~known]
                rare = tok[~known]
                order = np.lexsort((rare, doc))
                doc, rare = doc[order], rare[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])]) if len(doc) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(doc)))
                cuts = np.searchsorted(doc[first], np.arange(j - i + 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        b.column(1).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(sums(known.astype(np.int64)), pa.int64()),
                        pa.array(sums(own - log_base), pa.float64()),
                        pa.array(sums(picked + inside), pa.float64()),
                        lists(rare[first].view(np.int64)),
                        lists(many.astype(np.int64)),
                    ],
                    ["uid", "doc_id", "n_tokens", "n_head", "base_part", "score_part", "tail", "tail_n"],
                )

    return docs.mapInArrow(lean(go), schema)


def train_and_score(docs: DataFrame, held: Column, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the rows of (doc_id, text) for which ``held`` is false and scores all: doc_id, n_tokens, n_known,
    train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = docs.where(~held)
    seen = written(counts(learn.select("text")), "lm-counts")
    lx = lexicon(seen)
    lex = spark.sparkContext.broadcast(lx)
    weights = lx.start()
    for k in range(rounds):
        weights = train_round(learn.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k).select("text"), lex, weights)
    parts = written(score_parts(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), lex, weights), "lm-scores")
    rare = parts.select("uid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("uid", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("k"))
    level = seen.select("h", "n")
    extra = (
        rare.join(level, "h", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.drop("tail", "tail_n").join(extra, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + zero("more")).cast("long").alias("n_known"),
        F.lit(lx.n).cast("long").alias("train_tokens"),
        (F.col("base_part") + zero("logs")).alias("base_score"),
        (F.col("score_part") + zero("logs")).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four fifths of ``documents`` and scores all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = train_and_score(docs, held_out(F.col("doc_id"), 5, 1))
    return got.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
