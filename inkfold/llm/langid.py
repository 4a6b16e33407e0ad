"""Language identification by error-correcting output codes.

Each learned language has a codeword; for each bit of the words one binary logistic classifier over hashed character
n-grams tells the languages whose bit is set from the others. A text gets the language whose codeword loses least against
the classifiers' margins, each bit weighted by how well its classifier separates the training sample; the score is the
soft-max share of that language, and a lead of less than ``AMBIGUOUS`` over the next codeword flags the text.

The classifiers are fitted on the driver to a bounded sample (``SAMPLE_DOCS`` whole documents over all languages, evenly, the
lowest hashes of doc_id); counts for that sample and every prediction cover whole texts. Rows without text, language or
doc_id teach nothing; null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, so is
every text. Ties go to the language that sorts first. Repeated rows are predicted each; an empty table gives no rows; other columns
pass through, but those with the names of the operator's own. A long text's n-grams are counted ``STRETCH`` characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .memory import lean

SAMPLE_DOCS = 2_000
DIM, ORDERS = 8_192, (1, 2, 3)
AMBIGUOUS = 0.1
UND = "und"
#: Languages whose counts are broadcast.
FEW_LANGS = 10_000
#: Characters of a long text that are worked on at a time.
STRETCH = 1 << 18
_ROUNDS, _RIDGE = 120, 1e-4

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x20000)), bool, 0x20000)
    return _letters


def grams(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Shares of hashed letter n-grams (square roots, so rows have length one) and whether a text has a letter."""
    out = np.zeros((len(texts), dim))
    low = [(t or "").lower() for t in texts]
    short = [i for i, t in enumerate(low) if len(t) <= STRETCH]
    if short:
        size = np.array([len(low[i]) + 1 for i in short])
        code = np.frombuffer(" ".join([*(low[i] for i in short), ""]).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(short)), size)
        code, keep = _letters_of(code, np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[short] = _counted(code[keep], doc[keep], len(short), dim)
    for i in set(range(len(low))) - set(short):
        text, tail, after = low[i] + " ", np.zeros(0, np.uint64), False
        for a in range(0, len(text), STRETCH):
            code, keep = _letters_of(np.frombuffer(text[a : a + STRETCH].encode("utf-32-le"), np.uint32), None, after)
            after = bool(code[-1] != 32)
            # the last two come again, so that no n-gram is lost, and what they make alone is taken off
            stream = np.concatenate([tail, code[keep]])
            out[i] += _counted(stream, np.zeros(len(stream), np.int64), 1, dim)[0] - _counted(tail, np.zeros(len(tail), np.int64), 1, dim)[0]
            tail = stream[-2:]
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32), total[:, 0] > 0


def _letters_of(code: np.ndarray, first: np.ndarray | None, after: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Characters with all but letters as spaces, and which to keep: letters, and one space after a run of them. ``first`` marks the
    beginnings of texts; ``after`` tells whether a letter went before."""
    letter = _letter_table()[np.minimum(code, 0x1FFFF)]
    before = np.concatenate([[after], letter[:-1]])
    if first is not None:
        before &= ~first
    return np.where(letter, code, 32).astype(np.uint64), letter | before


def _counted(code: np.ndarray, doc: np.ndarray, docs: int, dim: int) -> np.ndarray:
    """Counts of hashed n-grams of each text."""
    out = np.zeros(docs * dim)
    for n in ORDERS:
        if len(code) < n:
            break
        h = code[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[i : len(code) - n + 1 + i] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        at = (h >> np.uint64(40)).astype(np.int64) % dim
        whole = doc[: len(at)] == doc[n - 1 :]
        out += np.bincount((doc[: len(at)] * dim + at)[whole], minlength=len(out))
    return out.reshape(docs, dim)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of signs: all two-sided splits for few languages, else random ones far apart."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        bits = np.arange(1, 2 ** (k - 1))
        return np.array([[1 if (b >> i) & 1 else -1 for b in bits] for i in range(k - 1)] + [[-1] * len(bits)])[::-1].copy()
    rng = np.random.default_rng(seed)
    n, best, far = int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(50):
        m = rng.integers(0, 2, (k, n)) * 2 - 1
        split = (np.abs(m.sum(axis=0)) < k).all()
        near = (n - (m @ m.T)[np.triu_indices(k, 1)]).min() / 2
        if split and near > far:
            best, far = m, near
    return best


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    dim: int = field(default=DIM)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share, and whether it leads by too little."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.words[None, :, :]) @ self.trust
        best = loss.argmin(axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(loss, axis=1)
        close = top[:, 1] - top[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return best, p[np.arange(len(x)), best], close


def fit_sample(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Model:
    """Logistic classifiers for all bits at once by accelerated full-batch gradient steps."""
    words = codewords(len(langs)).astype(np.float64)
    t = words[y]
    share = 1 / np.bincount(y, minlength=len(langs))[y]
    share = (share / share.sum())[:, None]
    w, b = np.zeros((x.shape[1], words.shape[1])), np.zeros(words.shape[1])
    vw, vb = w.copy(), b.copy()
    x64 = x.astype(np.float32)
    rate = 4.0
    for i in range(_ROUNDS):
        mo = i / (i + 3)
        lw, lb = w + mo * vw, b + mo * vb
        g = (-t / (1 + np.exp(t * (x64 @ lw.astype(np.float32) + lb)))) * share
        nw, nb = lw - rate * ((x64.T @ g.astype(np.float32)) + _RIDGE * lw), lb - rate * g.sum(axis=0)
        vw, vb, w, b = nw - w, nb - b, nw, nb
    # how sure each bit is of the sample, by its mean logistic loss
    mean = (np.logaddexp(0, -t * (x64 @ w.astype(np.float32) + b)) * share).sum(axis=0)
    trust = 1 / (0.05 + mean)
    return Model(langs, words, w.astype(np.float32), b.astype(np.float32), trust / trust.sum() * words.shape[1])


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit(docs: DataFrame, teach: Column, dim: int = DIM, most: int = SAMPLE_DOCS) -> Model | None:
    """Learns from the rows for which ``teach`` holds; None if there are none."""
    rows = docs.where(teach & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    if not langs:
        return None
    each = max(1, most // langs)
    # so few languages are broadcast; with more of them the texts are shuffled to their language's count
    rough = rows.join(F.broadcast(counts) if langs <= FEW_LANGS else counts, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(1.3 * each) / F.col("n")) * (1 << 20))
    w = Window.partitionBy("lang").orderBy("h", "text")  # some 1.3 * most rows in all
    sample = rough.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each).select("lang", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 32):
                c = b.slice(i, 32)
                x, some = grams(c.column(1).to_pylist(), dim)
                at = [np.flatnonzero(r).astype(np.int32) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array(some.tolist(), pa.bool_()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at)], pa.binary())],
                    ["lang", "some", "at", "x"],
                )

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in sample.mapInArrow(lean(go), "lang string, some boolean, at binary, x binary").collect() if r["some"])
    if not got:
        return None
    langs = sorted({g[0] for g in got})
    x = np.zeros((len(got), dim), np.float32)
    for i, (_, at, v) in enumerate(got):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    index = {k: i for i, k in enumerate(langs)}
    return fit_sample(x, np.array([index[g[0]] for g in got]), langs)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and ambiguous; reads text and nothing else of a row. A column of ``docs`` with one
    of these names, in any case, makes way."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")])
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dim times bits numbers

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for b in batches:
            pred, score, close = [], [], []
            col = b.column(at)
            for i in range(0, b.num_rows, 32):
                texts = col.slice(i, 32).to_pylist()
                if m is None:
                    pred += [UND] * len(texts)
                    score += [0.0] * len(texts)
                    close += [False] * len(texts)
                    continue
                x, some = grams(texts, m.dim)
                best, p, c = m.decode(x)
                pred += [m.langs[k] if s else UND for k, s in zip(best.tolist(), some.tolist())]
                score += np.where(some, p, 0.0).tolist()
                close += (c & some).tolist()
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields])
    return docs.mapInArrow(lean(go), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents outside the held-out quarter and predicts every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, ~out)
    got = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return got.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
