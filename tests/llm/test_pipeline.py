"""The stages in a row against a plain Python version, on documents whose language is beyond doubt."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def make():
    rng = random.Random(11)
    voc = {"en": ["the", "shore", "whale", "ship", "and", "of", "light"], "fr": ["été", "forêt", "nuit", "garçon", "où", "le", "ça"]}
    say = lambda k, n: " ".join(rng.choice(voc[k]) + str(rng.randrange(1000)) for _ in range(n))
    passage = say("en", 50)
    docs = [(say(k, rng.randrange(20, 90)), k) for k in ("en", "fr") * 8]
    base = say("en", 120).split()
    docs += [(" ".join([*base[:i], "x", *base[i + 1 :]]), "en") for i in (3, 40, 90)]
    docs += [(say("en", 30) + "\n" + passage + "\n" + say("en", 20), "en") for _ in range(3)]
    docs += [(docs[0][0], "en"), ("12 34 !!", None), (None, None), ("", None)]
    return [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(docs)]


def plain(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [SPACE.findall(r[1].lower())] for i in range(len(w) - 4)} for r in rows}
    label = {r[0]: r[0] for r in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    rows = [r for r in rows if label[r[0]] == r[0]]
    seen = {}
    for r in rows:
        w = SPACE.findall(r[1])
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    out = {}
    for r in rows:
        w = SPACE.findall(r[1])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if len(gone) < len(w):
            out[r[0]] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
    return out


def test_stages(spark, tmp_path):
    rows = make()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        assert spark.read.parquet(out).columns == docs.columns
        docs = spark.read.parquet(out)
    want = plain(rows)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["length"] for r in packed} == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_other_columns_come_back(spark, tmp_path):
    """Names that operators use themselves, in any case, beside repeated rows and a null id."""
    extra = {"score": 0.25, "_key": "k", "key": 7, "at": "at", "n_words": -1, "n_removed": -2, "Keep": True, "row": "r", "lang_pred": "xx", "tag": 5, "h": 1, "id": "i"}
    rows = make()
    rows += [rows[3], rows[3], (None, rows[5][1] + " und mehr ça forêt nuit le", "fr", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    wide = docs.select(*docs.columns, *(F.lit(v).alias(k) for k, v in extra.items()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain_rows = sorted(map(tuple, stage(spark, docs, str(tmp_path)).collect()), key=repr)
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns
        out = got.collect()
        assert all(r[k] == v for r in out for k, v in extra.items())
        assert sorted((tuple(r)[:5] for r in out), key=repr) == plain_rows
    upper = docs.withColumn("Score", F.lit(1.5))
    assert {r["Score"] for r in corpus_pipeline.STAGES[0][1](spark, upper, str(tmp_path)).collect()} == {1.5}
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).count() >= len(rows)


def test_language_sends_texts_once(spark, monkeypatch):
    docs = spark.createDataFrame(make(), "doc_id long, Text string, lang string, source string, n_chars long")
    seen, predict = [], corpus_pipeline.langid.predict
    monkeypatch.setattr(corpus_pipeline.langid, "predict", lambda d, m: seen.append(d.schema.simpleString().lower()) or predict(d, m))
    got = corpus_pipeline.language(spark, docs, "")
    assert got.schema == docs.schema and seen[0].count("text:") == 1
    assert {tuple(r) for r in got.collect()} == {r for r in make() if any(c.isalpha() for c in r[1] or "")}
