"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkfold.llm.words import Words, mix, runs
from inkfold.llm import chosen_path, components, langid, licenses, maxent_lm, packing, sentencepieces, simhash, substrings, token_store, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score int, at string, shard string, id string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    voc = {"en": ["the", "of", "and", "whale", "shore", "light,", "ing", "ship"], "fr": ["le", "été", "où", "garçon", "forêt", "ça", "eaux", "nuit"]}
    say = lambda k, n: " ".join(rng.choice(voc[k]) + (str(rng.randrange(60)) if rng.random() < 0.4 else "") for _ in range(n))
    shared = say("en", 60)
    out = [(say(k, rng.randrange(3, 200)), k) for k in ("en", "fr") * 12]
    base = say("en", 150).split()
    for i in range(12):  # near copies
        w = list(base)
        w[i * 7] = f"changed{i}"
        out.append((" ".join(w), "en"))
    out += [(say("fr", 40) + "\n" + shared + "\n" + say("fr", 30), "fr") for _ in range(4)]
    out += [("Is on. " * 60, "en"), ("a b", "en"), ("", "en"), (None, None), ("?!", "fr"), ("  odd \t white space ", None), ("x" * 5000 + " " + say("en", 9000), "en")]
    out += [("This work.\nReleased under the MIT Licence.", "en"), ("MIT License\n\nCopyright (c) 2020 A\n\n" + licenses.TEXTS[0][1].replace("sublicense", "sublicence"), "en")]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(3 * i, x, k, "s", len(x or ""), "k", 1, "a", "b", "c") for i, (x, k) in enumerate(t)]
    out += [out[0], out[0]]  # a row thrice
    out.append((901, *out[25][1:]))  # a copy under another id
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    t = t or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return SPACE.findall(t)


def test_token_store(spark, docs, rows, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    token_store.write(docs, str(tmp_path / "a"), path, 2, parts=3)
    got = sorted(tuple(r)[:4] + (bytes(r["ids"]),) for r in token_store.read(spark, str(tmp_path / "a")).collect())
    got.sort(key=lambda r: r[1])
    want = [np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in sorted(rows, key=lambda r: r[0])]
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert [r[4] for r in got] == [x.tobytes() for x in want]
    assert [r[1] for r in got] == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]
    assert [r[3] for r in got] == [zlib.crc32(x) for x in want]
    assert [len(x) for x in token_store.lookup(spark, str(tmp_path / "a"), 0)] == [len(want[0])] * 3
    token_store.write(none, str(tmp_path / "b"), path, 2)
    assert token_store.read(spark, str(tmp_path / "b")).count() == 0
    null = spark.createDataFrame([(None, "a b"), (None, None), (4, "c")], "doc_id long, text string")
    token_store.write(null, str(tmp_path / "c"), path, 2)
    assert token_store.read(spark, str(tmp_path / "c"), False).count() == 3


def test_sentencepiece(spark, docs, rows, none):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sentencepieces.encode(docs, path).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert sentencepieces.encode(none, path).count() == 0
    lib, own = SentencePieceProcessor(model_file=path), sentencepieces.Encoder(sentencepieces.Model(open(path, "rb").read()))
    hard = [t for t, _ in texts() if t] + ["日本 語 😀", "  two  spaces ", "\n\na\nb", "ß—é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\u2581x y"]
    for t, ids in zip(hard, own.batch(hard)):
        assert ids.tolist() == lib.encode(t), t
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1  # the library's Viterbi search; its floats hold scores up to 2**24 exactly
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -40_000
    proto = m.SerializeToString()
    lib, own = SentencePieceProcessor(model_proto=proto), sentencepieces.Encoder(sentencepieces.Model(proto))
    sample = [t for t, _ in texts() if t and len(t) < 900] + ["日本 語 😀", "  two  spaces ", "\n\na\nb", "ß—é"]
    for t, ids in zip(sample, own.batch(sample)):
        assert ids.tolist() == lib.encode(t), t
        assert sentencepieces.decode(own.model, ids.tolist()) == t


def test_language(spark, docs, rows, none):
    out = langid.held_out(F.col("doc_id"), 4, 2)
    got = langid.predict(docs, langid.fit(docs, ~out)).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if letters and r["lang"] and len(words(r["text"])) > 5:
            assert r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    for k in (1, 2, 3, 7, 40):
        assert len(np.unique(langid.codewords(k), axis=0)) == k


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_language_decoding(k):
    """Loss-weighted decoding against a plain sum over the bits of each codeword."""
    rng = np.random.default_rng(k)
    words_ = langid.codewords(k).astype(float)
    assert len({tuple(w) for w in words_}) == k and (k < 2 or all(set(c) == {-1.0, 1.0} for c in words_.T))
    bits = words_.shape[1]
    m = langid.Model([f"l{i}" for i in range(k)], words_, rng.normal(size=(12, bits)), rng.normal(size=bits), rng.random(bits) + 0.1)
    x = rng.normal(size=(50, 12))
    best, share, close = m.decode(x)
    for i in range(50):
        margin = [sum(x[i][j] * m.weights[j][b] for j in range(12)) + m.bias[b] for b in range(bits)]
        loss = [sum(m.trust[b] * np.log1p(np.exp(-margin[b] * w[b])) for b in range(bits)) for w in words_]
        assert best[i] == min(range(k), key=lambda c: loss[c])
        assert share[i] == pytest.approx(1 / sum(np.exp(min(loss) - v) for v in loss))
        assert close[i] == (k > 1 and sorted(loss)[1] - min(loss) < langid.AMBIGUOUS)


def test_simhash(spark, docs, rows, none):
    got = simhash.edited_prints(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in rows))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 for r in got)
    assert simhash.edited_prints(none).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert [r["near_next"] for r in simhash.edited_prints(one).collect()] == [1.0]
    assert simhash.edited_prints(spark.createDataFrame([(None, "a"), (None, "b"), (2, None)], "doc_id long, text string")).count() == 3


def plain_print(text):
    """A fingerprint term by term."""
    w = words(text, True)
    votes = [0] * 128
    hash_of = lambda t: int(Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).hashes()[0])
    h = np.array([hash_of(x) for x in w], np.uint64)
    for k in (1, 2, 3):
        for i in range(len(w) - k + 1):
            term = h[i : i + 1] if k == 1 else runs(h[i : i + k], np.array([0, k]), k)[0]
            for lane, v in enumerate((int(term[0]), int(mix(term ^ np.uint64(simhash._SALT))[0]))):
                for b in range(64):
                    votes[64 * lane + b] += k if (v >> b) & 1 else -k
    return f"{sum(1 << i for i, v in enumerate(votes) if v > 0):032x}"


def test_fingerprints_are_votes(spark, monkeypatch):
    from inkfold.llm import words as W

    some = ["a b c d a b", "", None, "One two  THREE", "x", "é ß 日本 and so on and so on"]
    assert simhash.as_hex(simhash.fingerprints(pa.array(some))) == [plain_print(t) for t in some]
    long = " ".join(f"w{i % 37}" for i in range(900))
    whole = simhash.as_hex(simhash.fingerprints(pa.array([long, "a b"])))
    monkeypatch.setattr(W, "SLICE_BYTES", 100)  # texts in pieces
    assert simhash.as_hex(simhash.fingerprints(pa.array([long, "a b"]))) == whole == [plain_print(long), plain_print("a b")]


@pytest.mark.parametrize(("radius", "blocks", "rows_of"), [(3, None, 1_024), (12, 14, 5), (0, None, 7), (1, 4, 2)])
def test_near_prints(spark, monkeypatch, radius, blocks, rows_of):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows_of)
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(40)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(128), n))
    all_ = base + [flip(base[0], rng.randrange(1, radius + 2)) for _ in range(40)] + [flip(base[i], radius + i % 3) for i in range(20)] + [0, 1, 2**128 - 1]
    names = sorted({f"{x:032x}" for x in all_})
    got = {r["fingerprint"]: r for r in simhash.near_prints(spark.createDataFrame([(n,) for n in names + names[:5] + [None]], "fingerprint string"), radius, blocks).collect()}
    near = lambda a, b: a != b and (int(a, 16) ^ int(b, 16)).bit_count() <= radius
    assert {n: got[n]["n_near"] for n in names} == {a: sum(near(a, b) for b in names) for a in names} and len(got) == len(names)
    label = {n: n for n in names}
    for a in names:
        for b in names:
            if near(a, b):
                label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
    assert len({(label[n], got[n]["class_print"]) for n in names}) == len(set(label.values())) == len({r["class_print"] for r in got.values()})


def test_near_documents(spark, docs, rows, none):
    got = simhash.near_documents(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert simhash.near_documents(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, (700, 8))
    v[300:600] = v[300]  # a third alike
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.where("id % 50 = 0"), 5, shard_rows=90, block_rows=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 700, 50):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(700) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -m) for k, (m, i) in enumerate(want)]
    assert 900 not in got
    bad = spark.createDataFrame([(0, [1.0, None]), (1, [float("nan")]), (2, None), (3, [float("inf")]), (4, []), (5, [0.5, -0.001])], "id long, e array<float>")
    assert [(r["id"], r["v"]) for r in bad.select("id", topk.quantized(F.col("e")).alias("v")).where("v is not null").collect()] == [(5, [128, -1])]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_repeated_id():
    """A query whose own id has many rows, all of them nearer than any other; and one such candidate."""
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (100, 4))
    v[:30] = [90, 90, 90, 90]
    ids = np.array([7] * 30 + list(range(100, 170)))
    for own, want in ((7, 30), (None, 29)):
        s = v @ v[0]
        best = sorted(((int(x), -int(i)) for x, i in zip(s[want:], ids[want:])), reverse=True)[:5]
        assert topk.Tree(v).search(v[0], ids, own, 5, None) == best


def test_top_k_repeated_rows(spark):
    """Ids with several rows, alike and different, among queries and candidates; cells of few rows; every id once."""
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-9, 9, 3).tolist()) for i in list(range(60)) + [0, 0, 3, 3, 50, 50, 7] * 3]
    rows += [rows[0], rows[0], rows[50], rows[3]]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(df, df.where("id % 50 = 0"), 5, shard_rows=20, block_rows=2, most_cells=8).collect()
    for q in (0, 50):
        score = {}
        for i, v in rows:
            if i != q:
                score[i] = max(score.get(i, -(10**9)), max(int(np.dot(v, w)) for j, w in rows if j == q))
        want = sorted((-s, i) for i, s in score.items())[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def brute_classes(rows):
    sets = []
    for r in rows:
        w = words(r[1], True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = label[a], label[b]
                label = [min(x, y) if k in (x, y) else k for k in label]
    least = {}
    for k, r in zip(label, rows):
        least[k] = min(least.get(k, r[0]), r[0])
    return sorted((r[0], least[k], n) for r, k, n in zip(rows, label, links))


def test_jaccard(spark, docs, rows, none, monkeypatch):
    want = brute_classes(rows)
    got = chosen_path.near_classes(docs).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    assert {r["doc_id"] for r in got if r["keep"]} == {c for _, c, _ in want}
    # small blocks: clusters dealt over many tasks
    monkeypatch.setattr(chosen_path, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(chosen_path, "BUCKET_ROWS", 3)
    monkeypatch.setattr(chosen_path, "LIMIT", 2)
    got = chosen_path.near_classes(docs).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    assert chosen_path.near_classes(none).count() == 0


def test_jaccard_short_pairs(spark, monkeypatch):
    """Pairs of 8 to 30 words at 0.8 or just above, each alone with its partner."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for k in range(2500):
        n = 8 + k % 23
        w = [word() for _ in range(n)]
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, " ".join(w + [word() for _ in range((n - 4) // 4)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in chosen_path.near_classes(df).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    monkeypatch.setattr(chosen_path, "LIMIT", 1)  # all paths to their end
    got = {r["doc_id"]: r["class_id"] for r in chosen_path.near_classes(df).collect()}
    assert sum(got[2 * k + 1] != 2 * k for k in range(2500)) <= 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in label if all(x not in e or e[0] == e[1] for e in edges)}
    assert got.keys() == label.keys() - alone
    assert len({(label[k], v) for k, v in got.items()}) == len(set(got.values())) == len({label[k] for k in got})


def test_substrings(spark, docs, rows, none, monkeypatch):
    count = Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.dedup(docs).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    full = substrings.dedup(docs, with_text=True)
    for r in full.collect():
        assert hashlib.sha256(" ".join(words(r["row"]["text"])).encode()).hexdigest() == r["kept_sha256"]
    monkeypatch.setattr(substrings, "MOST_RUNS", 2)
    got = [tuple(r) for r in substrings.dedup(docs, batches=5).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.dedup(none).count() == 0


def test_substrings_history(spark, none, tmp_path):
    """Calls on one index: a window seen in an earlier call goes, though it is alone in its own."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    once = say(50)
    calls = [
        [(1, say(20) + " " + once + " " + say(20)), (2, say(60)), (3, "a b"), (4, None)],
        [(5, once), (6, say(45)), (7, say(9) + " " + once + " " + say(9)), (8, "")],
        [(9, say(30) + " " + once), (10, say(40))],
        [(11, say(36))],
        [(12, once + " " + say(3))],
    ]
    ix = substrings.RunIndex(spark, str(tmp_path / "ix"))
    ix.windows.append(substrings.window_hashes(none.select("text")))
    out = [substrings.dedup(spark.createDataFrame(c, "doc_id long, text string"), ix) for c in calls]  # asked for only later
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for d in out for r in d.collect()}
    assert got == {1: (90, 0), 2: (60, 0), 3: (2, 0), 4: (0, 0), 5: (50, 50), 6: (45, 0), 7: (68, 50), 8: (0, 0), 9: (80, 50), 10: (40, 0), 11: (36, 0), 12: (53, 50)}
    assert len(ix.windows.runs) <= substrings.MOST_RUNS


def test_run_index(spark, tmp_path):
    ix = substrings.RunIndex(spark, str(tmp_path))
    make = lambda *h: spark.createDataFrame([(x, 1) for x in h], "h long, n long")
    assert ix.hits(make(1)).count() == 0
    ix.append(make(1, 2, 3))
    ix.append(make(3, 4, 4))
    assert sorted(r["h"] for r in ix.hits(make(2, 4, 9)).collect()) == [2, 4]
    ix.compact()
    assert len(ix.runs) == 1 and sorted(r["h"] for r in ix.repeated().collect()) == [3, 4]


def test_licenses(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    by = {r[0]: r[1] for r in rows}
    full = [i for i, t in by.items() if t and t.startswith("MIT License")]
    line = [i for i, t in by.items() if t and "Released under the MIT" in t]
    assert [i for i, r in got.items() if r["license_id"]] == full and got[full[0]]["license_id"] == "MIT"
    assert [i for i, r in got.items() if r["notices"]] == line and got[line[0]]["notices"] == "MIT"
    assert licenses.scan(none).count() == 0


def test_language_model(spark, docs, rows, none):
    held = langid.held_out(F.col("doc_id"), 5, 1)
    got = maxent_lm.train_and_score(docs, held).collect()
    tok = lambda t: [*words(t, True), None]
    test = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(x for r in rows if not test(r[0]) for x in tok(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted((r[0], len(tok(r[1])), sum(count[x] > 0 for x in tok(r[1])), n) for r in rows)
    assert sorted(tuple(r)[:4] for r in got) == want
    base = {r[0]: sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tok(r[1])) for r in rows}
    for r in got:
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * abs(base[r["doc_id"]])
        assert r["score"] < 0
    small = maxent_lm.train_and_score(docs, held).agg(F.sum("score")).first()[0]
    assert small == pytest.approx(sum(r["score"] for r in got))
    assert maxent_lm.train_and_score(none, held).count() == 0


def test_language_model_is_a_distribution():
    """Shares of all known tokens and one unseen token of a class's last member add up to one."""
    from inkfold.llm.maxent_lm import REST, SINGLES, WIDE, Lexicon

    mass, types = np.zeros((WIDE, WIDE)), np.zeros(WIDE)
    mass[SINGLES, 0], mass[SINGLES, REST], types[SINGLES] = 9, 7, 3
    none = np.zeros(0, np.int64)
    lx = Lexicon(16, 5, none.astype(np.uint64), none, none, none, np.full(65536, SINGLES), mass, types)
    for c in (SINGLES, SINGLES + 1):
        assert (mass[c, REST] + 0.5 * types[c] + 0.5) / 10 ** lx.log_rest[c] == pytest.approx(1)
    w = lx.start()
    assert (w[maxent_lm.BIAS2 + SINGLES, 1:REST] == maxent_lm._NEVER).all()


def test_language_model_scores(spark, docs, rows):
    """Scores under given weights against sums made token by token."""
    from inkfold.llm.maxent_lm import BIAS, BIAS2, MEMBER, REST, SINGLES

    learn = docs.select("text")
    seen = maxent_lm.written(maxent_lm.counts(learn), "lm-test")
    lx = maxent_lm.lexicon(seen)
    assert (lx.head_member < REST).any() and lx.n == lx.member_mass.sum()
    rng = np.random.default_rng(2)
    w = (lx.start() + rng.normal(scale=0.3, size=(maxent_lm.ALL_ROWS, maxent_lm.WIDE))).astype(np.float32)
    parts = maxent_lm.score_parts(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), spark.sparkContext.broadcast(lx), w)
    got = sorted((r["doc_id"], r["n_tokens"], r["score_part"]) for r in parts.collect())
    want = []
    for r in rows:
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        if len(raw) > 3_000:
            want.append((r[0], None, None))
            continue
        tok, tail, off = maxent_lm.tokens_of(Words(raw, np.array([0, len(raw)]), True))
        hist = maxent_lm.History.of(tok, off)
        total = 0.0
        for i, (h, t) in enumerate(zip(tok, tail)):
            at = int(lx.find(tok[i : i + 1])[0])
            c, m = (int(lx.head_class[at]), int(lx.head_member[at])) if at >= 0 else (int(lx.suffix_class[t]), REST)
            z = w[BIAS].astype(float) + sum(w[int(x[i])].astype(float) for x in hist.rows)
            total += z[c] - np.log(np.exp(z).sum())
            if c >= SINGLES:
                z = w[BIAS2 + c].astype(float) + sum(w[MEMBER + int(x[0])].astype(float) for x in hist.members(np.array([i]), np.array([c])))
                total += z[m] - np.log(np.exp(z).sum())
                if m == REST:
                    total += np.log(10) * ((np.log10(lx.head_count[at] + 0.5) if at >= 0 else 0.0) - lx.log_rest[c])
        want.append((r[0], len(tok), total / np.log(10)))
    for g, x in zip(got, sorted(want, key=lambda x: (x[0], x[1] or 0))):
        assert x[1] is None or (g[:2] == x[:2] and g[2] == pytest.approx(x[2], rel=1e-4))


def test_gradient_sums():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.4, 3_000), 500).astype(np.uint16)
    g = rng.normal(size=(3_000, 8)).astype(np.float32)
    at, n, total = maxent_lm.sums_by(ids, g)
    full = np.zeros((501, 8))
    np.add.at(full, ids, g)
    assert np.array_equal(at, np.unique(ids)) and np.array_equal(n, np.bincount(ids)[at]) and np.allclose(total, full[at], atol=1e-3)


@pytest.mark.parametrize("cap", [64, 4096])
def test_packing(spark, docs, rows, none, cap):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    got = packing.pack(docs, path, 1, cap).collect()
    want = []
    for r in rows:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0], k // cap, k, len(ids[k : k + cap]), zlib.crc32(ids[k : k + cap].tobytes())) for k in range(0, len(ids), cap)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= cap
    assert len(seqs) <= -(-sum(w[3] for w in want) // cap) * 1.05 + 1
    assert packing.pack(none, path, 1, cap).count() == 0


def test_planner_random():
    rng = random.Random(2)
    for _ in range(40):
        cap = rng.choice([10, 50, 400])
        counts = {k: rng.randrange(1, 30) for k in rng.sample(range(1, cap + 1), rng.randrange(1, min(cap, 25)))}
        p = packing.Planner(dict(counts), cap)
        fill, seen = Counter(), Counter()
        spans = {}
        for length, lo, hi, seq, off, each in p.plan():
            assert lo == seen[length]
            seen[length] = hi
            for r in range(hi - lo):
                s = seq + r // each
                fill[s] += length
                spans.setdefault(s, []).append((off + r % each * length, length))
        assert seen == Counter(counts) and max(fill.values()) <= cap
        for s in spans.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
        assert len(fill) <= -(-sum(k * n for k, n in counts.items()) // cap) * 1.3 + 2


def test_long_texts(spark, monkeypatch):
    """Texts worked on in pieces give what they give whole."""
    from inkfold.llm import words as W

    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(50)}é" + rng.choice(["", ",", "\n", "\t "]) for _ in range(n))
    shared = say(60)
    rows = [(1, say(900) + " " + shared + " " + say(500)), (2, shared), (3, say(30)), (4, None), (5, "x" * 3_000 + " " + say(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    go = lambda: (sorted(map(tuple, substrings.dedup(df).collect())), sorted(map(tuple, simhash.edited_prints(df).collect())))
    whole = go()
    assert dict((r[0], r[2]) for r in whole[0])[1] >= 60
    monkeypatch.setattr(W, "SLICE_BYTES", 200)
    monkeypatch.setattr(W, "STRETCH", 64)
    h, off = W.Words(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([0, len(rows[0][1].encode())])).hashes(), None
    got = np.concatenate([p.h[len(p.h) - p.fresh :] for p in W.hashed(pa.array([rows[0][1]]), 34)])
    assert np.array_equal(h, got) and len(h) == len(SPACE.findall(rows[0][1]))
    x = pa.array([r[1] for r in rows])
    small = [simhash.as_hex(simhash.fingerprints(x)), [np.sort(np.concatenate([substrings.Windows(p, 35, 12).anchor for p in W.hashed(x.slice(0, 1), 34)]))]]
    monkeypatch.undo()
    big = [simhash.as_hex(simhash.fingerprints(x)), [np.sort(np.concatenate([substrings.Windows(p, 35, 12).anchor for p in W.hashed(x.slice(0, 1), 34)]))]]
    assert small[0] == big[0] and np.array_equal(small[1][0], big[1][0])
    assert b"".join(W.joined(np.frombuffer(rows[0][1].encode(), np.uint8))).decode() == " ".join(SPACE.findall(rows[0][1]))


def test_language_long_texts(monkeypatch):
    some = ["Über  den, Wäldern... 12 ça " * 50, "x", None, "", "!!", "é"]
    whole = langid.grams(some)
    for n in (5, 64):
        monkeypatch.setattr(langid, "STRETCH", n)
        got = langid.grams(some)
        assert np.allclose(got[0], whole[0]) and got[1].tolist() == whole[1].tolist() == [True, True, False, False, False, True]


def test_packing_repeated_rows(spark, monkeypatch):
    """One document many times over is dealt over many groups."""
    monkeypatch.setattr(packing, "LEAST_ROWS", 4)
    monkeypatch.setattr(packing, "MOST_SALTS", 8)
    df = spark.createDataFrame([(7, "one two three")] * 60 + [(None, None)] * 3, "doc_id long, text string")
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 1, 16).collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 63
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 16


def test_license_table(spark):
    """Whole texts behind copyright lines, in other spellings and layouts; texts given as a table; notices of any first word."""
    rows = [(i, f"Copyright 2021 Somebody\n\n{t.upper() if i % 2 else t.replace('. ', '.\n  ')}") for i, (_, t) in enumerate(licenses.TEXTS)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: k for i, (k, _) in enumerate(licenses.TEXTS)}
    own = spark.createDataFrame([("X", "You may do what you like.")], "license_id string, text string")
    df = spark.createDataFrame([(1, "you may DO what you like!"), (2, "a\nDedicated to the public domain\n"), (3, None)], "doc_id long, text string")
    found = licenses.scan(df, texts=own, notices=[("PD", "Dedicated to the public domain.")]).orderBy("doc_id").collect()
    assert [(r["license_id"], r["notices"]) for r in found] == [("X", ""), (None, "PD"), (None, "")]
