import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import ctw, langid, store, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def brute_ctw(train, texts, depth=ctw.DEPTH):
    """Counts in dictionaries; weighted probabilities by recursion over contexts."""
    counts, children = {}, {}

    def steps(text):
        data = bytes(depth) + text.translate(brute.FOLD).encode() + b"\0"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth : i][::-1], (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1

    for text in train:
        for context, node, bit in steps(text):
            for d in range(depth + 1):
                counts.setdefault((context[:d], node), [0, 0])[bit] += 1
                if d:
                    children.setdefault((context[: d - 1], node), set()).add(context[:d])

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(counts.get((context, node), [0, 0]))
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children.get((context, node), ()))
                own = math.log(0.5) + np.logaddexp(own, below)
            memo[context, node] = own
        return memo[context, node]

    def predict(context, node, bit):
        c = counts.get((context[:depth], node), [0, 0])
        p = (c[bit] + 0.5) / (sum(c) + 1)
        for d in range(depth - 1, -1, -1):
            c = counts.get((context[:d], node), [0, 0])
            share = math.exp(math.log(0.5) + kt(c) - weighted(context[:d], node))
            p = share * (c[bit] + 0.5) / (sum(c) + 1) + (1 - share) * p
        return math.log10(p)

    return [sum(predict(*s) for s in steps(t)) for t in texts]


def test_ctw_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 400").limit(40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "é Zz \x00"), (-4, "zz zz")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, block int").repartition(3)
    train = [t or "" for i, t in rows if fold(i, 7) != 2]
    tokens = Counter(w for t in train for w in brute.words(t))
    ends, n, v = len(train), sum(tokens.values()) + len(train), len(tokens) + 1
    got = {r["doc_id"]: r for r in ctw.score(docs).collect()}
    assert len(got) == len(rows)
    for (i, t), want in zip(rows, brute_ctw(train, [t or "" for _, t in rows])):
        own = [tokens[w] for w in brute.words(t)] + [ends]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(own), sum(c > 0 for c in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c + 1) / (n + v + 1)) for c in own), rel_tol=1e-9)
        assert math.isclose(r["score"], want, rel_tol=1e-8, abs_tol=1e-8)
    assert ctw.score(docs.limit(0)).count() == 0


def test_ctw_takes_long_texts_and_any_ids(spark):
    """Long texts, repeated and null ids: counts by hand; equal texts score alike, in whatever block they are."""
    long = " ".join(f"w{i * i % 8191}" for i in range(300_000))
    rows = [(1, long), (1, long), (None, "ab ab"), (None, None), (2, "ab cd"), (2, "ab cd"), (9, "")]
    train = [t for i, t in rows if i is not None and fold(i, 7) != 2]
    tokens = Counter(w for t in train for w in brute.words(t))
    n, v = sum(tokens.values()) + len(train), len(tokens) + 1
    got = ctw.score(spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, score string").repartition(3)).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_tokens"]), []).append(r)
    assert {k: len(x) for k, x in by.items()} == {(1, 300_001): 2, (None, 3): 1, (None, 1): 1, (2, 3): 2, (9, 1): 1}
    assert all(abs(x[0]["score"] - y["score"]) < 1e-6 * abs(x[0]["score"]) for x in by.values() for y in x) and all(r["held_out"] for r in got if r["doc_id"] is None)
    want = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in brute.words(long)) + math.log10((len(train) + 1) / (n + v + 1))
    assert math.isclose(by[1, 300_001][0]["base_score"], want, rel_tol=1e-9) and 0 < by[1, 300_001][0]["bits_per_byte"] < 8


def test_ctw_blocks_may_be_read_by_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} and w{i} end " * (i % 5), "x") for i in range(60)], "doc_id long, text string, first string").repartition(2)
    whole = sorted(map(tuple, ctw.score(docs).collect()))
    write = ctw.Tables.write

    def scattered(self, df, name):  # the rows of a block come in three tasks, each in order
        out = write(self, df, name)
        return out.repartition(3, F.col("place") < 9, F.col("place") < 20).sortWithinPartitions("block", "place") if name == "texts" else out

    monkeypatch.setattr(ctw.Tables, "write", scattered)
    monkeypatch.setattr(ctw.Tables, "drop", lambda *_: None)
    parts = sorted(map(tuple, ctw.score(docs).collect()))
    for a, b in zip(whole, parts, strict=True):
        assert np.allclose(np.array(a, float), np.array(b, float), rtol=1e-12, atol=1e-12)


def test_packed_numbers_return():
    for x in (np.array([], np.uint64), np.array([1, 2**63 + 5, 7], np.uint64), np.array([1.5, -2.0]), np.array([3, 4], np.uint32)):
        assert np.array_equal(ctw.unpacked(ctw.packed(x), x.dtype), x)
    keys = np.array([3, 9, 2**60, 2**63 + 1], np.uint64)
    assert np.array_equal(np.cumsum(ctw.differences(keys), dtype=np.uint64), keys)


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 10.5, 1e6 + 0.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    truth = [(r["doc_id"], r["lang"]) for r in docs.collect() if fold(r["doc_id"], 5) == 0]
    assert np.mean([rows[i]["lang_pred"] == lang for i, lang in truth]) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !? ١", "en"), (4, "the of and " * 30000, None), (5, "日本", None), (6, "— … 😀", "en"), (None, "the end", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in (1, 2, 3, 4, 5, 6, None)] == [True, True, True, False, False, True, False]
    assert got[4]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_network_equals_a_plain_one():
    """A bidirectional gated network written out position by position."""
    model = langid.Model(["a", "b", "c"], hidden=4, seed=3)
    ids = np.frombuffer("Größe and más".encode(), np.uint8)
    soft = lambda v: v / (1 + abs(v))

    def states(side, text):
        x, u, h, out = side.p["x"].astype(float), side.p["u"].astype(float), np.zeros(4), []
        for byte in text:
            a, b = x[:, byte], u @ h
            z, r = (0.5 + 0.5 * np.array([soft(v) for v in (a + b)[k : k + 4]]) for k in (0, 4))
            c = np.array([soft(v) for v in a[8:] + r * b[8:]])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    ahead, back = states(model.sides[0], ids), states(model.sides[1], ids[::-1])[::-1]
    got = model.probabilities(ids[:, None])[0][:, :, 0]
    for t in range(len(ids)):
        e = np.exp(model.out["w"].astype(float) @ np.concatenate([ahead[t], back[t]]) + model.out["b"][:, 0])
        assert np.allclose(got[t], e / e.sum(), atol=1e-5)


def test_only_letters_are_pooled():
    text = "aé— 日\U0001f600𐐀1!ﬁ\u0301z"
    want = [c.isalpha() for c in text for _ in c.encode()]
    assert langid.letter_bytes(np.frombuffer(text.encode(), np.uint8)).tolist() == want
    data = np.frombuffer((text * 50).encode(), np.uint8)
    for group in (1, 3, 1000):
        offsets = np.array([0, 0, 30, 30, len(data)])
        got = np.zeros(len(data), dtype=bool)
        for ids, weight, row, start in langid.chunked(data, offsets, group):
            for k in range(len(ids)):
                n = min(langid.CHUNK, offsets[row[k] + 1] - start[k])
                assert np.array_equal(ids[k][:n], data[start[k] : start[k] + n]) and not weight[k][n:].any()
                got[start[k] : start[k] + n] = weight[k][:n]
        assert got.tolist() == want * 50
    assert langid.letter_bytes(np.zeros(0, np.uint8)).tolist() == []


def test_positions_are_labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, 40)
    english, german = (docs.filter(f"lang = '{lang}' and length(text) > 800").orderBy("doc_id").first()["text"][:400] for lang in ("en", "de"))
    both = spark.createDataFrame([(1, english + german, 7), (2, None, 7), (3, "1 2", 7)], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r["runs"] for r in langid.label_positions(both, model).collect()}
    assert got[2] == got[3] == [] and all(a["stop"] <= b["start"] and a["lang"] != b["lang"] for a, b in zip(got[1], got[1][1:]))
    share = lambda lang, a, b: sum(min(r["stop"], b) - max(r["start"], a) for r in got[1] if r["lang"] == lang and r["start"] < b and r["stop"] > a) / (b - a)
    cut, end = len(english.encode()), len((english + german).encode())
    assert share("en", 0, cut) > 0.7 and share("de", cut, end) > 0.7


def test_langid_gradients():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], hidden=3)
    for p in (model.sides[0].p, model.sides[1].p, model.out):
        for k in p:
            p[k] = p[k].astype(np.float64)
    ids, labels, weight = rng.integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 0]), np.ones((5, 4))
    _, grads = model.gradients(ids, labels, weight)
    for p, g in zip((model.sides[0].p, model.sides[1].p, model.out), grads):
        for k in p:
            at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
            old, step = p[k][at], 1e-2
            losses = []
            for move in (step, -step):
                p[k][at] = old + move
                losses.append(model.gradients(ids, labels, weight)[0])
            p[k][at] = old
            assert abs((losses[0] - losses[1]) / (2 * step) - g[k][at]) < 5e-3 * max(1, abs(g[k][at]))


def test_viterbi_equals_all_paths(spark):
    rng = np.random.default_rng(9)
    words = Counter({"idiot": 5, "clown": 3, "the": 9, "dot": 2, "it": 4, "to": 6})
    model = toxicity.CharModel(words)
    for _ in range(150):
        token = "".join(rng.choice(list("idot1!05o@cl0wn e")) for _ in range(rng.integers(1, 6)))
        best = math.inf
        paths = [("", 0.0)]
        for options in toxicity.lattice(token, True):
            paths = [(t + x, c + price) for t, c in paths for x, price in options]
        for text, price in paths:
            a = b = "^"
            for c in text:
                if c == " ":
                    price += model.cost(a, b, "^") if b != "^" else 0.0
                    a = b = "^"
                else:
                    price += model.cost(a, b, c)
                    a, b = b, c
            best = min(best, price + (model.cost(a, b, "^") if b != "^" else 0.0))
        cost, found = toxicity.reading(token, model, True)
        assert math.isclose(cost, best, abs_tol=1e-9)
        assert any("".join(found) == t.replace(" ", "") for t, _ in paths)


def test_copies_count_once():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 80)) for _ in range(40)]
    texts += [t + " other" for t in texts[:10]] + [texts[3], "", " "]
    rows = [(i % 2 if i < 40 else (i - 40) % 2, toxicity.shingle_hashes(t)) for i, t in enumerate(texts)]
    rows[50] = (1, rows[3][1])
    assert toxicity.families(rows) == [*range(40), 51, 52]
    assert toxicity.families([(1 - y, own) if i == 45 else (y, own) for i, (y, own) in enumerate(rows)]) == [*range(40), 45, 51, 52]


def test_only_true_copies_leave_the_sample(spark):
    """On the documents: whatever goes has a near copy with its label among what stays, and nothing else goes."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    sample = [(r["toxic"], toxicity.shingle_hashes(r["text"] or "")) for r in docs.join(labels, "doc_id").filter("toxic in (0, 1)").orderBy("doc_id").collect()]
    stay = set(toxicity.families(sample))

    def near(a, b):
        return a[0] == b[0] and 4 * len(a[1] & b[1]) >= 3 * len(a[1] | b[1])

    gone = [r for i, r in enumerate(sample) if i not in stay]
    assert gone and all(any(near(r, sample[j]) for j in stay) for r in gone)
    kept = [sample[j] for j in stay]
    assert not any(near(kept[i], kept[j]) for i in range(len(kept)) for j in range(i))


def test_samples_are_bounded_in_whole_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (2, "b" * 70), (3, None), (4, "d" * 40), (4, "c" * 30), (5, "e")], "doc_id long, text string")
    taken = spark.createDataFrame([(i, i / 10, "x") for i in (1, 2, 3, 4, 9)], "doc_id long, place double, lang string")
    got = sorted((r["doc_id"], r["lang"], r["text"]) for r in store.whole_texts(docs, taken, 100).collect())
    assert got == [(1, "x", "a" * 50), (3, "x", ""), (4, "x", "c" * 30)]


def test_toxicity_counts_all_labelled_rows(spark):
    """Stem weights are those of all rows outside the held-out fold, more than any sample took; copies count once."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        toxic = i % 2
        words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}q" for a, b, c in rng.integers(0, 26, (9, 3))]
        rows.append((i, " ".join(words + ["vilest"] * (toxic and i % 20 == 1) + ["rotten"] * (i % 2)), toxic))
    copies = [(i + 6000, t, y) for i, t, y in rows if i % 20 == 1]
    frame = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    first: dict = {}
    for i, text, y in rows + copies:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            first.setdefault(text, y)
    n = Counter(first.values())
    assert n[1] > 2000 and n[0] > 2000
    for word in ("vilest", "rotten"):
        seen = sum(word in text for text in first)
        assert math.isclose(scorer.weights["=" + word], math.log((seen - toxicity.SURE * math.sqrt(seen)) / n[1]) - math.log(0.5 / n[0])), word


def test_toxicity_reads_symbols_at_edges(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    for token, words in (("!diot", ["idiot"]), ("(lown", ["clown"]), ("\"!D1OT!!\",", ["idiot"]), ("!diot!", ["idiot"]), ("idio+", ["idiot"])):
        assert toxicity.restore(token, scorer.lm) == words, token
        assert scorer.token(token) > toxicity.STRONG
    for token, words in (("(loser", ["loser"]), ("idiot###", ["idiot"]), ("(the", ["the"]), ("the!", ["the"]), ("(and)", ["and"]), ("!!!", []), ("$#!+", [])):
        assert toxicity.restore(token, scorer.lm) == words, token


def test_toxicity_finds_held_out_and_obfuscated(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels)
    out = toxicity.toxicity(docs, scorer).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    rows = out.collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.9, (np.mean(clean), np.mean(toxic))
    for token, word in (("1d10t", "idiot"), ("LOS3R!!", "loser"), ("clooooown", "clown"), ("m-o-r-o-n", "moron"), ("tr4sh", "trash"), ("$cum", "scum"), ("the,", "the")):
        assert word in toxicity.restore(token, scorer.lm)
    assert toxicity.spaced_runs("so i d i o t now", scorer.lm)[-1] == "idiot"
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "7 " * 9000 + "1d10t", 0.5), (4, "!!! ***", 0.5)], "doc_id long, text string, score double")
    small = [x.filter("doc_id < 1500") for x in (docs, labels)]
    once, twice = toxicity.fit(*small), toxicity.fit(*(x.union(x) for x in small))
    assert np.allclose(twice.coefficients, once.coefficients) and twice.weights == once.weights
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(odd, scorer).collect()}
    assert got[1] == got[2] == got[4] < 0.3 <= got[3]
    nothing = toxicity.fit(docs, labels.limit(0))
    assert max(r["score"] for r in toxicity.toxicity(odd, nothing).collect()) < 0.3
    assert toxicity.toxicity(docs.limit(0), scorer).count() == 0


def test_toxic_tokens_are_looked_at_once_a_batch(monkeypatch):
    """The reviewer's F2 of round 3: 983 CPU seconds a GB, as every token of every text was looked up in Python."""
    words = Counter({"idiot": 9, "table": 9, "chair": 9})
    scorer = toxicity.Scorer(toxicity.CharModel(words, frozenset(words)), {"=idiot": 3.0, "moro": 2.0}, np.array([-4.0, 1.0, 1.0, 0.5]))
    texts = [None, "", " table, chair. ", "You IDIOT! table", "i d i o t", "1d1ot moron moronic idiot. IDIOT", "a\x1cb c", "a b", "c d", "täble moroo..."]
    column = pa.array(["cut off", *texts]).slice(1)
    rows = list(scorer.rows(column))
    values = [[], [], [], [3.0], [3.0], [3.0, 3.0, 3.0, 2.0, 2.0], [], [], [], [2.0]]
    assert rows == [scorer._features(v) for v in values]
    asked = []
    monkeypatch.setattr(toxicity, "restore", lambda token, lm: asked.append(token) or [])
    scorer.known.clear()
    list(scorer.rows(pa.array(["table chair. lamp, Door idiot x1"] * 50)))
    assert sorted(asked) == ["idiot", "x1"]
