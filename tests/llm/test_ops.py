"""Each operator against a plain version on small tables, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from domloom.llm import decontaminate, language, lines, minhash, quality, quality_rules, sentencepiece, substrings, token_counts, toxicity
from domloom.llm import queries as Q
from domloom.llm._features import word_grams
from domloom.llm._graph import components
from domloom.llm._pieces import default_path, pattern
from domloom.llm._words import ALNUM, RINGS, SPACE, buffers, spans

VOCABULARY = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
ODD = [None, "", " \n\t ", "one", "a b c", "é ñ 漢字 🙂 word", "x" * 5000, "\x00 \x0b a", "Same Same same same SAME"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus(seed, n=60, vocabulary=60):
    """Random texts, copies, near copies, shared passages, and the odd ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    make = lambda k: [r.choice(words) for _ in range(k)]
    passage = make(30)
    texts = list(ODD)
    for _ in range(n):
        t = make(r.randint(1, 90))
        if r.random() < 0.3:
            at = r.randint(0, len(t))
            t[at:at] = passage[r.randint(0, 5) :]
        texts.append(" ".join(t).replace(" w7 ", ".\n"))
    for _ in range(n // 3):
        t = (r.choice(texts) or "q").split(" ")
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    r.shuffle(texts)
    return list(enumerate(texts))


SCHEMA = "doc_id long, text string"


def frame(spark, rows, n=5):
    """Rows with columns whose names clash with what operators use inside, over some partitions."""
    df = spark.createDataFrame([(i, t, "src", 1, "k") for i, t in rows], "doc_id long, text string, id string, n long, node string")
    return df.repartition(n)


# ---- near duplicates


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: sets_of(t, k) for i, t in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 2), (3, 5)])
def test_near_duplicates(spark, seed, k):
    rows = corpus(seed)
    got = minhash.near_duplicates(frame(spark, rows), shingle=k)
    assert {tuple(r) for r in got.collect()} == groups(rows, k)


def test_near_duplicates_large_group(spark):
    """A chain of near copies, no two far ones alike, in buckets larger than a block."""
    r = random.Random(5)
    base = [f"b{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        base[r.randrange(120)] = f"c{i}"
        rows.append((i, " ".join(base)))
    old = minhash.BLOCK, minhash.HUBS
    try:
        minhash.BLOCK, minhash.HUBS = 16, 1
        got = {tuple(x) for x in minhash.near_duplicates(frame(spark, rows), shingle=3).collect()}
    finally:
        minhash.BLOCK, minhash.HUBS = old
    assert got == groups(rows, 3)


def test_near_duplicates_odd_rows(spark):
    df = frame(spark, [(5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (None, "q r s t")])
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=4).collect())
    assert got == [("5", 3, 5, True), ("7", 3, 5, False), ("7", 3, 5, False), ("9", 0, 9, True), ("None", 1, None, True), ("None", 3, 5, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300), (1, 0), (None, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chance_of_a_miss():
    """What the docstring says of a pair at 0.8: fewer than two of 20 half-keys of three agree."""
    p = 0.8**minhash.ROWS
    n = minhash.HALVES
    assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) < 1.4e-5


# ---- repeated substrings


def cut(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, out = {}, {}
    for i in sorted(words):
        gone = set()
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s : s + window])
            if key in first:
                gone.update(range(s, s + window))
            else:
                first[key] = (i, s)
        out[i] = [w for k, w in enumerate(words[i]) if k not in gone]
    return {(i, len(words[i]), len(words[i]) - len(out[i]), " ".join(out[i])) for i in words}


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(1, 20, 60), (2, 6, 8), (3, 7, 2)])
def test_substrings(spark, seed, window, vocabulary):
    rows = corpus(seed, vocabulary=vocabulary)
    got = substrings.remove_repeats(frame(spark, rows), window=window, anchor=4)
    assert {tuple(r) for r in got.collect()} == cut(rows, window)


def test_substrings_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(30))
    df = frame(spark, [(1, t), (1, t), (2, t), (None, t), (3, None)])
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [("1", 30, 0), ("1", 30, 0), ("2", 30, 30), ("3", 0, 0), ("None", 30, 0)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


# ---- benchmark passages


def hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    grams = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if got := grams.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found - {None})))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed):
    r = random.Random(seed)
    rows = corpus(seed, vocabulary=30)
    texts = [t for _, t in rows if t]
    items = [(f"i{k}", " ".join(r.choice(texts).split()[:k])) for k in (3, 5, 9, 10, 11, 25, 40)]
    items += [("none", None), ("blank", "  "), ("one", "漢字"), ("dup", items[5][1]), ("i25", items[5][1]), (None, items[3][1])]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string"))
    found = sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in got.collect()), key=str)
    assert found == hits(rows, items)
    for x in got.collect():
        assert sum(s.end - s.start for s in x.spans) == x.n_hit


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    df = frame(spark, [(1, "A-b c,d e f g h i j"), (1, "x"), (None, "b c d e f g h i j k")])
    assert sorted(r.n_hit for r in decontaminate.contamination(df, items).collect()) == [0, 10, 10]
    assert decontaminate.contamination(df, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), items).count() == 0


# ---- lines


def test_lines(spark):
    r = random.Random(4)
    pool = [f"line {k}" for k in range(6)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(60, None)]
    seen, want = set(), set()
    for i, t in rows:
        part = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for s in range(len(part) - 2):
            key = tuple(part[s : s + 3])
            gone |= {s, s + 1, s + 2} if key in seen else set()
            seen.add(key)
        kept = "\n".join(x for k, x in enumerate(part) if k not in gone) if gone else t
        want.add((i, kept, len(part), len(gone)))
    got = lines.remove_repeated_lines(frame(spark, rows).withColumn("n_lines", F.lit("clash")))
    assert {(x.doc_id, x.text, x.n_lines, x.n_removed_lines) for x in got.collect()} == want
    odd = frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")])
    assert sorted((str(x.doc_id), x.n_removed_lines) for x in lines.remove_repeated_lines(odd).collect()) == [("1", 0), ("1", 0), ("2", 3), ("None", 0)]
    assert lines.remove_repeated_lines(odd.limit(0)).count() == 0


# ---- quality rules


def test_decontamination_merges_runs():
    """Against marking word by word: rows without runs, runs inside others, touching and apart; then 200,000 runs of one row."""
    rng = random.Random(7)
    rows = [sorted((rng.randrange(60), rng.randrange(1, 12)) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows.append([(3 * i, 2) for i in range(200_000)])
    pairs = pa.array([[{"start": a, "n": n} for a, n in r] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))
    part = lambda k: pa.ListArray.from_arrays(pairs.offsets, pairs.flatten().field(k))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([[]] * len(rows), pa.list_(pa.string())), part("start"), part("n")], ["row", "items", "start", "n"])
    for cut in (batch, batch.slice(5, 20), batch.slice(0, 0)):
        got = pa.Table.from_batches(list(decontaminate._merged(iter([cut])))).to_pylist()
        assert [x["row"] for x in got] == cut.column(0).to_pylist()
        for x in got:
            words = {i for a, n in rows[x["row"]] for i in range(a, a + n)}
            assert {i for s in x["spans"] for i in range(s["start"], s["end"])} == words
            assert all(a["end"] < b["start"] for a, b in zip(x["spans"], x["spans"][1:]))


def test_quality_rules(spark):
    r = random.Random(6)
    texts = [t for _, t in corpus(6, vocabulary=5)] + ["the of and\n" * 40, "# * $ & | < >" * 9, "a b c d e f g h " * 5 + "z"]
    texts += [" ".join(r.choice("the cat of dogs and sea to be we it".split()) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for x in quality_rules.judge(df).collect():
        t = texts[x.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        own = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want
        assert x.kept == (not x.base_failed and not x.failed)
    plan = quality_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# ---- classifiers


def labelled(spark, n=400):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        good, bad = r.random() < 0.7, r.random() < 0.25
        t = [r.choice(VOCABULARY) + r.choice("abcdefgh") for _ in range(r.randint(20, 60))]
        if not good:
            t = [t[0]] * len(t) if r.random() < 0.5 else [x.upper() + "!!" for x in t]
        if bad:
            t.insert(r.randrange(len(t)), r.choice(["vilestuff", "nastyword", "vilething"]))
        rows.append((i, " ".join(t)))
        marks.append((i, int(good), int(bad)))
    rows += [(n, None), (n + 1, "")]
    marks += [(n, 1, 0), (n + 1, 1, 0), (n + 5, 0, 1), (None, 1, 1)]
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m for m in marks}


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    weights, bias = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality.score(docs, weights, bias).collect()}
    held = [i for i in got if i % 5 == 0 and i < 400]
    assert np.mean([(got[i] >= 0.3) == truth[i][1] for i in held]) > 0.95
    assert got[400] == got[401] and 0 <= got[400] <= 1
    kept = quality.keep(docs, weights, bias)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}
    again, _ = quality.train(docs.repartition(3), labels, F.col("doc_id") % 5 != 0)
    assert np.array_equal(weights, again)
    none, b = quality.train(docs, labels.limit(0), F.lit(True))
    assert not none.any() and b == 0


def test_features_of_a_row_are_its_own():
    """A text has the same features alone and behind any other, one that ends with its first word and empty ones among them."""
    texts = ["same same", "same word", "", None, "word", "Word! 1", ""]
    both = list(word_grams(pa.array(texts)))
    for text, (index, value) in zip(texts, both, strict=True):
        ((i, v),) = word_grams(pa.array([text], pa.string()))
        assert np.array_equal(i, index) and np.array_equal(v, value)


def test_quality_fit_sends_the_driver_no_rows(spark, monkeypatch):
    """The sample is fitted on in a task: what reaches the driver is one row of weights, the same that updates one by one give."""
    docs, labels, _ = labelled(spark)
    train_on = F.col("doc_id") % 5 != 0
    sent = []
    for name in ("toArrow", "toPandas", "collect"):
        monkeypatch.setattr(type(docs), name, lambda self, f=getattr(type(docs), name): (sent.append(len(out := f(self))), out)[1])
    weights, bias = quality.train(docs, labels, train_on)
    assert sum(sent) <= 2
    monkeypatch.undo()
    chosen = quality.sampled(docs, labels, "quality", train_on, "doc_id", "text", quality.SAMPLE, quality.BITS, True).toArrow().sort_by([("h", "ascending"), ("mark", "ascending"), ("t", "ascending")]).to_pylist()
    model = quality.Ftrl((1 << quality.BITS) + 1)
    for _ in range(quality.EPOCHS):
        for x in chosen:
            model.update(np.array([*x["index"], 1 << quality.BITS]), np.array([*x["value"], 1.0]), x["mark"])
    assert len(chosen) > 300
    assert np.allclose(weights, model.weights()[:-1], atol=1e-6) and np.isclose(bias, model.weights()[-1])


def test_quality_fit_of_repeated_ids(spark):
    """Rows that share an id are fitted on in the same order, however the table is dealt."""
    docs, labels, _ = labelled(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id") % 40)
    one, two = (quality.train(docs.repartition(n, F.xxhash64("text")), labels, F.lit(True)) for n in (1, 7))
    assert np.array_equal(one[0], two[0]) and np.isclose(one[1], two[1])


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    assert (np.diff(model.theta) > 0).all()
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    held = [i for i in got if i % 5 == 0 and i < 400]
    assert np.mean([got[i].toxic == bool(truth[i][2]) for i in held]) > 0.97
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in got.values()) and not got[400].toxic
    assert toxicity.severity(docs, toxicity.train(docs, labels.limit(0), F.lit(True))).where("toxic").count() == 0


def test_toxicity_rare_markers():
    """A word of few toxic texts is marked however many other labels there are, and there is no limit on how many are marked."""
    r = np.random.default_rng(3)
    common = lambda: r.choice(np.arange(1000, 3000), 30, replace=False)
    index = [np.append(common(), 1) for _ in range(2000)] + [np.append(common(), 2) for _ in range(12)] + [common() for _ in range(8000)]
    toxic = np.array([1] * 2012 + [0] * 8000)
    marked = np.flatnonzero(toxicity._markers(index, toxic, 12))
    assert {1, 2} <= set(marked) and len(marked) <= 4
    index = [np.arange(600)] * 50 + [common() for _ in range(200)]
    assert len(np.flatnonzero(toxicity._markers(index, np.array([1] * 50 + [0] * 200), 12))) == 600
    assert not toxicity._markers(index, np.ones(250, int), 12).any() and not toxicity._markers([], np.zeros(0, int), 12).any()


def test_toxicity_copies():
    """Near copies teach once; a shared passage alone drops nothing."""
    own = [np.arange(1000 * i, 1000 * i + 100, dtype=np.int64) for i in range(4)]
    shared = np.arange(90_000, 90_020, dtype=np.int64)
    sets = [np.union1d(own[0], shared), np.union1d(own[1], shared), np.union1d(own[0][:95], shared), own[2], own[2], np.empty(0, np.int64), np.empty(0, np.int64)]
    minima = [[1, 2], [1, 3], [1, 2], [5, 6], [5, 6], [], []]
    assert toxicity._one_of_copies(minima, sets).tolist() == [0, 1, 3, 5, 6]


def test_ordinal_gradient():
    """The fitted likelihood is at a maximum: no small step along any parameter raises it."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3)) ** 2
    grade = np.digitize(x @ [1, 2, 0.5] + r.logistic(size=300), [2, 4, 6])
    index = [np.arange(3)] * 300
    m = toxicity.CumulativeLink.fit(index, list(x), grade, 4, 3, epochs=3000, l2=0.0)

    def loss(w, theta):
        cdf = np.hstack([np.zeros((300, 1)), 1 / (1 + np.exp(-(theta[None] - (x @ w)[:, None]))), np.ones((300, 1))])
        return -np.log(cdf[np.arange(300), grade + 1] - cdf[np.arange(300), grade]).mean()

    w, theta = m.w.astype(float), m.theta
    best = loss(w, theta)
    for k in range(3):
        for s in (-0.1, 0.1):
            assert loss(w + s * np.eye(3)[k], theta) > best - 1e-4 and loss(w, theta + s * np.eye(3)[k]) > best - 1e-4


def test_language(spark):
    rows = []
    r = random.Random(9)
    words = {"xx": ["thing", "other", "making", "this"], "yy": ["schön", "nicht", "machen", "über"]}
    for i in range(80):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(30)), lang))
    rows += [(80, None, "xx"), (81, "12 ... !", "xx"), (82, "", None), (83, "thing", None), (84, "漢字" * 900, "xx"), (85, "² ³", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(docs, F.col("doc_id") % 4 != 2, default_path("piece_bpe_32k.model")).collect()}
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") for i in range(80)) and got[83].lang_pred == "xx"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (80, 81, 82, 85)) and all(0 <= x.score <= 1 for x in got.values())
    none = language.identify(docs, F.lit(False), default_path("piece_bpe_32k.model"))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba"])}
    p = [0.2, 0.1, 0.15, 0.25, 0.05, 0.11, 0.01]
    model = language.Models(pieces, [p])

    def every(s):
        return 1.0 if not s else sum(p[pieces[s[:n]]] * every(s[n:]) for n in range(1, len(s) + 1) if s[:n] in pieces)

    for w in ("a", "ab", "abab", "bba"):
        logs, n = model.scores(w)
        assert n == 1 and np.isclose(np.exp(logs[0]), every("▁" + w))


# ---- tokens


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece as library

    path = default_path("piece_bpe_32k.model")
    theirs = library.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in corpus(3)] + ["  a   b", "日本語 テキスト\n\n x", "ab" * 400, "don't (stop), \"x\"; 3.14%", "<s> </s> <0x41>\x00", "▁▁ x", " " * 40 + "deep"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], SCHEMA).withColumn("ids", F.lit(1))
    got = {r.doc_id: r for r in sentencepiece.encode(docs, path, check_col="same").collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == theirs.encode(t) and got[i].same
    assert got[999].ids == [] and got[999].same
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(docs.drop("ids"), path), path).collect()}
    assert all(back[i] == theirs.decode(theirs.encode(t)) for i, t in enumerate(texts))
    assert sentencepiece.encode(docs.limit(0), path).count() == 0


def test_token_counts(spark, tmp_path):
    rows = corpus(7) + [(None, "null id")]
    path, eod = default_path("byte_bpe_50k.tiktoken"), 50256
    blocks = token_counts.flat_blocks(frame(spark, rows, 3), path, pattern(), eod, block=64).cache()
    enc = token_counts._encoder(path, pattern())
    want = Counter((i, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(blocks, eod).collect()) == want
    # The same files without an index, read as bytes.
    for f, content in blocks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "content")))).collect():
        (tmp_path / f"{f}.bin").write_bytes(b"".join(x.content for x in content) + b"\x01\x00")
    flat = token_counts.count_tokens(token_counts.read_flat_files(spark, str(tmp_path), block=50), eod)
    assert Counter(r.n_tokens for r in flat.collect()) == Counter(n for (_, n), k in want.items() for _ in range(k))
    empty = spark.createDataFrame([("f", 0, None), ("f", 1, b""), ("f", 2, bytes(2 * 3) + (eod).to_bytes(2, "little"))], "file string, block long, content binary")
    assert [tuple(r) for r in token_counts.count_tokens(empty, eod).collect()] == [("f", 0, 3)]
    assert token_counts.count_tokens(empty.limit(0), eod).count() == 0


# ---- helpers


@pytest.mark.parametrize("member", [SPACE, ALNUM])
def test_words(member):
    import pyarrow as pa

    texts = [t for _, t in corpus(1)]
    data, off = buffers(pa.array(texts))
    start, end, first = spans(data, off, member)
    raw, chars = data.tobytes(), [bytes([b]) for b in range(256)]
    split = rb"[\x20\x09-\x0D]+" if member is SPACE else b"[" + b"".join(re.escape(c) for c in chars if not ALNUM[c[0]]) + b"]+"
    for i, t in enumerate(texts):
        want = [w for w in re.split(split, (t or "").encode()) if w]
        assert [raw[a:b] for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] == want
    one, words = RINGS[0].words(data, start, end), [raw[a:b] for a, b in zip(start, end, strict=True)]
    assert len(set(one.tolist())) == len(set(words)) == len(set(zip(one.tolist(), words, strict=True)))


def test_tables_are_shared_and_swept(spark):
    from pathlib import Path

    from domloom.llm._store import durable, shared_folder, sweep

    sweep(spark)
    root = Path(shared_folder(spark).removeprefix("file:"))
    assert str(root) == spark.conf.get("spark.checkpoint.dir")
    assert durable(spark.range(3), "t").count() == 3 and list(root.glob("t-*"))
    assert sweep(spark) == 1 and not list(root.glob("t-*"))


# ---- registered queries


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, data, duck, name):
    ours, sql = Q.QUERIES[name](spark, data).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df()
    flat = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
    assert flat(ours) == flat(sql)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_has_a_row_for_each_document(spark, data, name):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert Q.QUERIES[name](spark, data).select("doc_id").subtract(docs.select("doc_id")).count() == 0
    assert Q.QUERIES[name](spark, data).count() == docs.count()


def test_digest_of_kept_words(spark, data):
    row = Q.op2_substring_dedup(spark, data).where("n_removed = 0").first()
    text = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()
