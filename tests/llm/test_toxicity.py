import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

from siltstone.llm import queries, toxicity

BAD = ["grommit", "snorfle", "zblatt", "quizzel"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeilmnorstu", k=rnd.randrange(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        w = rnd.choices(words, k=80)
        toxic = i % 5 == 0
        if toxic:
            for b in rnd.sample(BAD, 2):
                w.insert(rnd.randrange(80), b.upper() if i % 2 else b)
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_counts_and_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 5)
    monkeypatch.setattr(toxicity, "FEW", 1)
    monkeypatch.setattr(toxicity, "COMMON", 0.7)
    rows = [("Aa bbbbbbbbbb cc aa, dd", 1), ("bbbbbccc! Ää aa", 0), (None, 1), ("", None), ("aa " * 30 + "cc", None), ("Dd aa dd", 0)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    uses, docs, bad, clean, near = Counter(), Counter(), Counter(), Counter(), Counter()
    words = [re.findall(r"[a-zä]+", (t or "").lower()) for t, _ in rows]
    for ts, (_, y) in zip(words, rows, strict=True):
        uses.update(ts)
        docs.update(set(ts))
        if y is not None:
            (bad if y else clean).update(set(ts))
    for ts in words:
        near.update(tuple(sorted(p)) for p in zip(ts, ts[1:], strict=False) if p[0] != p[1] and all(1 <= docs[t] <= 0.7 * 6 for t in p))
    counts = toxicity.counted(df)
    got = {r.term: (r.uses, r.docs, r.toxic, r.clean) for r in counts.collect()}
    assert got == {t: (uses[t], docs[t], bad[t], clean[t]) for t in uses}
    name = {toxicity.hashed(t): t for t in uses}
    for least in (1, 2):
        got = {tuple(sorted((name[r.a], name[r.b]))): r.n for r in toxicity.pairs(df, counts, len(rows), least).collect()}
        assert got == {p: n for p, n in near.items() if n >= least}


def test_pairs_of_hubs_are_parted_and_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in "abcde" for b in "fghij"]
    rows = [(" ".join(rnd.choices(words, k=40)),) for _ in range(50)]
    df = spark.createDataFrame(rows, "text string").selectExpr("text", "CAST(NULL AS INT) AS toxic")
    near = Counter(tuple(sorted((toxicity.hashed(x), toxicity.hashed(y)))) for (t,) in rows for x, y in zip(t.split(), t.split()[1:], strict=False) if x != y)
    counts = toxicity.counted(df)
    for hub in (0, 1_000_000):
        monkeypatch.setattr(toxicity, "HUB", hub)
        found = toxicity.pairs(df, counts, 10_000)
        assert {(r.a, r.b): r.n for r in found.collect()} == {p: n for p, n in near.items() if n >= toxicity.PAIRS}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1


def test_pairs_of_a_word_travel_in_one_row():
    everything, none = np.full(16, -1, np.int64), np.zeros(16, np.int64)
    words = [f"{a}{b}" for a in "abcde" for b in "fghij"]
    text = " ".join(random.Random(8).choices(words, k=2000))
    for hubs in (none, everything):
        held = toxicity.Pairs(everything, frozenset(), hubs)
        held.add(text)
        rows = [r for batch in held.rows() for r in batch.to_pylist()]
        near = Counter(tuple(sorted((toxicity.hashed(x), toxicity.hashed(y)))) for x, y in zip(text.split(), text.split()[1:], strict=False) if x != y)
        assert {(r["a"], b): n for r in rows for b, n in zip(r["b"], r["n"], strict=True)} == near
        assert len(rows) == len({(a, b >> 58 if hubs is everything else 0) for a, b in near})


def test_no_shuffle_file_is_left(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    was, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    found = toxicity.written(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "shuffled")
    assert not files() - was and found.count() == 10 and spark.conf.get(key) == before


def test_hashes_and_bitmap(spark):
    df = spark.createDataFrame([("é",), ("",), ("word",)], "term string").selectExpr("term", "xxhash64(term) AS h")
    assert all(r.h == toxicity.hashed(r.term) for r in df.collect())
    bits = np.frombuffer(toxicity.bitmap(df, 1 << 10), np.uint8)
    assert {int(i) for i in np.flatnonzero(np.unpackbits(bits, bitorder="little"))} == {toxicity.hashed(t) % (1 << 10) for t in ("é", "", "word")}


def test_graph_walk_and_polarities_equal_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{'abcdefgh'[i // 8]}{'abcdefgh'[i % 8]}" for i in range(40)]
    df = spark.createDataFrame([(" ".join(rnd.choices(words, k=30)),) for _ in range(60)], "text string").selectExpr("text", "CAST(NULL AS INT) AS toxic").cache()
    counts = toxicity.counted(df)
    of = toxicity.nodes(counts, 1000)
    edges = toxicity.graph(toxicity.pairs(df, counts, 1000), of)
    uses, near = Counter(), Counter()
    for r in df.collect():
        ws = r.text.split()
        uses.update(ws)
        near.update(tuple(sorted(p)) for p in zip(ws, ws[1:], strict=False) if p[0] != p[1])
    w = {}
    for (a, b), n in near.items():
        x = np.log(n * sum(uses.values()) / (2 * uses[a] * uses[b]))
        if n >= toxicity.PAIRS and x > 0:
            w[a, b] = w[b, a] = x
    out = Counter()
    for (a, _), x in w.items():
        out[a] += x
    want = {(a, b): x / out[a] for (a, b), x in w.items()}
    got = {(r.u, r.v): r.w for r in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 50
    seeds = spark.createDataFrame([(words[0], 3.0, 0.0), (words[1], 1.0, 0.0), (words[2], 0.0, 2.0), ("none", 0.0, 2.0)], "term string, bad double, good double")
    home = {"bad": {words[0]: 0.75, words[1]: 0.25}, "good": {words[2]: 0.5, "none": 0.5}}
    at = {k: dict(v) for k, v in home.items()}
    for _ in range(toxicity.STEPS):
        for side, start in home.items():
            new = Counter({t: toxicity.RESTART * v for t, v in start.items()})
            for (a, b), x in want.items():
                new[b] += at[side].get(a, 0.0) * x * (1 - toxicity.RESTART)
            at[side] = {t: v for t, v in new.items() if v}
    walked = {r.node: (r.bad, r.good) for r in toxicity.walk(edges, seeds).collect()}
    assert all(abs(walked[t][0] - at["bad"].get(t, 0)) + abs(walked[t][1] - at["good"].get(t, 0)) < 1e-9 for t in walked) and len(walked) > 30
    least = toxicity.RESTART / 4
    scores = {t: (x - y) / (x + y + least) for t, (x, y) in walked.items()}
    got = toxicity.polarities(edges, seeds)
    assert got.keys() == {t for t, v in scores.items() if abs(v) >= toxicity.LEAST} and all(abs(got[t] - scores[t]) < 1e-9 for t in got)
    assert min(got.values()) < 0 < max(got.values())


def test_logistic_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = (rng.random(5000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 1)))).astype(float)
    assert np.allclose(toxicity.fit(x, y), [2, -1, -1], atol=0.2)


def test_held_out_documents_are_found(spark):
    rows = texts(500)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows] + [(900, None, "x", 0.0), (901, "", "x", 0.0), (902, "snorfle " * 50_000, "x", 0.0), (None, rows[0][1], "x", 0.0)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows] + [(1, None), (None, 1), (0, 0)], "doc_id long, toxic int")  # held-out labels are wrong
    out = toxicity.score_documents(docs, labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(got[i].held_out == held(i) for i, *_ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in rows if held(i)]) > 0.97
    assert [got[i].predicted for i in (900, 901, 902, None)] == [0, 0, 1, 1]
    assert got[900].score == got[901].score


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9


def test_query_equals_its_parts(spark, tables):
    """The query's figures are those of a plain form, given the polarities."""
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity.sample(labels)
    n = Counter(int(r.toxic > 0) for r in known.collect())
    rows = docs.select("doc_id", "text")
    counts = toxicity.counted(rows.join(known, "doc_id", "left")).cache()
    of = toxicity.seeds(counts, n[1], n[0])
    edges = toxicity.graph(toxicity.pairs(rows, counts, docs.count()), toxicity.nodes(counts, docs.count()))
    lexicon = toxicity.polarities(edges, of)
    text = {r.doc_id: r.text for r in rows.collect()}
    for r in toxicity.score_documents(docs, labels).collect():
        f = [lexicon[t] for t in {w.lower() for w in re.findall(r"[^\W\d_]+", (text[r.doc_id] or "").lower())} if t in lexicon]
        want = (np.log1p(sum(x for x in f if x > 0)), np.log1p(-sum(x for x in f if x < 0)), max([0.0, *f]))
        assert np.allclose((r.total, r.clean, r.top), want, atol=1e-6)


def test_graph_joins_words_that_are_no_seeds(spark):
    rows = [("grommit aaa",)] * 5 + [("aaa bbb",)] * 5 + [(f"x{'abcdefghij'[i % 8]} y{'klmnopqrst'[i % 8]}",) for i in range(80)] + [("solo wanda",)] * 2
    df = spark.createDataFrame(rows, "text string").selectExpr("text", "CAST(NULL AS INT) AS toxic")
    counts = toxicity.counted(df)
    edges = toxicity.graph(toxicity.pairs(df, counts, 1000), toxicity.nodes(counts, 1000))
    found = {(r.u, r.v) for r in edges.collect()}
    assert {("grommit", "aaa"), ("aaa", "bbb"), ("bbb", "aaa"), ("xa", "yk")} <= found and ("solo", "wanda") not in found
    reached = {r.node: r.bad for r in toxicity.walk(edges, spark.createDataFrame([("grommit", 1.0, 0.0)], "term string, bad double, good double")).collect()}
    assert reached["bbb"] > 0 and "xa" not in reached
