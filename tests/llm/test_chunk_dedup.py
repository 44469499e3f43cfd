import random
from collections import defaultdict

import pyarrow.parquet as pq

from siltstone.llm import chunk_dedup, queries


def brute(rows):
    held, out = defaultdict(list), []
    for d, t in rows:
        for x in set(chunk_dedup.chunks(t)[0]):
            held[x].append(d)
    for d, t in rows:
        seen, bad = set(), []
        for x, a, n in zip(*chunk_dedup.chunks(t), strict=True):
            if x in seen or min(held[x]) != d:
                bad.append((a, n, min(held[x])))
            seen.add(x)
        out.append((d, sorted(bad)))
    return sorted(out)


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(n))


def test_rolling_hash_is_the_plain_one():
    rnd = random.Random(0)
    raw = bytes(rnd.randrange(256) for _ in range(3000))
    h, want, start = 0, [], 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        if (h >> 27) & 31 == 0 and i + 1 - start >= chunk_dedup.LEAST or i + 1 - start == chunk_dedup.MOST:
            want.append(i + 1)
            start = i + 1
    if start < len(raw):
        want.append(len(raw))
    assert chunk_dedup.cuts(raw) == want


def test_insertions_shift_nothing():
    rnd = random.Random(1)
    text = prose(rnd, 3000)
    moved = text[:5000] + " an insertion " + text[5000:]
    a, b = set(chunk_dedup.chunks(text)[0]), set(chunk_dedup.chunks(moved)[0])
    assert len(a - b) <= 4


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rnd = random.Random(2)
    passage = [prose(rnd, 52) for _ in range(20)]
    rows = [(i, prose(rnd, 80) + " " + passage[i % 20].upper() + "\n" + prose(rnd, 40)) for i in range(60)] + [(100 + i, prose(rnd, 200)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "short"), (303, "Short\n"), (304, "y" * 200_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, digest string")
    out = chunk_dedup.dedup_chunks(df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert sorted((d, [tuple(x) for x in r.repeats]) for d, r in got.items()) == brute(rows)
    assert all(got[i].repeating and i % 20 in got[i].owners for i in range(20, 60))
    assert not any(got[i].repeating for i in [*range(20), *range(100, 160), 300, 301, 302, 303])
    assert got[304].repeating and got[304].owners == []
    left = {r.doc_id: r.t for r in out.select("doc_id", chunk_dedup.without(out.text, out.repeats).alias("t")).collect()}
    assert len(left[304]) < 500 and left[100] == rows[60][1] and len(left[40]) < len(left[0]) - 100


def test_passages_of_51_words_of_real_texts(tables):
    """The longest run of shared chunks reaches RUN for nearly all passages put into two documents at random places."""
    words = [r["text"].split() for r in pq.read_table(f"{tables}/documents.parquet", columns=["text"]).to_pylist() if r["text"]]
    words = [w for w in words if len(w) >= 120]
    rnd = random.Random(5)
    missed = 0
    for _ in range(1000):
        passage, docs = rnd.choice(words), []
        at = rnd.randrange(len(passage) - 50)
        for _ in range(2):
            w = rnd.choice(words)[:150]
            i = rnd.randrange(len(w))
            docs.append(chunk_dedup.chunks(" ".join(w[:i] + passage[at : at + 51] + w[i:])))
        held, run, best = set(docs[0][0]), 0, 0
        for x, n in zip(docs[1][0], docs[1][2], strict=True):
            run = run + n if x in held else 0
            best = max(best, run)
        missed += best < chunk_dedup.RUN
    assert missed <= 15


def test_ties_and_nulls(spark):
    rnd = random.Random(3)
    a, b = prose(rnd, 60), prose(rnd, 60)
    df = spark.createDataFrame([(1, a), (1, a), (None, a), (2, b), (None, b + " " + a)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_repeats > 0, r.repeating) for r in chunk_dedup.dedup_chunks(df).collect())
    assert got == [("1", False, False), ("1", False, False), ("2", False, False), ("None", True, True), ("None", True, True)]
    assert chunk_dedup.dedup_chunks(df.limit(0)).count() == 0


def test_query(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = sorted((r.doc_id, r.n_repeats, r.repeat_bytes) for r in queries.op9_chunk_dedup(spark, tables).collect())
    assert rows == [(d, len(x), sum(n for _, n, _ in x)) for d, x in brute(docs)]
