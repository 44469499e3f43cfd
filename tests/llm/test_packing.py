import random
import re

import pyarrow.parquet as pq
import pytest

from siltstone.llm import packing, queries


def brute(sizes, lengths, fixed, least):
    """The same rules with a search through all bins and all pieces."""
    order, bins = sorted(range(len(sizes)), key=lambda i: -sizes[i]), []
    for k, i in enumerate(order):
        n = sizes[i]
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[2]))
        else:
            beside = lambda c: min(c - n, sum(sizes[j] for j in order[k + 1 :] if sizes[j] <= c - n))  # noqa: B023, E731
            c = min((c for c in lengths if c >= max(n, least)), key=lambda c: (0 if least else packing.cost(c, fixed) / max(1, n + beside(c)), c))  # noqa: B023
            b = [c, [], 0]
            bins.append(b)
        b[0] -= n
        b[1].append(i)
        b[2] = k
    return bins


def total(caps, fixed):
    return sum(packing.cost(c, fixed) for c in caps)


@pytest.mark.parametrize("seed", range(5))
def test_rules(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, rnd.randrange(60), rnd.randrange(1, 8)]) for _ in range(300)]
    lengths, costs = (8, 16, 64), []
    order = sorted(range(300), key=lambda i: -sizes[i])
    for least in (0, *lengths):
        bins, caps = packing.packed(sizes, order, lengths, 3, least)
        assert sorted(i for b in bins for i in b) == list(range(300))
        used = [sum(sizes[i] for i in b) for b in bins]
        assert all(c == min(x for x in lengths if x >= u) for c, u in zip(caps, used, strict=True))
        assert sorted(used) == sorted(sum(sizes[i] for i in b[1]) for b in brute(sizes, lengths, 3, least))
        costs.append(total(caps, 3))
    assert total(packing.best_fit(sizes, lengths, 3)[1], 3) == min(costs)
    assert packing.best_fit([], lengths) == ([], [])


def test_real_sizes():
    """Several lengths are opened, and no single one, or one as the least, is cheaper."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sizes = [min(8192, n - s) for n in words for s in range(0, max(n, 1), 8192)]
    bins, caps = packing.best_fit(sizes)
    assert len(set(caps)) >= 4 and sum(sizes) / sum(caps) > 0.9
    one = packing.best_fit(sizes, (8192,))[1]
    assert total(caps, packing.FIXED) < 0.9 * total(one, packing.FIXED)


def test_ids_of_text(spark):
    df = spark.createDataFrame([(f"d{i}", "w " * i) for i in range(40)] + [(None, "a")], "doc_id string, text string")
    got = packing.pack(df, lengths=(8, 64), shard=1000, limit=10).collect()
    assert {d for b in got for d in b.doc_ids} == {None, *(f"d{i}" for i in range(40))} and len({b.bin_id for b in got}) == len(got)


def test_rows(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(300), 1) for i in range(300)] + [(400, None, 1), (400, None, 1), (401, "", 1), (None, "a b", 1), (402, "x " * 2500, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for how in ({"shard": 50}, {"shard": 10**6}, {"shard": 10**6, "limit": 40}):
        got = packing.pack(df, lengths=(64, 256, 1000), **how).collect()
        assert len({b.bin_id for b in got}) == len(got)
        per = sorted((str(p.doc_id), p.start, p.n) for b in got for p in b.pieces)
        want = []
        for d, t, _ in rows:
            n = len((t or "").split())
            want += [(str(d), s, min(1000, n - s)) for s in range(0, max(n, 1), 1000)]
        assert per == sorted(want)
        for b in got:
            at = 0
            for p in b.pieces:
                assert p.at == at
                at += p.n
            assert at == b.used <= b.capacity and b.doc_ids == [p.doc_id for p in b.pieces]
    assert packing.pack(df.limit(0)).count() == 0


def test_query(spark, tables):
    docs = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = queries.op4_packing(spark, tables).collect()
    have = {}
    for b in got:
        for p in b.pieces:
            have[p.doc_id] = have.get(p.doc_id, 0) + p.n
    assert have == docs
    assert sum(b.used for b in got) / sum(b.capacity for b in got) > 0.9
