import re

import corpus_pipeline
from siltstone.llm import language
from tests.llm.test_exact_dedup import low
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_simhash import brute as brute_print
from tests.llm.test_simhash import brute_components

MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def masked(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_pii(text).split(",") if x))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + MASK[k]
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id: r.text for r in read.collect() if r.text and language.LETTER.search(r.text)}
    columns = read.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        if i == 1:
            last = {low(t): d for d, t in sorted(want.items())}
            want = {d: t for d, t in want.items() if last[low(t)] == d}
        if i == 2:
            want = {d: want[d] for d, _, c in brute_components([(d, brute_print(t)) for d, t in want.items()]) if c == d}
        if i == 3:
            want = {d: masked(t) for d, t in want.items()}
        if i < 4:
            assert read.columns == columns
            assert {r.doc_id: r.text for r in read.collect()} == want, name
    words = {}
    for b in read.collect():
        for p in b.pieces:
            words[p.doc_id] = words.get(p.doc_id, 0) + p.n
    assert words == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in want.items()}
    assert len(want) < docs.count()


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and all(r.used <= r.capacity for r in rows)
