import hashlib
import random
import re

from pyspark.sql import functions as F

from siltstone.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans(spark, texts):
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, text_id int, base int")
    return {r.doc_id: (r.b, r.s) for r in pii.find(df).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()}


def test_base_equals_the_plain_expressions(spark):
    rnd = random.Random(5)
    parts = ["a", "b.c", "@", "@x.y", "4111 1111-1111 1111", "4111111111111111", "1.2.3.4", "256.1.1.1", "00255.001.1.1", ".", " ", "-", "+", "+1 (212) 555-0100", "(", ")", "12", "0", "é🙂", "\n", "_", "%", "x@y.z_a@b.c"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(600)]
    texts += [None, "", "a@b", "q" * 5000 + "@", "1" * 5000, "1 " * 5000, "a@b" + ".c" * 5000, "+1" + " " * 5000, "1." * 5000]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == brute(t), repr(t[:200])
        assert set(filter(None, got[i][0].split(","))) <= set(got[i][1].split(","))


def test_contexts_discover(spark):
    seeds = [f"Note {w}. You can reach me on +1 212 555 01{i:02d} at noon." for i, w in enumerate("abcdefgh")]
    open_ = ["Then reach me on 555 0199 77 please.", "The total was 555 0142 88 units, and more.", "Write 555 0199 77 down."]
    got = spans(spark, seeds + open_ + ["In 2019 there were 12 of them."])
    assert got[8] == ("", "phone:17:28")
    assert got[9][1] == "" and got[11][1] == ""
    assert got[10][1] == "phone:6:17"


def test_masking(spark):
    rows = [(1, "é a@b.co, 4111 1111 1111 1111 +4111 1111 1111 111", 3), (2, None, 1), (2, None, 1), (None, "x@y.zz", 2), (3, "plain", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = pii.mask_documents(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("1", "é [EMAIL], [CARD] [PHONE]"), ("2", "None"), ("2", "None"), ("3", "plain"), ("None", "[EMAIL]")]
    assert pii.mask_documents(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0


def test_query(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, tables).collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 5
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [want.count(k) for k in pii.KINDS]
