import random
import re
from collections import Counter

import pytest

from siltstone.llm import quality, queries


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(marked)}


def test_measures():
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a", "É\x85b c", "a b c d e f g h " * 2, "x\ny\nx\n x\n\n\n"]
    texts += ["".join(rnd.choice(["a ", "b ", "É\n", "c\t", "#", "|x "]) for _ in range(rnd.randrange(200))) for _ in range(300)]
    for t in texts:
        got = quality.measure(t)
        assert {k: got[k] for k in brute(t)} == brute(t), repr(t)


@pytest.mark.parametrize(("line", "rule"), [("Home | About | News | Contact | Help", "navigation"), ("All rights reserved.", "boilerplate"), ("the&&& of%%% a### good*** day$$$", "punctuation"), ("NOW!! BUY!! THIS!! VERY!! GOOD!!", "punctuation"), ("a " * 12, "punctuation"), ("THIS IS AN OFFER THAT ENDS TODAY.", "capitals"), ("La " * 20 + ".", "repetition"), ("A plain sentence, of the usual kind.", None), ("Heading", None), ("Das Öl ist, wie immer, zu teuer für die meisten von uns.", None)])
def test_rules(line, rule):
    assert quality.line_fails(line, line.encode().split()) == rule


def test_rows(spark):
    good = "A sentence with quite a few words in it, all of them different, which nobody would think of as anything but prose."
    rows = [(1, good, 1), (2, None, 2), (2, None, 2), (3, "", 3), (4, good + "\nHome | a | b | c\nThen, at the end, some more.", 4), (5, "x y. " * 40_000, 5), (6, good + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(30)), 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, False, False, True, False, False]
    assert [got[i].base_failed for i in range(1, 7)] == [False, True, True, False, True, False]
    assert got[4].lines_failed == 1 and got[4].kept_text == good + "\nThen, at the end, some more."
    assert quality.judge(df).count() == 7 and quality.judge(df.limit(0)).count() == 0


def test_query(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op8_quality(spark, tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
