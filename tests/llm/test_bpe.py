import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe, queries

PATH = public_tokenizers.path(queries.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(PATH)


def same(text: str) -> None:
    ids = CODEC.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
    assert CODEC.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "It's  a dog's life, they'll SAY 12 345", "ΑΣ ΣΑΣ ς", "İstanbul ǅ Å é", "<|endoftext|>a<|startoftext|> B<|endoftext|", "a\x1cb\x1fc\x85d e᠎f﻿g", "x" * 5000, "日本語 한국 🙂🙂", "\x00\x01", "'s'S ''LL"])
def test_library(text):
    same(text)


def test_all_characters():
    for at in range(0, 0x30000, 64):
        same(" a".join(chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000))


def test_random_texts():
    rnd = random.Random(1)
    some = "aAbeéÉßıİΣσ'sdtlmrv.,!?019 \n\t  ́漢🙂<|>" + "etaoin"
    for _ in range(3000):
        same("".join(rnd.choice(some) for _ in range(rnd.randrange(40))))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for _ in range(3):
        same("one two three four five six, seven. eight one")


def test_rows(spark):
    rows = [(1, "a b", "x", 1), (None, None, None, 2), (1, "a b", "x", 1), (3, "", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = [tuple(r) for r in bpe.encode_documents(df, PATH).collect()]
    assert sorted(got, key=str) == sorted([(d, len(x) // 4, bytearray(x), CODEC.decode(x)) for d, t, *_ in rows for x in [CODEC.encode(t)]], key=str)
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
    assert [r[0] for r in bpe.encode_documents(df, PATH).select(bpe.decoded("ids", PATH)).collect()] == [r[3] for r in got]


def test_query(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
