import random
import zlib

import numpy as np

from siltstone.llm import language, queries


def texts(rnd, lang):
    parts = {"aa": ["the", "ing", "er", "and"], "bb": ["que", "ión", "ós", "la"], "cc": ["漢", "字", "語"]}[lang]
    return " ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(60))


def test_application_equals_training_form():
    rnd = random.Random(0)
    net = language.train([(texts(rnd, x), x) for x in ("aa", "bb") * 20])
    x = np.concatenate([language.windows(texts(rnd, "aa") * 3)[0] for _ in range(9)])
    assert np.allclose(net.maxima(x, net.pairs()), net.pooled(x, net.tables())[0], atol=1e-4)


def test_gradients_learn_and_batches_do_not_matter():
    rnd = random.Random(1)
    net = language.train([(texts(rnd, x), x) for x in ("aa", "bb", "cc") * 30])
    model = language.Model(net)
    some = [(texts(rnd, x) * rnd.choice([1, 1, 40]), x) for x in ("aa", "bb", "cc") * 30]
    together = model.predict([t for t, _ in some])
    assert [x for x, _ in together] == [x for _, x in some]
    for (t, _), (lang, score) in zip(some, together, strict=True):
        (one,) = model.predict([t])
        assert one[0] == lang and abs(one[1] - score) < 1e-5 and 0 <= score <= 1


def test_rows(spark):
    rnd = random.Random(2)
    rows = [(i, texts(rnd, x), x, 0.5) for i, x in enumerate(("aa", "bb") * 60)]
    rows += [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "12 !?", "bb", 0.0), (903, texts(rnd, "aa") * 300, None, 0.0), (None, texts(rnd, "bb"), "bb", 0.0), (5, rows[5][1], "bb", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == rows[i][2] for i in range(120))
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert language.keep_identified(df).count() == len(rows) - 3 and language.keep_identified(df).columns == df.columns
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_held_out_accuracy(spark, tables):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op6_language(spark, tables).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_are_not_seen(spark):
    rnd = random.Random(4)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, texts(rnd, "aa"), "zz" if held(i) else "aa") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for _, lang in language.sample(df)} == {"aa"}


def test_query_equals_a_plain_forward_pass(spark, tables):
    """Filters as dot products with the embedded windows, one place after another."""
    import unicodedata

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    net = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_language(spark, tables).collect()}
    for r in docs.limit(25).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        raw = unicodedata.normalize("NFC", r.text).encode("utf-8", "replace")
        total = np.zeros(len(net.labels))
        for at in range(0, len(raw), language.WINDOW):
            piece = raw[at : at + language.WINDOW]
            x = net.embedding[[*language.CLASSES[list(piece)], *[0] * (language.WINDOW - len(piece))]]
            pooled = [max(float((x[i : i + w] * f[:, :, k]).sum()) for i in range(language.WINDOW - w + 1)) for w, f in zip(language.WIDTHS, net.filters, strict=True) for k in range(language.FILTERS)]
            z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.offset
            total += len(piece) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = got[r.doc_id]
        assert lang == net.labels[int(total.argmax())] and abs(score - total.max() / total.sum()) < 1e-3


def test_the_sample_does_not_depend_on_where_rows_are_stored(spark):
    rows = [(i, f"text of language {i % 30} number {i} " * 3, f"l{i % 30}") for i in range(3000)]
    kind = "doc_id long, text string, lang string"
    a, b = (language.sample(spark.createDataFrame(x, kind).repartition(n), per_language=40, rows=600) for x, n in ((rows, 3), (rows[::-1], 7)))
    assert a == b and {y for _, y in a} == {f"l{k}" for k in range(30)} and len(a) <= 2 * 2 * 600


def test_missing_languages_are_filled(spark):
    en, de = "the house and the garden are on the hill ", "das haus und der garten sind auf dem berg "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(80)] + [(900, en * 3, None), (901, de * 3, None), (902, "12 34", None), (903, None, "en")]
    out = {r.doc_id: r.lang for r in language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (out[900], out[901]) == ("en", "de") and 902 not in out and 903 not in out and len(out) == 82
