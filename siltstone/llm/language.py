"""Language identification by a byte convolutional network in numpy.

Bytes are read as classes (letters without case, each lead and continuation byte of UTF-8 by itself, white space and
the other ASCII as one each) with an embedding. Filters of widths 2, 3 and 4 run over windows of WINDOW bytes; each
filter's maximum over the window goes through a rectifier into a softmax over the languages. A text is all its windows,
its score the mean of their softmax, weighted by their length.

Training is on the driver, on a bounded sample of labelled rows: PER_LANGUAGE rows of each language in expectation, or an equal
share of ROWS where there are more languages than these allow, and twice ROWS at most, chosen by a hash of the id, of which WINDOWS windows each are read. Only rows that are not held out are
seen. The network itself (some 100 kB) goes to the workers, which apply it to batches of windows. In applying, a filter
of width w is a sum of looked-up rows, one for each pair of byte classes, which is the same product as with the embedding.

Defined cases: `und` with score 0 for a null text and one without a letter; texts are read whole; with no labelled row
at all, everything is `und`; repeated rows give repeated results; empty tables give empty tables; other columns are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import held_out, small_batches

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 10
#: The bound of the training sample: rows expected of a language, rows in all, windows read of a row.
PER_LANGUAGE, ROWS, WINDOWS = 1000, 8000, 2
EPOCHS, BATCH, RATE = 12, 64, 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Windows taken through the network at a time.
AT_ONCE = 64


def byte_classes() -> np.ndarray:
    """uint8 to class; class 0 is padding and white space."""
    out = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b).lower()
        out[b] = 0 if c in " \t\n\r\x0b\x0c" else 2 + ord(c) - 97 if "a" <= c <= "z" else 1
    out[128:] = 28 + np.arange(128)
    return out


CLASSES = byte_classes()
N_CLASSES = int(CLASSES.max()) + 1


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all windows (the last one padded) and the bytes in each."""
    raw = CLASSES[np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-8", "replace"), np.uint8)]
    n = max(1, -(-len(raw) // WINDOW))
    padded = np.zeros(n * WINDOW, np.int64)
    padded[: len(raw)] = raw
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), sizes


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # classes x e
    filters: list[np.ndarray]  # per width: w x e x f
    bias: np.ndarray  # all filters
    dense: np.ndarray  # all filters x labels
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter, what a byte class adds to its sum."""
        return [[(self.embedding @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of windows: the filters' maxima and where they are."""
        best, where = [], []
        for t in tables:
            n = x.shape[1] - len(t) + 1
            total = t[0][x[:, :n]]
            for k in range(1, len(t)):
                total += t[k][x[:, k : k + n]]
            where.append(total.argmax(axis=1))
            best.append(np.take_along_axis(total, where[-1][:, None, :], 1)[:, 0])
        return np.concatenate(best, axis=1) + self.bias, where

    def pairs(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width, the tables whose rows add up to a filter's sum: place, whether by pair of classes, table."""
        out = []
        for t in self.tables():
            both = [(k, True, (t[k][:, None] + t[k + 1][None]).reshape(-1, FILTERS)) for k in range(0, len(t) - 1, 2)]
            out.append(both + [(len(t) - 1, False, t[-1])] * (len(t) % 2))
        return out

    def maxima(self, x: np.ndarray, pairs: list[list[tuple[int, bool, np.ndarray]]]) -> np.ndarray:
        """pooled() without the places."""
        codes = x[:, :-1] * N_CLASSES + x[:, 1:]
        best = []
        for w, t in zip(WIDTHS, pairs, strict=True):
            n = x.shape[1] - w + 1
            total = None
            for k, pair, table in t:
                part = table.take((codes if pair else x)[:, k : k + n], axis=0, mode="clip")
                total = part if total is None else np.add(total, part, out=total)
            size = n
            while size > 1:  # halving: a maximum over long rows instead of over a short axis
                half = size // 2
                np.maximum(total[:, :half], total[:, size - half : size], out=total[:, :half])
                size -= half
            best.append(total[:, 0])
        return np.concatenate(best, axis=1) + self.bias

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]], seed: int = 7) -> Network | None:
    """samples: window texts and their languages. Adam on the cross-entropy; each language weighs the same."""
    labels = sorted({y for _, y in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    x = np.stack([windows(t)[0][0] for t, _ in samples])
    y = np.array([labels.index(v) for _, v in samples])
    weight = (len(y) / len(labels) / np.bincount(y, minlength=len(labels)))[y]
    n = FILTERS * len(WIDTHS)
    net = Network(labels, rng.normal(0, 0.5, (N_CLASSES, EMBEDDING)), [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS], np.zeros(n), rng.normal(0, n**-0.5, (n, len(labels))), np.zeros(len(labels)))
    net.embedding[0] = 0
    params = [net.embedding, *net.filters, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            i = order[at : at + BATCH]
            pooled, where = net.pooled(x[i], net.tables())
            p = net.softmax(pooled)
            p[np.arange(len(i)), y[i]] -= 1
            p *= weight[i, None] / len(i)
            hidden = np.maximum(pooled, 0)
            back = (p @ net.dense.T) * (pooled > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[-3], grads[-2], grads[-1] = back.sum(axis=0), hidden.T @ p, p.sum(axis=0)
            for j, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    seen = np.take_along_axis(x[i], where[j] + k, 1)  # batch x filters: the class under place k of each maximum
                    grads[1 + j][k] = np.einsum("bfe,bf->ef", net.embedding[seen], g)
                    np.add.at(grads[0], seen, g[:, :, None] * f[k].T[None])
            step += 1
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            net.embedding[0] = 0
    return net


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> list[tuple[str, str]]:
    """Windows of labelled rows that are not held out; of rare languages all rows, of others a share by hash. A window
    starts anywhere in its text, so only pieces of a bounded length come to the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows // 8).collect()
    if not counts:
        return []
    each = min(per_language, rows // len(counts))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, each / r["count"]))])
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    at = lambda i: F.substring("text", (F.floor(draw(i) * F.greatest(F.length("text") - WINDOW, F.lit(0))) + 1).cast("int"), WINDOW)
    taken = known.filter(draw("row") < F.element_at(share, F.col("lang"))).select("lang", draw("row").alias("draw"), *[at(f"window {i}").alias(f"w{i}") for i in range(WINDOWS)])
    found = taken.orderBy("draw", "w0").limit(2 * rows).collect()  # by hash, so where a language is stored plays no part
    return sorted((r[f"w{i}"], r["lang"]) for r in found for i in range(WINDOWS) if LETTER.search(r[f"w{i}"]))


class Model:
    """Scores texts batch by batch."""

    def __init__(self, net: Network | None):
        self.net = net
        self.pairs = net.pairs() if net else []

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if self.net is None:
            return out
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        total = np.zeros((len(texts), len(self.net.labels)))
        queue: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for i in at:
            x, sizes = windows(texts[i])
            for k in range(0, len(x), AT_ONCE):
                queue.append((i, x[k : k + AT_ONCE], sizes[k : k + AT_ONCE]))
                held += len(queue[-1][1])
                if held >= AT_ONCE:
                    self.flush(queue, total)
                    queue, held = [], 0
        if queue:
            self.flush(queue, total)
        for i in at:
            best = int(total[i].argmax())
            out[i] = (self.net.labels[best], float(total[i, best] / total[i].sum()))
        return out

    def flush(self, queue: list[tuple[int, np.ndarray, np.ndarray]], total: np.ndarray) -> None:
        p = self.net.softmax(self.net.maxima(np.concatenate([x for _, x, _ in queue]), self.pairs))
        np.add.at(total, np.repeat([i for i, *_ in queue], [len(x) for _, x, _ in queue]), p * np.concatenate([s for *_, s in queue])[:, None])


def predicted(text: Column, net: Network | None) -> Column:
    """Struct of lang_pred and score."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(net)
        for texts in batches:
            found = model.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])

    return run.asNondeterministic()(text)  # else a filter on the result would run it twice


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    return train(sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score, by net or else a network fitted on docs."""
    small_batches(docs.sparkSession)
    net = net or fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), predicted(F.col(text_col), net).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language was found: those that are `und` go, and a null lang gives way to the one found."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predicted(F.col("text"), fit(docs))["lang_pred"].alias("found"))
    lang = F.coalesce("row.lang", "found").alias("lang")
    return rows.filter(F.col("found") != UNKNOWN).select(*[lang if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
