"""BPE encoding and decoding with a public vocabulary (tokenizers JSON, word ends marked in the symbols).

Merging keeps a priority queue of merge ranks over a doubly linked list of symbols and skips entries that have gone
stale; decoding joins the vocabulary's strings. Encoding is per document, so the job has no shuffle.

Defined cases: a null text counts as empty and gives no ids and an empty decoded text; a text of any length is encoded
whole, in n log n of its longest word; repeated rows give repeated results; an empty table gives an empty table; other
columns are never read. The strings of special tokens become their ids, as the library does.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.common import small_batches

#: Characters beyond these ranges change class or form with the version of Unicode; for them the library normalizes and
#: finds the words, so that its version decides.
LATER = regex.compile("[^\\x00-\u052f\u2000-\u206f]")
#: Entries that a worker remembers of each kind before it starts anew; a lookup saves time and changes no result.
REMEMBERED = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Remembers what make() gives for a key."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encodes to little-endian unsigned 32-bit ids and decodes them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for s, i in [*vocab.items(), *special.items()]:
            self.strings[i] = s
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        stand = byte_symbols()
        self.inner = [vocab[stand[b]] for b in range(256)]
        self.last = [vocab[stand[b] + end] for b in range(256)]
        #: Pair of ids to (rank, id of the merged symbol).
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.word_re = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalize, self.find = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte = {c: b for b, c in stand.items()}
        self.words, self.spaced = Words(self.word), Words(self.piece)

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = [(m[0] << 32) | i for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), 1 << 32)
            j = right[i]
            if symbols[i] < 0 or j >= n:
                continue
            m = merges.get((symbols[i], symbols[j]))
            if m is None or m[0] != rank:
                continue  # stale: one of the two symbols has been merged since
            symbols[i], symbols[j] = m[1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := merges.get((symbols[i], symbols[k])):
                    heapq.heappush(queue, (m[0] << 32) | i)
            h = left[i]
            if h >= 0 and (m := merges.get((symbols[h], symbols[i]))):
                heapq.heappush(queue, (m[0] << 32) | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return np.array(self.merge(symbols), "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Of a stretch without white space."""
        return b"".join([self.words[w] for w in self.found(piece)])

    def found(self, text: str) -> list[str]:
        if LATER.search(text):
            return [bytes([self.byte[c] for c in w]).decode() for w, _ in self.find(text)]
        return self.word_re.findall(text)

    def plain(self, text: str) -> bytes:
        """Of a text without special tokens. Lower-casing is by character, so a sigma has no final form."""
        if LATER.search(text):
            text = self.normalize(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if regex.search("[\x1c-\x1f]", text):  # split() takes these for white space, the vocabulary's pattern doesn't
            return self.piece(text)
        return b"".join(map(self.spaced.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.spaced) > REMEMBERED:
            self.spaced.clear()
        if not text:
            return b""
        if self.special_re is None or not self.special_re.search(text):
            return self.plain(text)
        return b"".join([self.special.get(p) or self.plain(p) for p in self.special_re.split(text)])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(text: Column, path: str) -> Column:
    """Struct of ids (binary, little-endian unsigned 32-bit) and decoded (string)."""

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for texts in batches:
            ids = [codec.encode(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], ["ids", "decoded"])

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that ids (binary) stand for; null counts as no ids."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for some in batches:
            yield pa.array([codec.decode(x or b"") for x in some.to_pylist()], pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, ids and decoded."""
    small_batches(docs.sparkSession)
    both = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), path).alias("r"))
    return both.select("doc_id", (F.octet_length("r.ids") / 4).cast("long").alias("n_tokens"), "r.ids", "r.decoded")
