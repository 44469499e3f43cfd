"""Quality rules, line first: rules of punctuation, navigation and boilerplate judge each line, lines that fail are
removed, and a document that loses too much of its text is rejected. Beside it, measures of the whole document.

Everything is per document, without a shuffle, in one pass of batches through Python.

Defined cases: a null text counts as empty, has no words and fails; texts are judged whole; repeated rows give repeated
results; empty tables give empty tables; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 8
#: A document is rejected if it loses more of its words than this.
LOSS = 0.5
BOILERPLATE = re.compile(
    rb"all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies"
    rb"|lorem ipsum|enable javascript|subscribe to (?:our|the)|sign up for|click here|skip to (?:main )?content",
)
NAVIGATION = re.compile(rb"^(?:home|menu|search|login|log in|sign in|register|next|previous|back|share|print|read more|top)$")
ENDING = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*$")
INNER = re.compile(r"[.,;:!?…]")
KINDS = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, kept_text: string, kept_words: long, lines_failed: long>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """The words inside windows whose content is found at least twice. Exact: windows are numbered by doubling."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < window:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        span *= 2
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def line_fails(line: str, words: list[bytes]) -> str | None:
    """The rule that a line with words fails, if any."""
    n, chars = len(words), sum(map(len, words))
    low = line.lower().strip(SPACES)
    bars = line.count("|") + line.count("»") + line.count("›")
    if bars >= 3 and bars * 6 >= n or n <= 3 and NAVIGATION.match(low.encode()):
        return "navigation"
    if n <= 30 and BOILERPLATE.search(low.encode()):
        return "boilerplate"
    symbols = sum(map(line.count, SYMBOLS))
    if symbols * 10 > chars or line.count("!") * 3 > n >= 3:
        return "punctuation"
    if n >= 10 and not ENDING.search(line.rstrip(SPACES)) and not INNER.search(line):
        return "punctuation"
    letters = [c for c in line if c.isalpha()] if line.isupper() else []
    if n >= 5 and len(letters) >= 20:
        return "capitals"
    if n >= 10 and len(set(words)) * 4 < n:
        return "repetition"
    return None


def clean(text: str) -> tuple[list[str], int, int]:
    """The lines that stay, the words in them and how many lines failed. Lines without words stay."""
    kept, n, failed = [], 0, 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if words and line_fails(line, words):
            failed += 1
        else:
            kept.append(line)
            n += len(words)
    return kept, n, failed


def measure(text: str | None) -> dict:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: ASCII white space
    full = [x for x in raw.split(b"\n") if x.strip()]
    kept, n, failed = clean(text)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": repeated_words(words), "kept_text": "\n".join(kept), "kept_words": n, "lines_failed": failed,
    }


def measured(text: Column) -> Column:
    @F.arrow_udf(KINDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = pa.struct([(k, pa.string() if k == "kept_text" else pa.int64()) for k in measure(None)])
        for texts in batches:
            yield pa.array([measure(t.as_py()) for t in texts], kinds)

    return run(text)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: float = LOSS) -> DataFrame:
    """Per row: doc_id, the measures, kept_text (the lines that stay), kept_words, lines_failed, base_failed and kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_words") >= (1 - loss) * F.col("n_words")))
