"""Quality rules by repetition coverage [operator 10].

Rolling hashes of several n-gram lengths find the n-grams that occur twice or
more in a text; the share of its word characters inside them, and inside
repeated lines, decides. One pass over the documents, without a shuffle.

Defined results: a null or empty text has no words, all counts 0, and is
rejected. A text without words has shares of 0. Repeated rows give repeated
result rows. Other columns of the input do not matter; clashing names are
replaced by the result's (`measure` returns the id and its own columns only).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textkit as tk

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Largest shares that a kept text may have.

    `ngram_share`: n-gram length to the share of word characters inside n-grams
    of that length that occur twice or more, the first occurrence included.
    `line_share`: of word characters in lines that equal an earlier line.
    `symbols_per_word`: of symbols to words.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    ngram_share: dict[int, float] = field(default_factory=lambda: {4: 0.30, 8: 0.25, 12: 0.20})
    line_share: float = 0.30
    symbols_per_word: float = 0.50


def _measure(s: tk.Slice, rules: Rules) -> dict[str, np.ndarray]:
    w = tk.words_of(s)
    row_bytes = s.offsets
    inside = ~tk.SPACE[s.data]
    begins_char = (s.data & 0xC0) != 0x80
    chars = tk.prefix((inside & begins_char).astype(np.int64))
    word_chars = np.diff(chars[row_bytes])
    sums = tk.byte_sums(s.data)
    h = tk.span_hash(sums, w.start, w.end)
    chars_of = chars[w.end] - chars[w.start]
    out = {"n_words": np.diff(w.row_at), "word_chars": word_chars, "n_symbols": tk.row_sums(_SYMBOL[s.data], row_bytes)}

    # lines: cut at \n and at the rows' borders; an empty row has none that count
    cut = np.unique(np.concatenate([np.flatnonzero(s.data == 10) + 1, row_bytes[:-1], row_bytes[-1:]]))
    start = cut[:-1]
    end = cut[1:].copy()
    row = np.searchsorted(row_bytes, start, "right") - 1
    end[(end > start) & (s.data[np.maximum(end - 1, 0)] == 10)] -= 1
    line_chars = chars[end] - chars[start]
    full = line_chars > 0
    start, end, row, line_chars = start[full], end[full], row[full], line_chars[full]
    _, again = tk.repeated(tk.mix(tk.span_hash(sums, start, end) + row.astype(tk.U) * tk.U(0xA24BAED4963EE407)))
    out["n_dup_lines"] = np.bincount(row[again], minlength=s.rows)
    dup_line_chars = np.bincount(row[again], line_chars[again], s.rows)

    def inside_repeats(n: int) -> np.ndarray:
        at = tk.whole_grams(w, n)
        keys = tk.mix(tk.gram_hash(h, n)[at] + w.row[at].astype(tk.U) * tk.U(0xA24BAED4963EE407))
        many, _ = tk.repeated(keys)
        return tk.cover(at[many], n, len(w))

    out["n_repeat_words"] = tk.row_sums(inside_repeats(3), w.row_at)
    total = np.maximum(word_chars, 1)
    out["dup_line_share"] = dup_line_chars / total
    for n in rules.ngram_share:
        out[f"dup_{n}gram_share"] = tk.row_sums(np.where(inside_repeats(n), chars_of, 0), w.row_at) / total
    return out


def _verdicts(measured: DataFrame, rules: Rules) -> DataFrame:
    """Adds `base_failed` and `kept`."""
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    verdict = (F.col("dup_line_share") <= rules.line_share) & (F.col("n_symbols") <= rules.symbols_per_word * F.col("n_words"))
    for n, most in rules.ngram_share.items():
        verdict &= F.col(f"dup_{n}gram_share") <= most
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & verdict)


def _measured(docs: DataFrame, rules: Rules, text_col: str) -> DataFrame:
    """Rows (row, counts and shares): row is a struct of the input's columns."""
    shares = ["dup_line_share", *(f"dup_{n}gram_share" for n in rules.ngram_share)]
    names = COUNTS + shares

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            for s in tk.slices(row.field(text_col).cast(pa.string())):
                got = _measure(s, rules)
                columns = [row.slice(s.first, s.rows), *(pa.array(got[c], pa.int64()) for c in COUNTS), *(pa.array(got[c], pa.float64()) for c in shares)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *names])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType(rows.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in shares])
    return rows.mapInArrow(run, schema)


def measure(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the counts, the shares, `base_failed`, and `kept`."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = _verdicts(_measured(slim, rules, "text"), rules)
    return got.select(F.col("row.id").alias(id_col), *(c for c in got.columns if c != "row"))


def keep_rows(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns, in one pass."""
    got = _verdicts(_measured(docs, rules, text_col), rules).filter("kept")
    return got.select(*(F.col("row")[c].alias(c) for c in docs.columns))
