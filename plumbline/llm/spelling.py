"""Words, their spelling variants and roots, by rolling-hash deletions [operator 11].

Two words are near if one inserted, deleted or replaced code point parts them. Each
word gives a key for itself and one for each of its code points left out: prefix and
suffix polynomial hashes of all words of a batch give these keys by NumPy sums. Keys
are dealt to tasks by their highest bits and sorted there. Words that are equal
without their i-th code points stand under one key with one position, and replace
each other; a word stands under the same key as the words that are equal to it
without a code point. Strings are compared before anything counts. A task gives a
row per member of such a group, with its neighbours' number and the best of them, and
no pairs.

A word's form is its near word of largest count (ties: smallest in code-point order),
if that count is at least `ratio` times its own. Counts grow along forms, so a chain
of them is short; roots are found by pointer doubling.

Words of more than LONG code points do not travel with their keys: groups carry
numbers, and strings are joined to what stands in a group with others.

Defined results: null and empty texts have no words. Equal rows count each. A document
without an id is spoilt (`spoil`) as one whose id is the empty text. Without words the
result is empty. Other columns of the input do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.workspace import keep, keep_result

#: A maximal run of A-Z, a-z and U+00C0 to U+00FF, as UTF-8 with A-Z lowered.
RUN, OTHER = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+"), re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text whose runs are listed at once, and words that a task counts before it passes them on.
BLOCK, HELD = 1 << 22, 1 << 18
#: Code points of words that travel with their keys, code points hashed at once, and keys per task.
LONG, FLAT, KEYS = 64, 1 << 20, 1 << 18

_PRIME = (1 << 31) - 1
_SEEDS, _BASES = (0x5BD1E995, 0x9E3779B9), (1_284_865_837, 1_812_433_253)


# -- words and counts --------------------------------------------------------------


def _run_counts(data: bytes) -> Counter:
    """How often each run stands in a text."""
    out, at = Counter(), 0
    while at < len(data):
        cut = OTHER.search(data, at + BLOCK) if len(data) > at + BLOCK else None
        end = cut.start() if cut else len(data)
        out.update(RUN.findall(data, at, end))
        at = end
    return out


def _spoilt(run: bytes, seed: int, spoil: int) -> bytes:
    """The run, or the run without code point h % length if `spoil` divides its checksum h."""
    h = zlib.crc32(run, seed)
    if h % spoil:
        return run
    text = run.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, spoil: int = 0) -> DataFrame:
    """Rows (word, n): runs of letters of all texts, A-Z lowered.

    spoil: if given, plants misspellings: a run loses a code point where `spoil` divides
    the crc32 of `<id>:<run>`.
    """

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        long = pc.greater_equal(pc.utf8_length(words), min_length)
        n = pa.array(held.values(), pa.int64())
        return pa.RecordBatch.from_arrays([words.filter(long), n.filter(long)], names=["word", "n"])

    def count(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _run_counts(text.as_buffer().to_pybytes().lower())
                seed = zlib.crc32(f"{id_}:".encode())
                for run, n in own.items():
                    word = _spoilt(run, seed, spoil) if spoil else run
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")
    texts = docs.select(id_, F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -- deletion keys -----------------------------------------------------------------


def _symbols(points: np.ndarray, seed: int) -> np.ndarray:
    return tk.mix(points.astype(np.uint64) + np.uint64(seed)) % np.uint64(_PRIME - 1) + np.uint64(1)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word and code point: the word's number, the position, the key of the word without it,
    and whether it is the last of equal code points in a row (the others give the same
    text). A position of -1 is the word itself."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = tk.prefix(size)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - start[row]
    key, own = np.zeros(len(points), np.uint64), np.zeros(len(words), np.uint64)
    prime = np.uint64(_PRIME)
    for seed, base in zip(_SEEDS, _BASES, strict=True):
        power = tk.powers(base, int(size.max(initial=0)) + 1)
        symbol = _symbols(points, seed)
        before = tk.prefix(symbol * power[place] % prime)  # sums of symbol * base ** place
        after = tk.prefix(np.where(place > 0, symbol * power[place - 1] % prime, np.uint64(0)))  # the same, one place to the left
        left = before[:-1] - before[start[row]]
        right = after[start[row + 1]] - after[1:]
        key = key << np.uint64(31) | (left + right) % prime
        own = own << np.uint64(31) | (before[start[1:]] - before[start[:-1]]) % prime
    last = np.ones(len(points), bool)
    last[:-1] = (points[1:] != points[:-1]) | (row[1:] != row[:-1])
    return (
        np.concatenate([np.arange(len(words)), row]),
        np.concatenate([np.full(len(words), -1), place]),
        tk.mix(np.concatenate([own, key])),
        np.concatenate([np.ones(len(words), bool), last]),
    )


def _portions(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about FLAT code points; a longer word is one of its own."""
    ends = np.cumsum([len(w) for w in words])
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FLAT, "right")))
        yield at, end
        at = end


def _without(word: str, at: int) -> str:
    return word if at < 0 else word[:at] + word[at + 1 :]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _grouped_words(table: pa.Table) -> pa.Table:
    """One task's keys: a row (word, near, best_n, best) per member of each group of near words."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    run = _runs(key[order])
    order = order[np.bincount(run, minlength=1)[run] > 1]  # keys that stand alone have no neighbours
    rows = table.take(pa.array(order))
    pos, star, n = (rows.column(c).to_numpy() for c in ("pos", "star", "n"))
    words = rows.column("word").combine_chunks()
    text = words.to_pylist()
    # equal keys are a guess: what counts is the text that is left
    left = [_without(w, p) for w, p in zip(text, pos.tolist(), strict=True)]
    run = pa.array(left, pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    # place 0 is the word of largest count, then of least code points
    alphabetic = pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64)
    place = _dense(np.lexsort((alphabetic, -n)), alphabetic)

    out_row, out_near, out_best = [], [], []
    order = np.lexsort((place, pos, run))
    order = order[pos[order] >= 0]
    if len(order):  # replaced: the same text is left by the same position
        clique = _runs(run[order], pos[order])
        many = np.bincount(clique)
        first = np.searchsorted(clique, np.arange(len(many)))
        own = many[clique] > 1
        rank = np.arange(len(order)) - first[clique]
        best = order[np.minimum(first[clique] + (rank == 0), len(order) - 1)]
        out_row.append(order[own])
        out_near.append(many[clique][own] - 1)
        out_best.append(best[own])
    whole = np.full(int(run.max(initial=-1)) + 1, -1)
    whole[run[pos < 0]] = np.flatnonzero(pos < 0)
    order = np.lexsort((place, run))
    order = order[(pos[order] >= 0) & star[order] & (whole[run[order]] >= 0)]
    if len(order):  # inserted: a word equals what others leave
        near = np.bincount(run[order], minlength=len(whole))
        centre = np.flatnonzero(near)
        first = order[np.searchsorted(run[order], centre)]
        out_row += [order, whole[centre]]
        out_near += [np.ones(len(order), np.int64), near[centre]]
        out_best += [whole[run[order]], first]
    at, best = (pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (out_row, out_best))
    near = pa.array(np.concatenate([*out_near, np.zeros(0, np.int64)]).astype(np.int64))
    columns = [words.take(at), near, pa.array(n).take(best), words.take(best)]
    return pa.table(columns, names=["word", "near", "best_n", "best"])


def _dense(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places in an order; rows of equal `same`, neighbours in it, share one."""
    place = np.zeros(len(order), np.int64)
    place[order] = _runs(same[order])
    return place


def _near_short(words: DataFrame, keys: int) -> DataFrame:
    bits = max(0, (max(1, keys) // KEYS).bit_length())

    def run(batches):
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            text = words.to_pylist()
            for a, b in _portions(text):
                row, pos, key, star = deletion_keys(text[a:b])
                part = (key >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32)
                at = pa.array(row + a)
                columns = [pa.array(part), pa.array(key.view(np.int64)), pa.array(pos.astype(np.int16)), pa.array(star), words.take(at), n.take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "pos", "star", "word", "n"])

    keyed = words.select("word", "n").mapInArrow(run, "part int, key long, pos short, star boolean, word string, n long")
    return keyed.groupBy("part").applyInArrow(_grouped_words, "word string, near long, best_n long, best string")


def _near_long(words: DataFrame) -> DataFrame:
    """As _near_short, for pairs with a word of more than LONG code points."""
    words = keep(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "long_words")

    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).to_pylist()
            for a, b in _portions(text):
                row, pos, key, star = deletion_keys(text[a:b])
                own = (pos < 0) | (np.fromiter(map(len, text[a:b]), np.int64, b - a)[row] > LONG)
                columns = [ids.take(pa.array(row[own] + a)), pa.array(key[own].view(np.int64)), pa.array(pos[own].astype(np.int32)), pa.array(star[own])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "pos", "star"])

    keyed = keep(words.select("id", "word").mapInArrow(run, "id long, key long, pos int, star boolean"), "long_keys")
    gone = keyed.filter("pos >= 0")

    def with_words(rows: DataFrame, id_col: str, name: str) -> DataFrame:
        return rows.join(words.select(F.col("id").alias(id_col), F.col("word").alias(name), F.col("n").alias(f"{name}_n")), id_col)

    # replaced: each member is compared with the group's first, and then knows the best two
    first = gone.groupBy("key", "pos").agg(F.min("id").alias("first"), F.count("*").alias("many")).filter("many > 1")
    member = with_words(with_words(gone.join(first, ["key", "pos"]), "first", "a"), "id", "b")
    left = lambda c: F.concat(F.expr(f"substring({c}, 1, pos)"), F.expr(f"substring({c}, pos + 2)"))
    member = member.filter(left("a") == left("b")).select("key", "pos", F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("m"))
    group = member.groupBy("key", "pos").agg(F.sort_array(F.collect_list("m")).alias("ms")).filter(F.size("ms") > 1)
    best = F.when(F.col("m") == F.col("ms")[0], F.col("ms")[1]).otherwise(F.col("ms")[0])
    replaced = group.withColumn("m", F.explode("ms")).select("m.word", (F.size("ms") - 1).cast("long").alias("near"), (-best["less"]).alias("best_n"), best["word"].alias("best"))
    # inserted: a word and one that equals it without a code point
    whole = keyed.filter("pos < 0").select("key", F.col("id").alias("whole"))
    pair = with_words(with_words(gone.filter("star").join(whole, "key"), "whole", "a"), "id", "b").filter(F.col("a") == left("b"))
    one = F.lit(1).cast("long").alias("near")
    return replaced.unionByName(pair.select(F.col("a").alias("word"), one, F.col("b_n").alias("best_n"), F.col("b").alias("best"))).unionByName(
        pair.select(F.col("b").alias("word"), one, F.col("a_n").alias("best_n"), F.col("a").alias("best"))
    )


# -- forms and roots ---------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for links (word, form): each round doubles how far a link reaches."""
    links = keep(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left")
        links = keep(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for distinct words with their counts (word, n)."""

    def run() -> DataFrame:
        own = keep(words.select("word", "n").filter("word IS NOT NULL"), "words")
        size = F.length("word")
        sums = own.agg(F.sum(size + 1), F.coalesce(F.max(size), F.lit(0))).first()
        near = _near_short(own.filter(size <= LONG), sums[0] or 0)
        if sums[1] > LONG:
            near = near.unionByName(_near_long(own.filter(size >= LONG)))
        best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
        rows = own.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
        rows = rows.unionByName(near.withColumn("n", F.lit(None).cast("long")))
        rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("near"))
        is_form: Column = -F.col("near.less") >= ratio * F.col("n")
        rows = rows.select("word", "n", "n_near", F.when(is_form, F.col("near.word")).alias("form"), F.when(is_form, -F.col("near.less")).alias("form_n"))
        rows = keep(rows, "forms")
        roots = _roots(rows.filter("form IS NOT NULL"))
        return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return keep_result(words.sparkSession, run, "variants")
