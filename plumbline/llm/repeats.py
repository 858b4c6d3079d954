"""Substring dedup by repeated-phrase automata [operator 7].

Words covered by a window of WINDOW consecutive words that also stands in a
document with a smaller id are removed.

Documents with one and the same text count twice at most in what follows; further
copies take the result of the second.

1. Shortlist: each window is named by the least of its phrase hashes; names that
   two documents share mark the windows that can recur.
2. Confirm: the windows so marked are hashed whole; of those in two documents or
   more, the smallest id is the owner. Runs of owned windows are the passages.
3. Compile: passages are dealt into shards of bounded size. Owners that repeat passages
   of one smaller owner form its family, and a family shares a shard, or as many as
   its size needs. A shard's automaton (Aho-Corasick) holds a phrase of every STRIDE
   words of its passages, so each recurring window contains one whole phrase.
4. Stream: the texts that share a window with a shard's owners pass through its
   automaton, in chunks of bounded size; the windows around each hit are compared
   with the passages' own, and those of a smaller owner are spans to remove. Texts
   without a confirmed window hold no occurrence and skip this step.

Defined results: null and empty texts have no words and keep a null or empty
text. Rows of one id are one document: they remove nothing from each other. A
row with a null id is kept whole and owns nothing. Every row of the input gives
one row with all its columns; the added ones replace columns of the same name.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.workspace import keep, keep_result, split_near

WINDOW = 50
PHRASE = 8
STRIDE = WINDOW - PHRASE
#: Bytes of passages per automaton, and of texts per pass through one.
SHARD_BYTES, CHUNK_BYTES = 1 << 19, 1 << 22
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _windows(s: tk.Slice) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; and of each whole window: its first word, its name and its hash."""
    w = tk.words_of(s)
    h = tk.span_hash(tk.byte_sums(s.data), w.start, w.end)
    at = tk.whole_grams(w, WINDOW)
    if not len(at):
        return w, at, np.zeros(0, tk.U), np.zeros(0, tk.U)
    least = tk.gram_hash(h, PHRASE)
    width, reach = 1, WINDOW - PHRASE + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: -(reach - width)], least[reach - width :])
    return w, at, least[at], tk.gram_hash(h, WINDOW)[at]


def _first_of_runs(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return np.flatnonzero(new)


def _in_row(values: np.ndarray, row: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row."""
    own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    salt = tk.U(0xA24BAED4963EE407)
    listed = tk.mix(lists.flatten().to_numpy().view(np.uint64) + own.astype(tk.U) * salt)
    return np.isin(tk.mix(values + row.astype(tk.U) * salt), listed)


def _names(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                w, at, name, _ = _windows(s)
                new = _first_of_runs(w.row[at], name)
                ids = batch.column(0).slice(s.first, s.rows).take(pa.array(w.row[at][new]))
                yield pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), ids], names=["name", "id"])

    return texts.select("id", "text").mapInArrow(run, "name long, id long")


def _marked_windows(marked: DataFrame) -> DataFrame:
    """marked: id, text, names. Hash and id of each window whose name is listed."""

    def run(batches):
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                w, at, name, whole = _windows(s)
                hit = np.flatnonzero(_in_row(name, w.row[at], batch.column(2).slice(s.first, s.rows)))
                ids = batch.column(0).slice(s.first, s.rows).take(pa.array(w.row[at][hit]))
                yield pa.RecordBatch.from_arrays([pa.array(whole[hit].view(np.int64)), ids], names=["window", "id"])

    return marked.select("id", "text", "names").mapInArrow(run, "window long, id long")


def _passages(owned: DataFrame) -> DataFrame:
    """owned: id, text, windows. The words of each run of owned windows, joined by a space."""

    def run(batches):
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                w, at, _, whole = _windows(s)
                hit = at[_in_row(whole, w.row[at], batch.column(2).slice(s.first, s.rows))]
                covered = np.flatnonzero(tk.cover(hit, WINDOW, len(w)))
                if not len(covered):
                    continue
                breaks = np.flatnonzero((np.diff(covered) > 1) | (np.diff(w.row[covered]) > 0)) + 1
                data = s.data.tobytes()
                rows, texts = [], []
                for run_ in np.split(covered, breaks):
                    rows.append(w.row[run_[0]])
                    texts.append(b" ".join(data[a:b] for a, b in zip(w.start[run_].tolist(), w.end[run_].tolist(), strict=True)).decode())
                ids = batch.column(0).slice(s.first, s.rows).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["owner", "passage"])

    return owned.select("id", "text", "windows").mapInArrow(run, "owner long, passage string")


class PhraseAutomaton:
    """Locates the passages' windows in texts.

    The automaton finds whole phrases; only windows that contain one are looked up,
    each once, in a table of the passages' windows, and compared byte by byte. Work
    follows the number of words, however often a text repeats itself.
    """

    def __init__(self, passages: list[tuple[int, str]]):
        self.data: list[bytes] = []
        self.windows: dict[int, list[tuple[int, int, int, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for owner, passage in sorted(passages):  # so that the smallest owner of a window is met first
            words = passage.split(" ")
            for at in range(0, len(words) - PHRASE + 1, STRIDE):
                self.automaton.add_word(f" {' '.join(words[at : at + PHRASE])} ", PHRASE)
            data = _padded(words).encode()
            self.data.append(data)
            at = _spaces(data).tolist()
            for i in range(len(words) - WINDOW + 1):
                window = data[at[i] : at[i + WINDOW]]
                same = self.windows.setdefault(hash(window), [])
                if self._owner(same, window) is None:
                    same.append((owner, len(self.data) - 1, at[i], at[i + WINDOW]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _owner(self, places: list[tuple[int, int, int, int]], window: bytes) -> int | None:
        for owner, k, a, b in places:
            if self.data[k][a:b] == window:
                return owner
        return None

    def spans(self, owner_below: int, words: list[str]) -> list[tuple[int, int]]:
        """Word spans that windows of a smaller owner's passages cover."""
        if len(words) < WINDOW or not len(self.automaton):
            return []
        text = _padded(words)
        ends = np.array([end for end, _ in self.automaton.iter(text)], np.int64)
        if not len(ends):
            return []
        first = np.searchsorted(_spaces(text), ends) - PHRASE  # the space after word i is the (i + 1)th
        low = np.maximum(first - STRIDE, 0)
        high = np.minimum(first, len(words) - WINDOW)
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, low[low <= high], 1)
        np.add.at(step, high[low <= high] + 1, -1)
        data = text.encode()
        at = _spaces(data).tolist()
        hits = []
        for i in np.flatnonzero(np.cumsum(step) > 0).tolist():
            window = data[at[i] : at[i + WINDOW]]
            owner = self._owner(self.windows.get(hash(window), ()), window)
            if owner is not None and owner < owner_below:
                hits.append(i)
        return merged([(i, i + WINDOW) for i in hits])


def _padded(words: list[str]) -> str:
    return f" {' '.join(words)} "


def _spaces(text: str | bytes) -> np.ndarray:
    """Positions of the spaces of a padded text: in characters of a str, in bytes of bytes."""
    if isinstance(text, bytes):
        return np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _stream(passages: pa.Table, texts: pa.Table) -> pa.Table:
    """One shard's automaton over one chunk of texts."""
    automaton = PhraseAutomaton(list(zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist(), strict=True)))
    out = []
    for i, mark, text in zip(*(texts.column(c).to_pylist() for c in ("id", "mark", "text")), strict=True):
        out += [(i, mark, a, b) for a, b in automaton.spans(i, WORD.findall(text))]
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "mark", "start", "end"])


def _copies(texts: DataFrame) -> DataFrame:
    """(id, second): documents whose whole text two smaller ids have too, and the second of these.

    An owner of a window is at most the first, so all later copies lose the same words
    as the second: they share its result. Ids with several rows are not among them.
    """
    digests = keep(texts.select("id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    several = digests.groupBy("id").count().filter("count > 1").select("id")
    digests = digests.join(several, "id", "left_anti")
    low = digests.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    later = keep(digests.join(low, "digest").filter("id > low").select("digest", "id"), "later")
    second = later.groupBy("digest").agg(F.min("id").alias("second"))
    return later.join(second, "digest").filter("id > second").select("id", "second")


def _homes(passages: DataFrame, routes: DataFrame) -> DataFrame:
    """(owner, shard): small families share shards, large ones are spread over several."""
    sizes = passages.groupBy("owner").agg(F.sum(F.octet_length("passage")).alias("bytes"))
    root = routes.groupBy(F.col("id").alias("owner")).agg(F.min("owner").alias("root"))
    sizes = sizes.join(root, "owner", "left").select("owner", "bytes", F.coalesce("root", "owner").alias("family"))
    parts = F.ceil(F.sum("bytes") / SHARD_BYTES).alias("parts")
    sizes = sizes.join(sizes.groupBy("family").agg(parts), "family")
    total = passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    part = F.pmod(F.xxhash64("owner"), F.col("parts"))
    return sizes.select("owner", F.pmod(F.xxhash64("family", part), F.lit(max(1, -(-total // SHARD_BYTES)))).alias("shard"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, mark, spans): the word spans to remove, of texts that have some; mark is
    the text's hash, since an id may stand for several texts. Spans may overlap."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).na.drop()
    return keep_result(docs.sparkSession, lambda: _spans_of(texts), "spans")


def _spans_of(texts: DataFrame) -> DataFrame:
    further = keep(_copies(texts), "copies")
    near, names = split_near(keep(_names(texts), "names"), further)
    names = names.unionByName(near.join(further, "id", "left_anti"))
    shared = names.groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("name")
    of = keep(names.join(shared, "name").groupBy("id").agg(F.collect_set("name").alias("names")), "marks")
    marked = keep(split_near(texts, of)[0].join(of, "id"), "marked")

    windows = _marked_windows(marked)
    owner = windows.groupBy("window").agg(F.min("id").alias("owner"), F.max("id").alias("high")).filter("owner != high")
    owner = keep(owner.select("window", "owner"), "owners")
    routes = keep(windows.join(owner, "window").filter("id > owner").select("id", "owner").distinct(), "routes")
    owned = keep(owner.groupBy(F.col("owner").alias("id")).agg(F.collect_list("window").alias("windows")), "owned")
    passages = keep(_passages(split_near(marked, owned)[0].join(owned, "id")), "passages")

    homes = keep(_homes(passages, routes), "homes")
    routed = routes.join(homes, "owner").select("shard", "id").distinct().join(split_near(marked.select("id", "text"), routes)[0], "id")
    routed = keep(routed.withColumn("mark", F.xxhash64("text")), "routed")
    chunks = routed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / CHUNK_BYTES).cast("int").alias("chunks"))
    chunks = keep(chunks, "chunks")  # one row per shard
    copies = passages.join(homes, "owner").join(chunks, "shard")
    copies = copies.select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "owner", "passage")
    routed = routed.join(chunks, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "mark", "text")
    found = copies.groupBy("shard", "chunk").cogroup(routed.groupBy("shard", "chunk")).applyInArrow(_stream, "id long, mark long, start long, end long")
    spans = keep(found.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    return spans.unionByName(further.join(spans.withColumnRenamed("id", "second"), "second").select("id", "mark", "spans"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the repeated words cut out of their texts; adds n_words and n_removed."""
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*others).alias("row"))

    @F.pandas_udf("text string, n_words long, n_removed long")
    def trim(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_trimmed(t, s) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_words", "n_removed"])

    spans = repeated_spans(docs, id_col, text_col)
    near, rest = split_near(rows, spans)
    met = near.withColumn("mark", F.xxhash64("text")).join(spans, ["id", "mark"], "left").drop("mark").unionByName(rest.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    cut = met.select("row", trim("text", "spans").alias("cut"))
    columns = [F.col("cut.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return cut.select(*columns, "cut.n_words", "cut.n_removed")


def _trimmed(text: str | None, spans) -> tuple[str | None, int, int]:
    if text is None or spans is None:
        return text, len(WORD.findall(text or "")), 0
    words = [m.span() for m in WORD.finditer(text)]
    drop = merged([(s["start"], s["end"]) for s in spans])
    parts, at = [], 0
    for a, b in drop:  # the white space on the left of a cut keeps its neighbours apart
        parts.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*parts, text[at:]]), len(words), sum(b - a for a, b in drop)
