"""Toxic spans by a linear-chain conditional random field [operator 1].

Labelled tokens: in the training documents labelled toxic, tokens carry label 1
if their word or one of its prefixes occurs in toxic documents far more often
than chance allows; all other tokens carry 0. A two-label chain is trained on
them (emissions by word and prefix, transitions, start). Forward-backward gives
each token's marginal; a document's score is a logistic function of its largest
marginal and of their sum, fitted on the same labelled documents. Offending offsets are runs of tokens whose marginal is at least 0.5.

The training rows are a bounded sample: `Limits.documents` labelled rows, in the
order of a hash of their id; of their windows of tokens, `Limits.windows` train the
chain. Every document is scored over its whole text.

Defined results: null and empty texts have no tokens, no spans, and the score of
marginals 0. Without labelled rows, or with one label only, the score is the
training rows' toxic share (0 without rows). Null labels and ids do not train.
Repeated rows are scored each; a repeated id trains once. Other columns of the
input do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from plumbline.llm import textkit as tk
from plumbline.llm.workspace import keep

#: Prefix lengths in bytes.
PREFIXES = (4, 5, 6, 7)
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Limits:
    """Bounds of training: labelled documents, words of evidence, windows of tokens."""

    documents: int = 4_000
    keys: int = 4_000
    windows: int = 12_000
    window: int = 64


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray
    row: np.ndarray
    keys: np.ndarray  # one row per kind of key: the word, then its prefixes


def tokens_of(s: tk.Slice) -> Tokens:
    data = tk.LOWER[s.data]
    w = tk.words_of(tk.Slice(s.first, data, s.offsets), _SEPARATOR)
    sums = tk.byte_sums(data)
    keys = [tk.span_hash(sums, w.start, w.end)]
    for k in PREFIXES:
        keys.append(tk.span_hash(sums, w.start, np.minimum(w.start + k, w.end)) + tk.U(k))
    return Tokens(w.start, w.end, w.row_at, w.row, np.stack(keys))


@dataclass
class Model:
    """keys: sorted hashes; weights: by key; chain: (bias, start, and the four
    transitions 00, 01, 10, 11); head: weights of the score; rate: used alone if head is None."""

    keys: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    head: np.ndarray | None
    rate: float

    def emissions(self, keys: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 that each token's own keys give."""
        out = np.full(keys.shape[1], self.chain[0])
        if len(self.keys):
            maybe = np.zeros(1 << 16, bool)
            maybe[self.keys >> tk.U(48)] = True
            for kind in keys:
                at = np.flatnonzero(maybe[kind >> tk.U(48)])
                place = np.minimum(np.searchsorted(self.keys, kind[at]), len(self.keys) - 1)
                hit = self.keys[place] == kind[at]
                np.add.at(out, at[hit], self.weights[place[hit]])
        return out

    def score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.head is None:
            return np.full(len(largest), self.rate)
        return 1 / (1 + np.exp(-np.clip(_inputs(largest, total) @ self.head, -40, 40)))


def _inputs(largest: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(largest)), largest, np.log1p(total), np.minimum(total, 1.0)], 1)


def marginals(emission: np.ndarray, row_at: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """P(label 1) of every token, by forward-backward over all rows at once.

    With two labels a message is one number, the ratio of its two entries.
    """
    t00, t01, t10, t11 = np.exp(chain[2:6])
    e = np.exp(np.clip(emission, -30, 30))
    size = np.diff(row_at)
    order = np.argsort(-size, kind="stable")
    first, last, size = row_at[:-1][order], row_at[1:][order] - 1, size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    fwd = np.empty(len(e))
    bwd = np.empty(len(e))
    for t, k in enumerate(alive):
        i, j = first[:k] + t, last[:k] - t
        if t == 0:
            fwd[i] = e[i] * np.exp(chain[1])
            bwd[j] = 1.0
        else:
            r = fwd[i - 1]
            fwd[i] = np.minimum(e[i] * (t01 + r * t11) / (t00 + r * t10), 1e30)
            q = np.minimum(e[j + 1] * bwd[j + 1], 1e30)
            bwd[j] = (t10 + t11 * q) / (t00 + t01 * q)
    odds = fwd * bwd
    return odds / (1 + odds)


# -- training ------------------------------------------------------------------


def _key_counts(t: Tokens, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of a slice, the rows that hold it, and the toxic ones among them."""
    keys, ns, hit = [], [], []
    for kind in t.keys:  # one kind at a time, for the memory
        order = np.lexsort((t.row, kind))
        flat, row = kind[order], t.row[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        flat, row = flat[new], row[new]
        own, at = np.unique(flat, return_index=True)
        keys.append(own)
        ns.append(np.diff(np.append(at, len(flat))))
        hit.append(np.add.reduceat(toxic[row].astype(np.int64), at) if len(at) else np.zeros(0, np.int64))
    return np.concatenate(keys), np.concatenate(ns), np.concatenate(hit)


def _places(keys: np.ndarray, t: Tokens) -> np.ndarray:
    """For each kind and token its key's place in the sorted keys, or their number."""
    place = np.minimum(np.searchsorted(keys, t.keys), len(keys) - 1)
    return np.where(keys[place] == t.keys, place, len(keys))


def _train_chain(row_at: np.ndarray, y: np.ndarray, place: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the keys and the chain, by gradient ascent on the penalised log-likelihood
    of windows of labelled tokens. place: a row for each kind of key; n_keys: no key."""
    firsts = np.zeros(len(y), bool)
    firsts[row_at[:-1]] = True
    pair = np.flatnonzero(~firsts)
    n = n_keys + 1
    theta = np.zeros(n + 6)
    theta[n] = -3.0
    step = np.zeros(len(theta))
    for _ in range(60):
        weights, chain = theta[:n].copy(), theta[n:]
        weights[-1] = 0
        emission = chain[0] + sum(weights[k] for k in place)
        p, two = _expected(emission, row_at, chain, pair)
        gap = y - p
        grad = np.zeros(len(theta))
        grad[:n] = sum(np.bincount(k, gap, n) for k in place)
        grad[n - 1] = 0
        grad[n] = gap.sum()
        grad[n + 1] = gap[firsts].sum()
        a, b = y[pair - 1], y[pair]
        seen = np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b])
        grad[n + 2 :] = (seen - two).sum(1)
        grad -= 0.5 * theta
        step += grad**2
        theta = theta + 0.5 * grad / np.sqrt(step + 1e-9)
    return theta[: n - 1], theta[n:]


def _expected(emission: np.ndarray, row_at: np.ndarray, chain: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token marginals, and the marginals of the four label pairs at each inner token."""
    p = marginals(emission, row_at, chain)
    # P(a, b) from the token marginals and the odds ratio, which the chain fixes per pair
    t = np.exp(chain[2:6])
    ratio = t[0] * t[3] / (t[1] * t[2])
    x, y = p[pair - 1], p[pair]
    if abs(ratio - 1) < 1e-9:
        both = x * y
    else:
        s = 1 + (x + y) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * x * y, 0))) / (2 * (ratio - 1))
    both = np.clip(both, 0, np.minimum(x, y))
    return p, np.stack([1 - x - y + both, y - both, x - both, both])


def _train_head(largest: np.ndarray, total: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    x = _inputs(largest, total)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (toxic - p) - 0.05 * w)
    return w


def _apply(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = marginals(model.emissions(t.keys), t.row_at, model.chain)
    total = np.bincount(t.row, p, len(t.row_at) - 1)
    largest = np.zeros(len(total))
    full = np.diff(t.row_at) > 0
    if full.any():
        largest[full] = np.maximum.reduceat(p, t.row_at[:-1][full])
    return largest, total, p


# -- on Spark ------------------------------------------------------------------


def may_train(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _evidence(rows: DataFrame, share: float, limits: Limits) -> np.ndarray:
    """Sorted keys that stand in toxic rows beyond chance (likelihood ratio against all keys
    tried). Tasks count by slice, Spark adds up; `limits.keys` keys reach the driver."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for s in tk.slices(batch.column(0)):
                keys, n, hits = _key_counts(tokens_of(s), toxic[s.first : s.first + s.rows])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(hits)], names=["key", "n", "hits"])

    counts = rows.select("text", "toxic").mapInArrow(run, "key long, n long, hits long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    counts = keep(counts, "evidence")
    least = float(np.log(counts.count() + 1) + 2)
    rate = F.col("hits") / F.col("n")
    part = lambda k, p: F.when(k > 0, k * F.log(k / F.col("n") / F.lit(p))).otherwise(0.0)
    gain = part(F.col("hits"), share) + part(F.col("n") - F.col("hits"), 1 - share)
    best = counts.withColumn("gain", gain).filter((rate > 2.5 * share) & (rate > 0.4) & (F.col("gain") > least))
    best = best.orderBy(F.desc("gain"), "key").limit(limits.keys).select("key").collect()
    return np.sort(np.array([r["key"] for r in best], np.int64).view(np.uint64))


def _windows(rows: DataFrame, keys: np.ndarray, limits: Limits) -> DataFrame:
    """Training windows of at most `limits.window` tokens: known (whether one of the keys is
    in it), the tokens' labels and their keys' places, as bytes."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(2).to_numpy(zero_copy_only=False)
            for s in tk.slices(batch.column(1)):
                t = tokens_of(s)
                place = _places(keys, t).astype(np.int32)
                known = (place < len(keys)).any(0)
                label = (known & toxic[s.first + t.row]).astype(np.uint8)
                parts = [np.arange(a, b, limits.window) for a, b in zip(t.row_at[:-1], t.row_at[1:], strict=True)]
                at = np.concatenate(parts).astype(np.int64)
                end = np.minimum(at + limits.window, t.row_at[1:][t.row[at]])
                touched = tk.prefix(known.astype(np.int64))
                columns = [
                    batch.column(0).slice(s.first, s.rows).take(pa.array(t.row[at])),
                    pa.array(at - t.row_at[:-1][t.row[at]]),
                    pa.array(touched[end] > touched[at]),
                    pa.array([label[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary()),
                    pa.array([place[:, a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "known", "label", "place"])

    return rows.select("id", "text", "toxic").mapInArrow(run, "id long, at long, known boolean, label binary, place binary")


def _chain(windows: DataFrame, n_keys: int, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """The chain fitted in one task, to `limits.windows` windows at most: half with keys, half without."""

    def train(table: pa.Table) -> pa.Table:
        rows = table.select(["label", "place", "id", "at"]).sort_by([("id", "ascending"), ("at", "ascending")])
        label = [np.frombuffer(x, np.uint8) for x in rows.column("label").to_pylist()]
        place = [np.frombuffer(x, np.int32).reshape(len(PREFIXES) + 1, -1) for x in rows.column("place").to_pylist()]
        row_at = tk.prefix(np.array([len(x) for x in label]))
        weights, chain = _train_chain(row_at, np.concatenate(label).astype(float), np.concatenate(place, 1), n_keys)
        return pa.table({"weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "chain": pa.array([chain.tolist()], pa.list_(pa.float64()))})

    order = (F.xxhash64("id", "at"), "id", "at")
    known, plain = (windows.filter(c).orderBy(*order).limit(limits.windows // 2) for c in ("known", "not known"))
    got = known.unionByName(plain).groupBy().applyInArrow(train, "weights array<double>, chain array<double>").first()
    return np.array(got["weights"]), np.array(got["chain"])


def _marks(rows: DataFrame, model: Model) -> DataFrame:
    """Per labelled row: its largest marginal, their sum, and the label."""

    def run(batches):
        for batch in batches:
            for s in tk.slices(batch.column(0)):
                largest, total, _ = _apply(model, tokens_of(s))
                yield pa.RecordBatch.from_arrays([pa.array(largest), pa.array(total), batch.column(1).slice(s.first, s.rows)], names=["largest", "total", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "largest double, total double, toxic boolean")


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on a bounded sample of the labelled rows that may train.

    Texts stay in tasks, whatever their length: keys are counted by Spark, the chain is
    fitted in one task to a bounded number of windows, and the driver gets bounded
    numbers of keys, weights and (largest, sum, label) rows.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).na.drop()
    known = known.filter(may_train(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(limits.documents)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), (F.max("toxic") > 0).alias("toxic"))
    rows = keep(rows, "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    rate = toxic / n if n else 0.0
    plain = Model(np.zeros(0, tk.U), np.zeros(0), np.array([-9.0, 0, 0, 0, 0, 0]), None, rate)
    if n < 4 or toxic in (0, n):
        return plain
    keys = _evidence(rows, rate, limits)
    if not len(keys):
        return plain
    weights, chain = _chain(_windows(rows, keys, limits), len(keys), limits)
    model = Model(keys, weights, chain, None, rate)
    marks = _marks(rows, model).collect()  # three numbers for each of at most limits.documents rows
    largest, total, label = (np.array([r[c] for r in marks], float) for c in ("largest", "total", "toxic"))
    model.head = _train_head(largest, total, label)
    return model


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
SPANS_DDL = "array<struct<start:int,end:int,marginal:double>>"


def _spans(s: tk.Slice, t: Tokens, p: np.ndarray) -> pa.Array:
    """Runs of tokens whose marginal is at least 0.5, in characters of their rows."""
    spans: list[list[dict]] = [[] for _ in range(s.rows)]
    hot = np.flatnonzero(p >= 0.5)
    if len(hot):
        chars = tk.prefix((s.data & 0xC0) != 0x80)
        breaks = np.flatnonzero((np.diff(hot) > 1) | (np.diff(t.row[hot]) > 0)) + 1
        for run in np.split(hot, breaks):
            r = t.row[run[0]]
            base = chars[s.offsets[r]]
            spans[r].append({"start": chars[t.start[run[0]]] - base, "end": chars[t.end[run[-1]]] - base, "marginal": float(p[run].max())})
    return pa.array(spans, SPANS)


def _tagged(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """Rows (row, score, spans): row is a struct of the input's columns."""

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            for s in tk.slices(row.field(text_col).cast(pa.string())):
                t = tokens_of(s)
                largest, total, p = _apply(model, t)
                columns = [row.slice(s.first, s.rows), pa.array(model.score(largest, total)), _spans(s, t, p)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "score", "spans"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(run, StructType(rows.schema.fields + DataType.fromDDL(f"score double, spans {SPANS_DDL}").fields))


def tag(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted, and spans of (start, end, marginal) in characters."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return _tagged(slim, model, "text").select(F.col("row.id").alias(id_col), "score", predicted, "spans")


def keep_rows(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns, in one pass."""
    got = _tagged(docs, model, text_col).filter(F.col("score") < threshold)
    return got.select(*(F.col("row")[c].alias(c) for c in docs.columns))
