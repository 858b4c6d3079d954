"""Near-duplicates by a chosen-path set similarity join [operator 4].

A document is the set of its distinct word shingles. Sets that are equal fall
together by digest first. Each tree then branches the sets: a node chooses one
or two positions of the minhash signature, and a set goes on to the child named
by its minimum there. Nodes of at most SMALL sets are compared exhaustively;
larger ones are compared with a few pivots and branch further: inside one task
below LOCAL sets, by a shuffle above. Comparisons of signatures give candidate
pairs; links are confirmed on the full sets of 64-bit shingle hashes.

The first trees link each set with few others, and a set that a pivot is like
goes no further there. The components so found let the later trees skip pairs
that are joined already: a node of one component ends, and one in which at most
SMALL sets are outside the largest component compares those with all its sets,
so a large group of copies costs its size and not its square. What the later trees
compare with pivots, or with the sets outside, is confirmed in blocks: a few sets
against up to BLOCK others, each full set once in a block and not once in a pair,
and a set's link with a component is given once. The blocks of the nodes that one task
branches are merged, so a set is in few of them however many nodes it was in, and
is compared with the sets that it met in one of those. In the later trees
every other set of a larger node branches, whatever it is like. Those trees are
independent: a link between different components is missed only if all miss it.
Nodes that MAX_DEPTH choices did not part are compared in blocks, all with all.

Defined results: null and empty texts have no shingles and link with nothing;
fewer words than a shingle are one shingle together. Repeated rows of an id are
one document of the links: each such row carries the id's component. A row with
a null id has the component of the rows whose set equals its own, null if none of
them has an id; it links nothing. Other columns of the
input do not matter; the result has the id and its own columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.components import components
from plumbline.llm.workspace import keep, keep_result, split_near

SHINGLE = 5
SLOTS, ROOTS = 256, 16
FIRST_ROOTS = 6
#: Sets compared exhaustively, and sets (of about 300 bytes) whose node one task branches.
SMALL, LOCAL = 64, 1 << 17
PIVOTS = 4
#: Pairs whose signatures are compared at once.
ROWS = 1 << 16
MAX_DEPTH = 40
#: Sets on a side of a block, and their shingles together (a set of more is a side of its own).
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20

#: Candidates: a pair (a, b); or with a block's number, the set a of the block, on the side of the few or not,
#: and the numbers of what it was met in there: sets without one in common are not candidates.
CANDIDATES = "a long, b long, block long, few boolean, comp long, met array<int>"

#: Ids, components and sizes of sets.
Sets = tuple[np.ndarray, np.ndarray, np.ndarray]

_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 1 << 31, SLOTS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint64).astype(np.uint32)
_SALT = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64)


def shingles(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows end to end, and the rows' offsets."""
    data = tk.LOWER[s.data]
    w = tk.words_of(tk.Slice(s.first, data, s.offsets))
    h = tk.span_hash(tk.byte_sums(data), w.start, w.end)
    at = tk.whole_grams(w, SHINGLE)
    grams, row = tk.gram_hash(h, SHINGLE)[at], w.row[at]
    n = np.diff(w.row_at)
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
        own = h[w.row_at[r] : w.row_at[r + 1]]
        grams, row = np.append(grams, tk.gram_hash(own, len(own))), np.append(row, r)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(s.rows + 1))


def _signatures(grams: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The SLOTS minima of each row with shingles."""
    x = (grams >> tk.U(32)).astype(np.uint32)
    out = np.empty((SLOTS, int((n > 0).sum())), np.uint32)
    starts = at[:-1][n > 0]
    for j in range(SLOTS if len(starts) else 0):
        out[j] = np.minimum.reduceat(x * _MUL[j] + _ADD[j], starts)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n, a digest of the set (d1, d2), one byte per signature slot, and the roots' keys."""

    def run(batches):
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                grams, at = shingles(s)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = _signatures(grams, at, n)
                mixed = tk.mix(grams)
                d1, d2 = (np.diff(tk.prefix(v)[at]).view(np.int64) for v in (mixed, tk.mix(mixed + tk.U(1))))
                keys = [tk.mix(sig[j].astype(tk.U) + _SALT[j]).view(np.int64) for j in range(ROOTS)]
                small = np.zeros((s.rows, SLOTS), np.uint8)
                small[full] = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).T.astype(np.uint8)
                sizes = np.zeros(s.rows, np.int64)
                sizes[full] = ROOTS
                offsets = tk.prefix(sizes).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack(keys, 1).ravel() if len(full) else np.zeros(0, np.int64)))
                ids = batch.column(0).slice(s.first, s.rows)
                columns = [ids, pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in small], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d1", "d2", "sig", "roots"])

    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, sig binary, roots array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    first = column.offset and np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return data[first : first + len(column) * SLOTS].reshape(-1, SLOTS)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of the sets' similarity; a byte agrees by chance once in 256."""
    return ((a == b).mean(1) - 1 / 256) / (1 - 1 / 256)


def _similarities(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows a with the rows b, a bounded number of signatures at a time."""
    parts = [_similarity(sig[a[at : at + ROWS]], sig[b[at : at + ROWS]]) for at in range(0, len(a), ROWS)]
    return np.concatenate([np.zeros(0), *parts])


def _fit(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether sets of these sizes can be that similar at all."""
    return np.minimum(a, b) >= share * np.maximum(a, b)


def _exhaustive(node: np.ndarray, rows: np.ndarray, sig: np.ndarray, comp: np.ndarray, n: np.ndarray, least: float, share: float, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within equal, adjacent node numbers: of different components, all of
    them, or, if spanning, each set with the node's first and with its most similar one."""
    a, b, est = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for d in range(1, len(node)):
        i = np.flatnonzero(node[d:] == node[:-d])
        if not len(i):
            break
        i = i[(comp[rows[i]] != comp[rows[i + d]]) & _fit(n[rows[i]], n[rows[i + d]], share)]
        e = _similarities(sig, rows[i], rows[i + d])
        ok = e >= least
        a.append(i[ok])
        b.append(i[ok] + d)
        est.append(e[ok])
    a, b, est = map(np.concatenate, (a, b, est))
    if spanning and len(a):
        first = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
        use = first[np.searchsorted(first, a, "right") - 1] == a
        for end in (a, b):  # of a set's equally similar ones, the first
            order = np.lexsort((-est, end))
            use[order[np.concatenate([[True], np.diff(end[order]) > 0])]] = True
        a, b = a[use], b[use]
    return rows[a], rows[b]


def _best_pivot(est: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of the candidate pairs of members (rows) and pivots (columns), each member's best."""
    est = np.where(other, est, 0.0)
    best = np.zeros(est.shape, bool)
    if est.size:
        best[np.arange(len(est)), est.argmax(1)] = True
    return other & best


def _sides(n: np.ndarray) -> Iterator[slice]:
    """Runs of sets, of the given sizes, that are one side of a block."""
    total, at = tk.prefix(n), 0
    while at < len(n):
        end = int(np.searchsorted(total, total[at] + BLOCK_SHINGLES, "right")) - 1
        end = max(min(end, at + BLOCK), at + 1)
        yield slice(at, end)
        at = end


def _blocks(key: int, few: Sets, many: Sets, other: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The blocks that hold all candidate pairs of a node, `other` of many (rows) and few (columns)."""
    out, salt = [], tk.mix(np.array([key], np.int64).view(np.uint64))[0]
    for i in _sides(few[2]):
        wanted, met = np.flatnonzero(other[:, i].any(1)), np.flatnonzero(other[:, i].any(0)) + i.start
        for j in _sides(many[2][wanted]):
            rows = wanted[j]
            ids, comp = (np.concatenate([few[c][met], many[c][rows]]) for c in (0, 1))
            ends = np.array([ids[0], many[0][rows[0]]], np.int64).view(np.uint64)
            block = np.full(len(ids), tk.mix(tk.mix(ends[:1] + salt) + ends[1:]).view(np.int64)[0])
            out.append((ids, block, np.arange(len(ids)) < len(met), comp))
    return out


def _merged(key: int, blocks: list[tuple[np.ndarray, ...]], id_: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """As few blocks as hold the candidates of those given, in which a set stands once on a side; with
    the numbers of the given ones that it was in, as counts and end to end. n: sizes of the sets id_."""
    if not blocks:
        return []
    ids, _, few, comp = map(np.concatenate, zip(*blocks))
    number = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])
    order = np.argsort(id_)
    size = n[order][np.searchsorted(id_[order], ids)]

    def sides(rows: np.ndarray) -> Iterator[np.ndarray]:
        _, first, of = np.unique(ids[rows], return_index=True, return_inverse=True)
        by = np.argsort(first)  # what was met together stays together
        place = np.argsort(by)[of]
        for s in _sides(size[rows[first[by]]]):
            yield rows[(s.start <= place) & (place < s.stop)]

    out, salt = [], tk.mix(np.array([key], np.int64).view(np.uint64))[0]
    for i in sides(np.flatnonzero(few)):
        for j in sides(np.flatnonzero(~few & np.isin(number, number[i]))):
            at = np.concatenate([i[np.isin(number[i], number[j])], j])
            at = at[np.lexsort((number[at], ids[at], ~few[at]))]
            start = np.flatnonzero(np.append(True, (np.diff(ids[at]) != 0) | np.diff(few[at])))
            got, side = ids[at[start]], few[at[start]]
            ends = np.array([got[0], got[side.sum()]], np.int64).view(np.uint64)
            block = np.full(len(got), tk.mix(tk.mix(ends[:1] + salt) + ends[1:]).view(np.int64)[0])
            out.append((got, block, side, comp[at[start]], np.diff(np.append(start, len(at))), number[at]))
    return out


def _candidate_batch(a: np.ndarray, b: np.ndarray, blocks: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of CANDIDATES: pairs, then the sets of blocks."""
    ids, block, few, comp, count, number = map(np.concatenate, zip(*blocks)) if blocks else (np.zeros(0, np.int64),) * 6
    met = pa.ListArray.from_arrays(pa.array(tk.prefix(count).astype(np.int32)), pa.array(number, pa.int32()))
    join = lambda x, y, t: pa.concat_arrays([pa.array(x, t) if x is not None else pa.nulls(len(a), t), pa.array(y, t) if y is not None else pa.nulls(len(ids), t)])
    columns = [join(a, ids, pa.int64()), join(b, None, pa.int64()), join(None, block, pa.int64()), join(None, few.astype(bool), pa.bool_()), join(None, comp, pa.int64()), pa.concat_arrays([pa.nulls(len(a), met.type), met])]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "block", "few", "comp", "met"])


def _children(hashed: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Twice, of members with their nodes' hashes: which go on, and the child's key. A node
    chooses one position, and two of three nodes a second one: 5 / 3 on average. At a
    similarity of 0.75 that is 1.25 common children for a common node, so most pairs stay
    together in a tree however deep it is; with 1 / 0.75, fewer the deeper it is."""
    for turn in (0, 1):
        chosen = tk.mix(hashed + tk.U(turn + 1))
        slot = (chosen % tk.U(SLOTS)).astype(np.int64)
        child = tk.mix(hashed + _SALT[slot] + sig[np.arange(len(sig)), slot].astype(tk.U) * tk.U(0x9E3779B97F4A7C15)).view(np.int64)
        yield (turn == 0) | (chosen % tk.U(3) != 0), child


def _outside(comp: np.ndarray) -> np.ndarray:
    """Places that are not of the most frequent component."""
    values, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != count.argmax())


def _descend(key: int, rows: np.ndarray, id_: np.ndarray, sig: np.ndarray, comp: np.ndarray, n: np.ndarray, least: float, share: float, like: float, spanning: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[tuple[np.ndarray, ...]]]:
    """Branches one node down to small ones, as `_branch` does across tasks: the small nodes' rows; the
    pairs with pivots, if spanning; or else blocks with pivots, or with all sets outside the largest component."""
    leaves, left, right, blocks, stack, met = [], [], [], [], [(key, rows, 0)], set()
    while stack:
        key, own, depth = stack.pop()
        if len(own) < 2 or (comp[own] == comp[own[0]]).all():
            continue
        if len(own) <= SMALL or depth == MAX_DEPTH:
            leaves.append(own)
            continue
        outside = np.zeros(0, np.int64) if spanning else _outside(comp[own])
        ends = 0 < len(outside) <= SMALL
        pivots = own[outside] if ends else own[np.argsort(tk.mix(id_[own].view(np.uint64) + tk.U(key & 0xFFFFFFFFFFFFFFFF)), kind="stable")[:PIVOTS]]
        est = np.stack([_similarity(sig[own], sig[p]) for p in pivots], 1)
        other = (comp[pivots][None, :] != comp[own][:, None]) & (est >= least) & _fit(n[pivots][None, :], n[own][:, None], share)
        if spanning:
            i, j = np.nonzero(_best_pivot(est, other))
            left.append(own[i])
            right.append(pivots[j])
        else:
            blocks += _blocks(key, (id_[pivots], comp[pivots], n[pivots]), (id_[own], comp[own], n[own]), other)
        if ends:
            continue
        own = own[~(np.isin(own, pivots) | ((est >= like).any(1) & spanning))]
        hashed = np.full(len(own), tk.mix(np.array([key], np.int64).view(np.uint64))[0])
        for goes, child in _children(hashed, sig[own]):
            members, keys = own[goes], child[goes]
            order = np.argsort(keys, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part) > 1 and (k := int(keys[part[0]])) not in met:
                    met.add(k)
                    stack.append((k, members[part], depth + 1))
    return leaves, left, right, blocks


def _node_pairs(rows: DataFrame, least: float, share: float, like: float, spanning: bool, exhaustive: bool = False) -> DataFrame:
    """Candidates from nodes of at most LOCAL sets, branched down to SMALL ones unless `exhaustive`."""

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        key, id_, comp, n = (table.column(c).to_numpy() for c in ("key", "id", "comp", "n"))
        sig = _matrix(table.column("sig"))
        first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        size = np.diff(np.append(first, len(key)))
        whole = (size <= SMALL) | exhaustive
        small = np.repeat(whole, size)
        nodes, at, left, right, blocks = [np.flatnonzero(small)], [np.repeat(np.arange(len(size)), size)[small]], [], [], []
        for k in np.flatnonzero(~whole):
            leaves, a, b, more = _descend(int(key[first[k]]), np.arange(first[k], first[k] + size[k]), id_, sig, comp, n, least, share, like, spanning)
            left += a
            right += b
            own = slice(first[k], first[k] + size[k])
            blocks += _merged(int(key[first[k]]), more, id_[own], n[own])
            nodes += leaves
            at += [np.full(len(x), len(size) + len(at) + i) for i, x in enumerate(leaves)]
        a, b = _exhaustive(np.concatenate(at), np.concatenate(nodes), sig, comp, n, least, share, spanning)
        a, b = np.concatenate([a, *left]), np.concatenate([b, *right])
        # one pair can stand in several of a node's leaves
        a, b = np.divmod(np.unique(np.minimum(a, b) * len(key) + np.maximum(a, b)), len(key))
        return _candidate_batch(id_[a], id_[b], blocks)

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last node may go on in the next batch
            if cut:
                yield pairs_of(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield pairs_of(rest.combine_chunks())

    rows = rows.select("key", "id", "comp", "n", "sig").repartition("key").sortWithinPartitions("key", F.xxhash64("id"))
    return rows.mapInArrow(run, CANDIDATES)


def _branch(rows: DataFrame, least: float, share: float, like: float, spanning: bool) -> DataFrame:
    """For members of large nodes: candidates with the pivots of other components, and the
    children's keys (`child`), unless the node ends or, if spanning, a pivot is like the member."""

    def run(batches):
        for batch in batches:
            key, id_, comp, n = (batch.column(c).to_numpy() for c in ("key", "id", "comp", "n"))
            sig = _matrix(batch.column("sig"))
            pivots = batch.column("pivots")
            owner = np.repeat(np.arange(len(key)), np.diff(pivots.offsets.to_numpy()))
            flat = pivots.flatten()
            p_id, p_comp, p_n, p_sig = flat.field("id").to_numpy(), flat.field("comp").to_numpy(), flat.field("n").to_numpy(), _matrix(flat.field("sig"))
            est = _similarity(sig[owner], p_sig)
            done = np.zeros(len(key), bool)
            done[owner[((est >= like) & spanning) | (p_id == id_[owner])]] = True
            done |= batch.column("ends").to_numpy(zero_copy_only=False)
            other = (p_comp != comp[owner]) & (est >= least) & _fit(p_n, n[owner], share)
            place = np.arange(len(owner)) - pivots.offsets.to_numpy()[:-1][owner] + pivots.offsets.to_numpy()[0]
            most = int(place.max(initial=0)) + 1
            wide, mask = np.zeros((len(key), most)), np.zeros((len(key), most), bool)
            wide[owner, place], mask[owner, place] = est, other
            use, blocks = np.zeros(0, np.int64), []
            if spanning:
                use = np.flatnonzero(_best_pivot(wide, mask)[owner, place])
            else:  # the members of a node that meet the same pivots
                size = np.diff(pivots.offsets.to_numpy())
                start = tk.prefix(size)[:-1]
                same = tk.mix(tk.mix(key.view(np.uint64)) + p_id[start].view(np.uint64))
                _, first, group = np.unique(same, return_index=True, return_inverse=True)
                for g, r in enumerate(first):
                    own, few = np.flatnonzero(group == g), slice(start[r], start[r] + size[r])
                    more = _blocks(int(key[r]), (p_id[few], p_comp[few], p_n[few]), (id_[own], comp[own], n[own]), mask[own, : few.stop - few.start])
                    blocks += _merged(int(key[r]), more, np.append(p_id[few], id_[own]), np.append(p_n[few], n[own]))
            got = _candidate_batch(id_[owner[use]], p_id[use], blocks)
            yield got.append_column("child", pa.nulls(len(got), pa.int64()))
            (go_a, key_a), (go_b, key_b) = _children(tk.mix(key.view(np.uint64)), sig)
            keep_a, keep_b = go_a & ~done, go_b & ~done
            on = _candidate_batch(np.concatenate([id_[keep_a], id_[keep_b]]), None, [])
            yield on.append_column("child", pa.array(np.concatenate([key_a[keep_a], key_b[keep_b]])))

    return rows.mapInArrow(run, f"{CANDIDATES}, child long")


def _in_blocks(rows: DataFrame, slim: DataFrame, least: float, share: float, like: float, spanning: bool, block: int = 4096) -> DataFrame:
    """All candidates of the nodes' sets, whatever the nodes' sizes: each pair of blocks is compared in a task of its own."""
    nodes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("size > 1 and low != high")
    parts = nodes.select("key", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("own")
    met = rows.join(parts, "key").select("key", "id", own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    return _node_pairs(met.select(key, "id").join(slim, "id"), least, share, like, spanning, exhaustive=True)


def _candidates(sets: DataFrame, roots: range, least: float, share: float, like: float, spanning: bool) -> DataFrame:
    """CANDIDATES from the trees that begin at the given roots. sets: id, comp, n, sig, roots."""
    picked = F.array(*(F.element_at("roots", r + 1) for r in roots))
    rows = sets.select("id", "comp", F.explode(picked).alias("key"))
    slim = sets.select("id", "comp", "n", "sig")
    found = []
    for _ in range(MAX_DEPTH):
        pivots = F.array_distinct(F.array(*(F.min_by("id", F.xxhash64("id", F.lit(i), "key")) for i in range(PIVOTS)))).alias("pivots")
        nodes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), pivots)
        nodes = keep(nodes.filter("size > 1 and low != high"), "nodes")
        small = rows.join(nodes.filter(F.col("size") <= LOCAL).select("key"), "key").select("key", "id").join(slim, "id")
        found.append(_node_pairs(small, least, share, like, spanning))
        large = nodes.filter(F.col("size") > LOCAL)
        if large.isEmpty():
            break
        at = large.select("key", F.explode("pivots").alias("id"), F.lit(False).alias("ends"))
        if not spanning:  # where the sets outside the largest component are few, all of them are pivots
            count = rows.join(large.select("key"), "key").groupBy("key", "comp").agg(F.count("*").alias("own"))
            count = count.groupBy("key").agg(F.sum("own").alias("size"), F.max(F.struct("own", "comp")).alias("top"))
            ended = keep(count.filter(F.col("size") - F.col("top.own") <= SMALL).select("key", F.col("top.comp").alias("top")), "ended")
            outside = rows.join(ended, "key").filter("comp != top").select("key", "id", F.lit(True).alias("ends"))
            at = at.join(ended, "key", "left_anti").unionByName(outside)
        # PIVOTS at most, or an ended node's sets in parts
        part = F.when(F.col("ends"), F.pmod(F.xxhash64("id"), F.lit(SMALL // PIVOTS))).otherwise(0)
        at = at.join(slim, "id").groupBy("key", "ends", part.alias("part")).agg(F.collect_list(F.struct("id", "comp", "n", "sig")).alias("pivots"))
        members = rows.select("key", "id").join(slim, "id").join(at, "key")
        branched = keep(_branch(members, least, share, like, spanning), "branches")
        found.append(branched.filter("child is null").drop("child"))
        # children may be met along two paths
        rows = branched.filter("child is not null").select(F.col("a").alias("id"), F.col("child").alias("key")).distinct().join(slim.select("id", "comp"), "id")
    else:  # what MAX_DEPTH choices of positions did not part
        found.append(_in_blocks(rows, slim, least, share, like, spanning))
    got = found[0]
    for more in found[1:]:
        got = got.unionByName(more)
    ends = F.least("a", "b").alias("a"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("b")  # a set of a block has no b
    return got.select(*ends, "block", "few", "comp", "met").filter("b is null or a != b").distinct()


def _links_of(block: pa.Table, percent: int) -> pa.Table:
    """Links between the few and the many of a block, whose full sets are compared if they were met together
    (without `met`, all are): each of the few with one of each other component."""
    block = block.combine_chunks()
    id_, comp, few = (block.column(c).to_numpy() for c in ("a", "comp", "few"))
    grams = block.column("grams").combine_chunks()
    grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
    offsets = grams.offsets.to_numpy()
    n = np.diff(offsets)
    values, code = np.unique(grams.flatten().to_numpy(), return_inverse=True)
    offsets = offsets - offsets[0]
    few = few.astype(bool)
    number, at = np.zeros(len(few), np.int64), np.arange(len(few) + 1)
    if "met" in block.column_names:
        met = block.column("met").combine_chunks()
        met = met.chunk(0) if isinstance(met, pa.ChunkedArray) else met
        number, at = met.flatten().to_numpy(), met.offsets.to_numpy() - met.offsets[0].as_py()
    owner = np.repeat(np.arange(len(few)), np.diff(at))
    order = np.argsort(number, kind="stable")
    order = order[~few[owner[order]]]  # the many, by number
    keys = number[order]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(few):
        own = np.zeros(len(values), bool)
        own[code[offsets[i] : offsets[i + 1]]] = True
        of = number[at[i] : at[i + 1]]
        ends = np.searchsorted(keys, of, "left"), np.searchsorted(keys, of, "right")
        many = np.unique(np.concatenate([owner[order[x:y]] for x, y in zip(*ends)]))
        if not len(many):
            continue
        starts = tk.prefix(n[many])
        common = np.add.reduceat(own[code[np.repeat(offsets[many] - starts[:-1], n[many]) + np.arange(starts[-1])]], starts[:-1], dtype=np.int64)
        linked = np.flatnonzero((comp[many] != comp[i]) & (common > 0) & (100 * common >= percent * (n[i] + n[many] - common)))
        linked = many[linked[np.unique(comp[many[linked]], return_index=True)[1]]]
        a.append(np.full(len(linked), id_[i]))
        b.append(id_[linked])
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _confirm(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links among CANDIDATES: full sets share at least `percent` hundredths of their union."""
    pairs, blocks = found.filter("block is null").select("a", "b"), found.filter("block is not null").select("block", "a", "few", "comp", "met")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(blocks.select(F.col("a").alias("id")))
    wanted = keep(ids.distinct(), "wanted")

    def run(batches):
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                grams, at = shingles(s)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), lists], names=["id", "grams"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts, _ = split_near(texts, wanted)
    sets = keep(texts.join(wanted, "id", "left_semi").mapInArrow(run, "id long, grams array<long>"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    links = both.filter((common > 0) & (100 * common >= percent * union)).select("a", "b")
    blocks = blocks.join(sets.select(F.col("id").alias("a"), "grams"), "a")
    in_blocks = blocks.groupBy("block").applyInArrow(lambda block: _links_of(block, percent), "a long, b long")
    return keep(links.unionByName(in_blocks), "links")


def _linked(rows: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The component of each id with shingles; and, without an id, of each class (d1, d2, n) that rows without an id are in."""
    spark = docs.sparkSession
    like = percent / 100
    least = like - 4 * (like * (1 - like) / SLOTS) ** 0.5  # four standard deviations of the estimate
    full = rows.filter("n > 0")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    member = full.filter("id is not null").join(classes, ["d1", "d2", "n"]).select("id", "rep", "n", "sig", "roots")
    member = keep(member, "members")
    alone = keep(member.filter("id = rep").select("id", "n", "sig", "roots", F.col("id").alias("comp")).dropDuplicates(["id"]), "sets")

    def links(sets: DataFrame, roots: range, least: float, spanning: bool) -> DataFrame:
        pairs = keep_result(spark, lambda: _candidates(sets, roots, least, percent / 100, like, spanning), "pairs")
        return keep_result(spark, lambda: _confirm(pairs, docs, id_col, text_col, percent), "links")

    comp = components(links(alone, range(FIRST_ROOTS), percent / 100 - 0.05, True))
    sets = alone.drop("comp").join(comp, "id", "left").select("id", "n", "sig", "roots", F.coalesce("component", "id").alias("comp"))
    more = links(keep(sets, "sets"), range(FIRST_ROOTS, ROOTS), least, False)
    # one id may stand for several texts: it joins their classes
    several = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low != high")
    several = member.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # the later links join components of the first ones
    of = lambda end: F.coalesce(f"c{end}", end).alias(end)
    later = more.unionByName(several).join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    later = later.join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left").select(of("a"), of("b"))
    last = components(later)
    comp = comp.join(last.select(F.col("id").alias("component"), F.col("component").alias("_last")), "component", "left").select("id", F.coalesce("_last", "component").alias("component"))
    comp = keep(comp.unionByName(last.join(comp, "id", "left_anti")), "components")
    comp = comp.select(F.col("id").alias("rep"), "component")

    component = F.coalesce("component", "rep").alias("component_id")
    by_id = member.select("id", "rep").distinct().join(comp, "rep", "left").select("id", component).groupBy("id").agg(F.min("component_id").alias("component_id"))
    nameless = full.filter("id is null").select("d1", "d2", "n").distinct().join(classes, ["d1", "d2", "n"]).join(comp, "rep", "left").select("d1", "d2", "n", component)
    return by_id.unionByName(nameless, allowMissingColumns=True)


def link(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    rows = keep(sketch(docs, id_col, text_col), "sketches")
    of = keep_result(docs.sparkSession, lambda: _linked(rows, docs, percent, id_col, text_col), "component-of")
    known = rows.filter("id is not null").select("id", "n").join(of.filter("id is not null").select("id", "component_id"), "id", "left")
    nameless = rows.filter("id is null").join(of.filter("id is null").drop("id"), ["d1", "d2", "n"], "left")
    got = known.unionByName(nameless.select("id", "n", "component_id"))
    got = got.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def keep_rows(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the
    smallest id; of rows that repeat an id, one. Rows without an id all stay."""
    kept = link(docs, percent, id_col, text_col).filter(f"kept and `{id_col}` is not null").select(F.col(id_col).alias("kept_id")).distinct()
    own = Window.partitionBy("kept_id").orderBy(F.xxhash64(text_col))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("kept_id"), F.col(text_col).alias(text_col))
    once = rows.filter("kept_id is not null").join(kept, "kept_id", "left_semi").withColumn("own", F.row_number().over(own)).filter("own = 1").select("row")
    return once.unionByName(rows.filter("kept_id is null").select("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
