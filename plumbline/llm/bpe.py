"""BPE encoding and decoding of whole texts [operator 5], and the byte BPE of packing.

Ids equal those of the `tokenizers` library. Texts longer than a leaf go by tree
concatenation: the unsplit text is halved down to leaves, wherever that cuts, all
leaves of a slice are encoded side by side (each distinct unit once), and
neighbours are joined pairwise. At each join a window around it, from white space
to white space, is encoded again as one text, and each of its sides alone; it grows
until the outermost tokens of the window are those of the sides, which must stand
at the ends of what is joined. White space always parts tokens, so this is exact.

Texts with a stretch of LONG characters without white space are cut and encoded in
parallel tasks instead, and joined byte by byte: the window grows by tokens until
its outermost ones agree with both sides. A token sequence in which each adjacent
pair is its own encoding is the encoding of the whole, so this is exact too.

Defined results: null counts as the empty text and gives no ids. Repeated rows
give repeated results, a null id stays. Other columns of the input do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import textkit as tk

#: Text per slice: the more, the fewer units are encoded again.
SLICE = 8 << 20
#: Unsplit characters from which a stretch is long, and bytes of a leaf.
LONG, LEAF = 8192, 2048
#: Characters on either side of a join that are encoded again at first.
REACH = 48
#: Characters whose classes all the engines agree on, so that the fast paths hold.
_BEFORE_WORD = re.compile(r"[ \t\r\n](?=[^ \t\r\n])")
_LATIN = "[^\\x{1}-\\x{12f}\\x{131}-\\x{24f}]"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _gather(values: pa.ListArray, index: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists picked by index, laid end to end; and where each row's begin."""
    sizes = np.diff(values.offsets.to_numpy())
    ends = tk.prefix(sizes[index])
    return values.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False), ends[row_at]


def _lists(encoded: list) -> pa.ListArray:
    offsets = tk.prefix(np.fromiter(map(len, encoded), np.int64, len(encoded))).astype(np.int32)
    flat = np.fromiter((t for ids in encoded for t in ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class _Bpe:
    """Encodes string columns. Subclasses say which rows are simple, and how units are encoded."""

    def __init__(self, path: str):
        self.spec = json.load(open(path, encoding="utf-8"))
        self.reference = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in self.spec["added_tokens"]]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.reference.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows laid end to end, and the rows' offsets among them."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        simple = self.simple(column).to_numpy(zero_copy_only=False)
        text = column if simple.all() else pc.if_else(pa.array(simple), column, "")
        words = pc.split_pattern(self.prepared(text), " ")
        flat = words.flatten().dictionary_encode()
        row_at = words.offsets.to_numpy()
        row_at = row_at - row_at[0]
        index = flat.indices.to_numpy()
        ids, offsets = self.units(flat.dictionary.to_pylist(), index, row_at)
        if simple.all():
            return ids, offsets
        rows = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i in np.flatnonzero(~simple):
            rows[i] = self.odd(column[int(i)].as_py())
        return np.concatenate(rows), tk.prefix(np.array([len(r) for r in rows], np.int64))

    def _has_special(self, column: pa.Array) -> pa.Array:
        found = pc.match_substring(column, self.specials[0])
        for s in self.specials[1:]:
            found = pc.or_(found, pc.match_substring(column, s))
        return found


class ByteBpe(_Bpe):
    """Byte-level BPE whose pre-tokenizer cuts before a single space."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = byte_alphabet()
        special = {t["content"] for t in self.spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def prepared(self, column: pa.Array) -> pa.Array:
        return column

    def simple(self, column: pa.Array) -> pa.Array:
        # a space next to white space can be part of a longer run; such rows are encoded whole
        run = pc.match_substring_regex(column, r"  | \z|[\t-\r] [\t-\r]|[\x1c-\x1f\x{85}\x{a0}]|" + _LATIN)
        return pc.invert(pc.or_(run, self._has_special(column)))

    def odd(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials) or not text.isascii():
            return self.whole(text)
        return np.array(self.core.encode_ordinary(text), np.int32)

    def encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), but the strings of special tokens are ordinary text."""
        self.reference.encode_special_tokens = True
        try:
            return self.encode(column)
        finally:
            self.reference.encode_special_tokens = False

    def units(self, distinct: list[str], index: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = row_at[:-1][np.diff(row_at) > 0]  # each row's first unit has no space before it
        heads, place = np.unique(index[first], return_inverse=True)
        encode = self.core.encode_ordinary
        table = _lists([encode(" " + u) for u in distinct] + [encode(distinct[h]) for h in heads])
        index = index.copy()
        index[first] = len(distinct) + place
        return _gather(table, index, row_at)


class WordBpe(_Bpe):
    """Lower-casing BPE whose words end in a suffix and whose white space is dropped.

    The suffix is a zero byte here: the pair of a byte and the zero byte merges
    before all else, which is how the suffix model begins.
    """

    def __init__(self, path: str):
        super().__init__(path)
        letters = byte_alphabet()
        self.byte_of = letters
        suffix = self.spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in self.spec["added_tokens"]}
        vocab = self.spec["model"]["vocab"]

        def as_bytes(token: str) -> bytes:
            end = b"\0" if token.endswith(suffix) and len(token) > len(suffix) else b""
            return bytes(map(letters.__getitem__, token[: len(token) - len(suffix)] if end else token)) + end

        known = {as_bytes(t): i for t, i in vocab.items() if t not in special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in self.spec["model"]["merges"])
        order = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)] + [as_bytes(a + b) for a, b in merges]
        ranks = {t: i for i, t in enumerate(dict.fromkeys(order))}
        self.real = np.full(len(ranks), -1, np.int32)
        for t, i in ranks.items():
            self.real[i] = known.get(t, -1)
        self.text_of = list(ranks)
        self.core = tiktoken.Encoding("word", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in self.spec["added_tokens"]}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())

    def prepared(self, column: pa.Array) -> pa.Array:
        return pc.utf8_lower(column)

    def simple(self, column: pa.Array) -> pa.Array:
        return pc.invert(pc.or_(pc.match_substring_regex(column, _LATIN), self._has_special(column)))

    def odd(self, text: str) -> np.ndarray:
        return self.whole(text)

    def units(self, distinct: list[str], index: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x{85}\x{a0}\p{L}\p{N}]+)"
        marked = pc.replace_substring_regex(pa.array(distinct, pa.large_string()), word, "\\1\0")
        encode = self.core.encode_ordinary
        table = _lists([encode(u) for u in pc.replace_substring_regex(marked, r"[\t-\r \x{85}\x{a0}]+", "").to_pylist()])
        ids, offsets = _gather(table, index, row_at)
        return self.real[ids], offsets

    # -- tree concatenation ------------------------------------------------

    def tree(self, column: pa.Array, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), texts of more than `leaf` characters by tree concatenation."""
        texts = [halves(t or "", leaf) for t in column.to_pylist()]
        at = tk.prefix(np.array([len(t) for t in texts], np.int64))
        ids, offsets = self.encode(pa.array([x for t in texts for x in t], pa.large_string()))
        many = np.flatnonzero(np.diff(at) > 1)
        if not len(many):
            return ids, offsets
        parts = [[ids[offsets[k] : offsets[k + 1]] for k in range(at[i], at[i + 1])] for i in many]
        whole = dict(zip(many.tolist(), self.grown([texts[i] for i in many], parts), strict=True))
        rows = [whole[i] if i in whole else ids[offsets[at[i]] : offsets[at[i + 1]]] for i in range(len(texts))]
        return np.concatenate(rows), tk.prefix(np.array([len(r) for r in rows], np.int64))

    def grown(self, texts: list[list[str]], ids: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Joins neighbours pairwise until each text is one sequence; all joins of a level at once."""
        while any(len(t) > 1 for t in texts):
            pairs = [(x, y, a, b) for t, i in zip(texts, ids, strict=True) for x, y, a, b in zip(t[::2], t[1::2], i[::2], i[1::2], strict=False)]
            joined = iter(self.concatenated(pairs))
            ids = [[next(joined) for _ in range(len(t) // 2)] + i[len(t) // 2 * 2 :] for t, i in zip(texts, ids, strict=True)]
            texts = [[x + y for x, y in zip(t[::2], t[1::2], strict=False)] + t[len(t) // 2 * 2 :] for t in texts]
        return [i[0] for i in ids]

    def concatenated(self, pairs: list[tuple[str, str, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of each x + y from those of x and of y."""
        out: list[np.ndarray | None] = [None] * len(pairs)
        left, reach = list(range(len(pairs))), REACH
        while left:
            cuts = {k: (tail(pairs[k][0], reach), head(pairs[k][1], reach)) for k in left}
            rest = [k for k, (x, y) in cuts.items() if x is None or y is None]
            cuts = [(k, x, y) for k, (x, y) in cuts.items() if x is not None and y is not None]
            flat = [w for _, x, y in cuts for w in (x, x + y, y)]
            got, at = self.encode(pa.array(flat, pa.large_string()))
            for j, (k, x, y) in enumerate(cuts):
                before, window, after = (got[at[i] : at[i + 1]] for i in range(3 * j, 3 * j + 3))
                text, more, a, b = pairs[k]
                if (len(x) == len(text) or agree(before, window, a, False)) and (len(y) == len(more) or agree(after, window, b, True)):
                    out[k] = np.concatenate([a[: len(a) - len(before)], window, b[len(after) :]])
                else:
                    rest.append(k)
            left, reach = rest, 4 * reach
        return out

    # -- stretches without white space ---------------------------------------

    def parts(self, text: str) -> list[tuple[int, int, bytes | str]]:
        """Cuts a text with long stretches: (part, leaf, content), with leaf -1 for
        ordinary stretches of pre-tokens; leaves count from 0 within a long one."""
        out: list[tuple[int, int, bytes | str]] = []
        run: list[bytes] = []
        for piece, _ in self.reference.pre_tokenizer.pre_tokenize_str(self.reference.normalizer.normalize_str(text)):
            data = bytes(map(self.byte_of.__getitem__, piece)) + b"\0"
            if len(data) <= LONG:
                run.append(data)
                continue
            if run:
                out.append((len(out), -1, b"".join(run)))
                run = []
            k = len(out)
            out += [(k, i, leaf) for i, leaf in enumerate(halves(data))]
            # the part number is that of its first leaf, so numbers stay distinct
        if run:
            out.append((len(out), -1, b"".join(run)))
        return out

    def part_ids(self, leaf: int, data: bytes) -> list[int]:
        """Own ids of an ordinary stretch or of a leaf."""
        if leaf >= 0:
            return list(self.core.encode_single_piece(data))
        words = (w + b"\0" for w in data.split(b"\0")[:-1])
        return [t for w in words for t in self.core.encode_single_piece(w)]

    def joined(self, leaves: list[list[int]]) -> list[int]:
        """Joins neighbours pairwise until one sequence is left."""
        while len(leaves) > 1:
            pairs = [self.join(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = pairs + leaves[len(pairs) * 2 :]
        return leaves[0] if leaves else []

    def join(self, a: list[int], b: list[int]) -> list[int]:
        i = j = 4
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            left, right = a[len(a) - i :], b[:j]
            window = list(self.core.encode_single_piece(b"".join(self.text_of[t] for t in left + right)))
            left_agrees = i == len(a) or window[0] == left[0]
            right_agrees = j == len(b) or window[-1] == right[-1]
            if left_agrees and right_agrees:
                return a[: len(a) - i] + window + b[j:]
            i, j = (i if left_agrees else 2 * i), (j if right_agrees else 2 * j)

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The rows' texts: the tokens as the vocabulary writes them, joined by a space."""
        tokens = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), self.names.take(pa.array(ids)).cast(pa.large_string()))
        return pc.binary_join(tokens, pa.scalar(" ", pa.large_string()))


def halves[T: (str, bytes)](data: T, leaf: int = LEAF) -> list[T]:
    """Halves of halves, down to leaves of at most `leaf` characters or bytes."""
    if len(data) <= leaf:
        return [data]
    mid = len(data) // 2
    return halves(data[:mid], leaf) + halves(data[mid:], leaf)


def tail(text: str, reach: int) -> str | None:
    """The end of a text from white space on, with two words, in its last `reach` characters; all of
    a shorter text; None if there is no such white space."""
    if len(text) <= reach:
        return text
    at = [m.start() for m in _BEFORE_WORD.finditer(text, len(text) - reach)]
    return text[at[0] :] if len(at) > 1 else None


def head(text: str, reach: int) -> str | None:
    """The beginning of a text up to white space, with two words, in its first `reach` characters; as tail()."""
    if len(text) <= reach:
        return text
    at = [m.start() for m in _BEFORE_WORD.finditer(text, 0, reach)]
    return text[: at[-1]] if len(at) > 2 else None


def agree(side: np.ndarray, window: np.ndarray, whole: np.ndarray, first: bool) -> bool:
    """Whether a side's tokens stand at that end of the whole, and its outermost token at the window's."""
    n = len(side)
    if not n or not len(window) or n > len(whole):
        return False
    if first:
        return side[-1] == window[-1] and np.array_equal(side, whole[:n])
    return side[0] == window[0] and np.array_equal(side, whole[len(whole) - n :])


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


#: Turns ids laid end to end and the rows' offsets into result columns.
Finish = Callable[[WordBpe, np.ndarray, np.ndarray], dict[str, pa.Array]]


def keep_ids(_: WordBpe, ids: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    return {"ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))}


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish: Finish = keep_ids, finish_ddl: str = "ids array<int>"
) -> DataFrame:
    """Per row: the id and what `finish` makes of its ids (the ids themselves by default)."""
    names = [f.split()[0] for f in finish_ddl.split(", ")]
    ddl = f"id long, {finish_ddl}"
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.col("text").rlike(f"\\S{{{LONG},}}")

    def batch_of(bpe, id_, ids, offsets):
        got = finish(bpe, ids, offsets)
        return pa.RecordBatch.from_arrays([id_, *(got[n] for n in names)], names=["id", *names])

    def direct(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for s in tk.slices(batch.column(1), SLICE):
                ids, offsets = bpe.tree(batch.column(1).slice(s.first, s.rows))
                yield batch_of(bpe, batch.column(0).slice(s.first, s.rows), ids, offsets)

    def cut(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                special = "\0" in text or any(s in text for s in bpe.specials)
                parts = [(0, -2, text.encode())] if special else bpe.parts(text) or [(0, -1, b"")]
                yield pa.RecordBatch.from_pylist(
                    [{"row": row["row"], "id": row["id"], "part": p, "leaf": i, "data": d} for p, i, d in parts],
                    pa.schema([("row", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("leaf", pa.int32()), ("data", pa.binary())]),
                )

    def leaves(batches):
        bpe = word_bpe(path)
        for batch in batches:
            own = [
                bpe.whole(d.decode()).tolist() if i == -2 else bpe.part_ids(i, d)
                for i, d in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.list_(pa.int32()))], names=["row", "id", "part", "leaf", "own"])

    def together(table: pa.Table) -> pa.Table:
        bpe = word_bpe(path)
        rows = table.select(["part", "leaf", "own", "id"]).sort_by([("part", "ascending"), ("leaf", "ascending")]).to_pylist()
        by_part: dict[int, list] = {}
        for r in rows:
            by_part.setdefault(r["part"], []).append(r)
        ids = [np.zeros(0, np.int32)]
        for group in by_part.values():
            if group[0]["leaf"] == -2:
                ids.append(np.array(group[0]["own"], np.int32))
            else:
                ids.append(bpe.real[np.array(bpe.joined([g["own"] for g in group]), np.int64)])
        ids = np.concatenate(ids)
        got = batch_of(bpe, pa.array([rows[0]["id"]], pa.int64()), ids, np.array([0, len(ids)]))
        return pa.Table.from_batches([got])

    short = docs.filter(~is_long).mapInArrow(direct, ddl)
    long = (
        docs.filter(is_long)
        .select(F.monotonically_increasing_id().alias("row"), "id", "text")
        .mapInArrow(cut, "row long, id long, part int, leaf int, data binary")
        .repartition("row", "part", "leaf")
        .mapInArrow(leaves, "row long, id long, part int, leaf int, own array<int>")
        .groupBy("row")
        .applyInArrow(together, ddl)
    )
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and the text of its ids; null ids give the empty text."""

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            lists = pc.fill_null(batch.column(1).cast(pa.large_list(pa.int32())), [])
            offsets = lists.offsets.to_numpy()
            text = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["id", "text"])

    got = encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "id long, text string")
    return got.withColumnRenamed("id", id_col)
