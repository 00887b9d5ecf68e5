"""Byte-level BPE by a pair occurrence index.

Within a partition, the pieces of text not met before are laid end to end as one array of symbols. An index maps each
mergeable pair to all its positions there. Ranks that occur are applied in ascending order, each at all its positions at
once, and the lists of the pairs that a merge creates are extended. That equals merging piece by piece, as a merge only
creates pairs of higher rank. Pieces met before come from a table kept for the partition, of bounded size.

The tokenizer's file is read on the driver and its tables are broadcast; their size is the vocabulary's. A string of a
special token in a text becomes its id. Null text counts as empty and has no ids; ids of null decode to the empty string.
Input columns stay, but for the one that is added. Bytes that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces kept for a partition before the table starts anew.
KEPT_PIECES = 250_000
#: Fixed value: the split of byte-level BPE, white space spelt out as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@dataclass
class Bpe:
    first: np.ndarray  # id of each byte
    pairs: np.ndarray  # left << 32 | right, sorted
    rank: np.ndarray  # of each of pairs
    left: np.ndarray  # by rank, as right and merged
    right: np.ndarray
    merged: np.ndarray
    pieces: list[bytes]  # the bytes of each id
    special: dict[str, int]
    n_ids: int


def load(path: str) -> Bpe:
    """Tables of a tokenizer file in JSON with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}  # bytes that stand for themselves in the file
    hidden = (b for b in range(256) if b not in shown)
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    merged = np.array([vocab[a + b] for a, b in merges], np.int64)
    pairs = left << 32 | right
    order = np.argsort(pairs)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n_ids = 1 + max([*vocab.values(), *special.values()])
    pieces = [b""] * n_ids
    for token, i in vocab.items():
        pieces[i] = bytes(byte_of[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode()
    first = np.zeros(256, np.int64)
    for c, b in byte_of.items():
        first[b] = vocab[c]
    return Bpe(first, pairs[order], order, left, right, merged, pieces, special, n_ids)


def merge_all(bpe: Bpe, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and the number of ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = bpe.first[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    word = np.repeat(np.arange(len(words)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    if n:
        ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
        after[ends] = -1
        before[np.r_[0, ends[:-1] + 1]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Puts positions on the lists of their pairs."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(bpe.pairs, key), len(bpe.pairs) - 1)
        hit = np.flatnonzero(bpe.pairs[place] == key)
        rank, at = bpe.rank[place[hit]], at[hit]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, positions in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(positions)

    if n:
        start = np.flatnonzero(after >= 0)
        enter(start, sym[start], sym[start + 1])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        a, b, new = int(bpe.left[r]), int(bpe.right[r]), int(bpe.merged[r])
        p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        q = after[p]
        still = alive[p] & (sym[p] == a) & (q >= 0) & (sym[q] == b)
        p, q = p[still], q[still]
        if a == b and len(p) > 1:  # of a run of equal symbols, every other pair
            starts = np.r_[True, p[1:] != q[:-1]]
            place = np.arange(len(p))
            odd = (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 1
            p, q = p[~odd], q[~odd]
        if not len(p):
            continue
        far = after[q]
        sym[p], alive[q], after[p] = new, False, far
        has = far >= 0
        before[far[has]] = p[has]
        prev = before[p]
        back = prev >= 0
        enter(np.concatenate([prev[back], p[has]]), np.concatenate([sym[prev[back]], sym[p[has]]]), np.concatenate([sym[p[back]], sym[far[has]]]))
    return sym[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)


class _Partition:
    """The pieces met so far in a partition, with their ids."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.split = bpe, regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True))) + ")") if bpe.special else None
        self.clear()

    def clear(self) -> None:
        self.place = {s: k for k, s in enumerate(self.bpe.special)}
        self.flat = [np.array(list(self.bpe.special.values()), np.int32)]
        self.sizes = [np.ones(len(self.place), np.int64)]

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.bpe.special else self.split.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.place) > KEPT_PIECES:
            self.clear()
        split = [self.pieces(x) if x else [] for x in texts]
        words = list(chain.from_iterable(split))
        new = list(set(words).difference(self.place))
        if new:
            ids, sizes = merge_all(self.bpe, [w.encode() for w in new])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.flat, self.sizes = [np.concatenate([*self.flat, ids])], [np.concatenate([*self.sizes, sizes])]
        flat, sizes, place = self.flat[0], self.sizes[0], self.place
        starts = np.cumsum(sizes) - sizes
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        n = sizes[at]
        ends = np.cumsum(n)
        out = flat[np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - starts[at], n)]
        pieces_to = np.cumsum([0, *map(len, split)])
        offsets = np.r_[0, ends][pieces_to].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))


def _in_slices(batches: Iterator[pa.RecordBatch], col: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column has about `most` bytes a slice; a row is never cut."""
    for b in batches:
        rows = max(1, int(b.num_rows * most / max(1, b.column(col).nbytes)))
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [k for k in batch.schema.names if k != name]
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], values], [*keep, name])


def _with(df: DataFrame, col: str, kind: T.DataType, f: Callable) -> DataFrame:
    fields = [x for x in df.schema.fields if x.name != col]
    return df.mapInArrow(f, T.StructType([*fields, T.StructField(col, kind)]))


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with the ids of each text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Partition(shared.value)
        for b in _in_slices(batches, text_col):
            yield _put(b, out_col, part.encode(b.column(text_col).to_pylist()))

    return _with(df, out_col, T.ArrayType(T.IntegerType()), run)


def decode_ids(bpe_bytes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids: the bytes of all ids gathered in one step."""
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    flat = flat[offsets[0] : offsets[-1]]
    n = sizes[flat]
    ends = np.cumsum(n)
    out = bpe_bytes[np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - starts[flat], n)]
    to = np.r_[0, ends][offsets - offsets[0]].astype(np.int32)
    texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(to.tobytes()), pa.py_buffer(out.tobytes()))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        raw = out.tobytes()
        texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(to[:-1], to[1:], strict=True)], pa.string())
    return texts


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of each list of ids, special tokens included."""
    pieces = load(path).pieces
    shared = df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sizes = shared.value
        starts = np.cumsum(sizes) - sizes
        for b in _in_slices(batches, ids_col):
            yield _put(b, out_col, decode_ids(raw, starts, sizes, b.column(ids_col)))

    return _with(df, out_col, T.StringType(), run)
