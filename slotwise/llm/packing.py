"""Packing of tokenised documents into sequences by minimum bin slack.

A document's ids, with an end id, are cut into full sequences and one remainder. Each task keeps
the multiset of its remainders and fills one sequence after the other: the largest remainder
opens it, a subset-sum dynamic programme over a bitset (one bit per fill level, lengths with
their counts by binary splitting) finds the fill closest to the capacity, and the counts of each
length are read back from the bitsets before it. If the best fill leaves slack, a remainder is
cut to close it. What is left at the end of a task, less than one sequence, is cut into
sequences whose lengths are powers of two, which need no padding.

Tasks work alone: nothing is shuffled, and a repeated task gives the same pieces for the same rows.
"""
from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 1024, 0
#: Remainders kept at hand before sequences are filled; more bring no closer fills.
BUFFER = 2048
_ENCODERS: dict[str, object] = {}


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(vocabulary: str):
    """Function from text to ids; ``vocabulary`` is a rank file, whose ids are those of the byte-level BPE of the same name."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        end = "<|endoftext|>"
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})
        _ENCODERS[vocabulary] = lambda t: enc.encode(t, allowed_special="all") if end in t else enc.encode_ordinary(t)
    return _ENCODERS[vocabulary]


def closest_fill(lengths: list[tuple[int, int]], room: int) -> tuple[int, dict[int, int]]:
    """Largest total <= ``room`` of a sub-multiset of ``lengths`` (length, count), and how many of each length it takes."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in lengths:
        if length > room:
            continue
        before, left, k = reach, min(count, room // length), 1
        while left:
            t = min(k, left)
            reach |= (reach << (t * length)) & full
            left -= t
            k *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    take = {}
    for length, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= length
            k += 1
        if k:
            take[length] = k
    return best, take


class _Bins:
    """Remainders of one task by length, and the pieces placed so far."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.by_length: dict[int, list] = {}
        self.size = self.total = 0
        self.placed: list[tuple] = []  # (document, start, ids, sequence, offset)

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        self.by_length.setdefault(len(ids), []).append((doc, start, ids))
        self.size += 1
        self.total += len(ids)

    def _pop(self, length: int):
        rows = self.by_length[length]
        piece = rows.pop()
        if not rows:
            del self.by_length[length]
        self.size -= 1
        self.total -= length
        return piece

    def place(self, pieces: list) -> None:
        at = 0
        for doc, start, ids in pieces:
            self.placed.append((doc, start, ids, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _upto(self, room: int) -> list:
        """Pieces of exactly ``room`` ids in all; a remainder is cut if no multiset fits."""
        largest = max(self.by_length)
        if largest > room:
            pieces, gap = [], room
            if room < self.capacity:
                best, take = closest_fill([(x, len(self.by_length[x])) for x in sorted(self.by_length, reverse=True)], room)
                pieces = [self._pop(x) for x, k in take.items() for _ in range(k)]
                gap = room - best
        else:
            pieces = [self._pop(largest)]
            gap = room - largest
            best, take = closest_fill([(x, len(self.by_length[x])) for x in sorted(self.by_length, reverse=True)], gap)
            pieces += [self._pop(x) for x, k in take.items() for _ in range(k)]
            gap -= best
        if gap:
            doc, start, ids = self._pop(max(self.by_length))
            pieces.append((doc, start, ids[:gap]))
            self.add(doc, start + gap, ids[gap:])
        return pieces

    def fill(self, keep: int) -> None:
        while self.size > keep and self.total >= self.capacity:
            self.place(self._upto(self.capacity))

    def finish(self) -> None:
        self.fill(0)
        while self.total:
            self.place(self._upto(1 << (self.total.bit_length() - 1)))


def _batch(placed: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids = [p[2] for p in placed]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))
    column = lambda f: pa.array([f(p) for p in placed], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0][0] for p in placed], kind), column(lambda p: p[1]), pa.array(lengths), column(lambda p: p[0][1]), column(lambda p: p[3]), column(lambda p: p[4]), lists],
        names=["given", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def _pack(vocabulary: str, capacity: int, end_id: int, finish):
    def pieces(batches):
        encode = encoder(vocabulary)
        bins, kind = _Bins(capacity, TaskContext.get().partitionId() << 40), None
        for b in batches:
            kind = b.column("given").type
            for name, text in zip(b.column("given").to_pylist(), b.column("text")):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                ids = np.array(ids, np.int32)
                doc, full = (name, len(ids)), len(ids) - len(ids) % capacity
                for at in range(0, full, capacity):
                    bins.place([(doc, at, ids[at : at + capacity])])
                if full < len(ids):
                    bins.add(doc, full, ids[full:])
                if bins.size >= BUFFER:
                    bins.fill(BUFFER // 2)
                if len(bins.placed) >= 4096:
                    yield _batch(bins.placed, kind)
                    bins.placed = []
        if kind is not None:
            bins.finish()
            if bins.placed:
                yield _batch(bins.placed, kind)

    return (lambda batches: finish(pieces(batches))) if finish else pieces


def _digests(batches):
    for b in batches:
        flat = b.column("ids").flatten().to_numpy().astype("<u4")
        end = np.cumsum(b.column("length").to_numpy())
        crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(end, b.column("length").to_numpy())]
        names = [c for c in b.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


_SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, digests: bool = False) -> DataFrame:
    """One row per piece: id, ``start`` in the document's ids, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` there, ``ids``.

    A null or empty text is the end id alone. Null and repeated ids are kept as they are: each row
    is a document of its own. Other columns are ignored; an empty table gives no pieces. With
    ``digests`` the crc32 of a piece's ids (little-endian, four bytes each) stands in place of the ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = _pack(vocabulary or default_vocabulary(), capacity, end_id, _digests if digests else None)
    rows = docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text")).mapInArrow(run, f"given {kind}, {_SCHEMA}, " + ("ids_crc32 long" if digests else "ids array<int>"))
    return rows.withColumnRenamed("given", id_col)
