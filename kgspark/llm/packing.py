"""Hierarchical multi-length packing.

Documents are routed to the smallest context tier that holds them; what is longer than the longest
tier first fills whole windows of it. Each tier is packed best fit, largest document first; the gaps
of a window are filled from shorter tiers, and what no whole document fits is closed with the head of
the longest document that is left, whose rest goes back to its tier. The last sequence of a block,
for which nothing is left, is cut into full windows of powers of two. So every sequence is a full
power-of-two window, and nothing is padded; those of the end of a block may be shorter than the shortest
tier. Windows are dealt to step groups of about equal tokens, block by block. Of pieces of equal length the
one put back last, or with the earlier row, comes first. Very long texts give many windows.

Packing works in blocks of consecutive documents of a partition, without a shuffle: a task holds the
ids of one block. Sequence numbers carry the partition, the block and a counter.

Null and empty texts are packed as their end id alone. Repeated rows are documents of their own. A
table without rows gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import renamed, tune, windows, word_memo

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())])


class Pool:
    """Pieces by length, with a bit for each length that has some."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length

    def take(self, at_most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most so many tokens."""
        length = (self.mask & ((1 << (at_most + 1)) - 1)).bit_length() - 1
        if length <= 0:
            return None
        doc, start = self.by[length].pop()
        if not self.by[length]:
            self.mask ^= 1 << length
        return doc, start, length


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, pieces), a piece being (document, start, length)."""
    longest, pool, windows = tiers[-1], Pool(), []
    for doc in range(len(lengths) - 1, -1, -1):
        whole = lengths[doc] // longest * longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if lengths[doc] > whole:
            pool.put(doc, whole, lengths[doc] - whole)
    while piece := pool.take(longest):
        tier = next(t for t in tiers if t >= piece[2])
        pieces, gap = [piece], tier - piece[2]
        while gap and (more := pool.take(gap)):
            pieces.append(more)
            gap -= more[2]
        if gap and (long := pool.take(longest)):
            doc, start, length = long
            pieces.append((doc, start, gap))
            pool.put(doc, start + gap, length - gap)
            gap = 0
        windows += [(tier, pieces)] if not gap else powers_of_two(pieces)
    return windows


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cut a run of pieces into windows of falling powers of two."""
    left, out = sum(p[2] for p in pieces), []
    todo = [*reversed(pieces)]
    while left:
        size = room = 1 << (left.bit_length() - 1)
        own = []
        while room:
            doc, start, length = todo.pop()
            own.append((doc, start, min(room, length)))
            if length > room:
                todo.append((doc, start + room, length - room))
            room -= own[-1][2]
        out.append((size, own))
        left -= size
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """The group of each window: largest window first into the group with the fewest tokens so far."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    group = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, g = heap[0]
        group[i] = g
        heapq.heapreplace(heap, (tokens + sizes[i], g))
    return group


def pack(
    docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, block_tokens: int = 2_000_000,
    step_tokens: int = 65_536, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """A row for each piece, with its ids as little-endian unsigned 32-bit numbers if with_ids."""
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = word_memo(path), end_id.to_bytes(4, "little")
        base, made, groups = TaskContext.get().partitionId() << 40, 0, 0
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal made, groups, held
            windows = plan([len(x) // 4 for x in ids], tiers)
            of = step_groups([w for w, _ in windows], step_tokens)
            rows = []
            for k, (window, pieces) in enumerate(windows):
                offset = 0
                for doc, start, length in pieces:
                    own = ids[doc][4 * start : 4 * (start + length)]
                    rows.append((names[doc], start, length, zlib.crc32(own), len(ids[doc]) // 4, base + made + k, offset, window, base + groups + of[k], own if with_ids else None))
                    offset += length
            made, groups, held = made + len(windows), groups + max(of, default=-1) + 1, 0
            names.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], names=ARROW.names)

        for batch in windows(batches, 1):
            every, counts = memo.many(batch.column(1).to_pylist())
            every, at = every.tobytes(), 0
            for name, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                names.append(name)
                ids.append(every[at : at + 4 * n] + end)
                at, held = at + 4 * n, held + n + 1
                if held >= block_tokens:
                    yield block()
        if ids:
            yield block()
        memo.forget()  # what follows in this worker needs the memory more

    tune(docs.sparkSession)
    out = renamed(docs, {"doc_id": doc_id, "text": text}).mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")
