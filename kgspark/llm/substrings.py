"""Substring dedup: Rabin-Karp hashes of every window of 13 words, counted over the corpus.

A window is 13 consecutive words of one document (runs of characters other than blank and U+0009 to
U+000D, unchanged). Every word covered by a window whose word sequence also starts in a document with a
smaller doc_id is removed; touching and overlapping windows merge into maximal intervals.

Documents are dealt to groups. A group sends the first 48 bits of its distinct window hashes, sorted,
delta-coded and cut by hash range; so a passage that a third of all documents share is as many hashes
as there are groups, not documents. Each range tells the groups which of theirs another group has, too.
Of those alone the groups then send all 128 bits with the smallest doc_id that has them, and get back the
windows that start in a smaller document of another group; what repeats within the group it knows itself.
A message holds its own hashes and doc_ids and nothing else of its group, so a group sends at most a message
for each of its windows however many ranges there are, and all messages together follow the windows.
Documents are shuffled once, by group.

Words count as 64-bit hashes and windows as two 64-bit polynomials of them, so two different windows are
taken for one with a chance of about n * n / 2**129 in a corpus of n windows of known words.

Null and empty texts have no words, a very long text is one document like any other. Documents of fewer
than 13 words keep all. Rows of one doc_id are each judged against smaller ids and not against one another,
and those of different texts are dealt to different groups. Rows with a null doc_id are kept whole, count
for nothing and are not shuffled. A table without rows gives none. Columns named in keep are passed on unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

WINDOW = 13
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Bits of a window hash that are not sent at first.
SHORT = np.uint64(16)
#: Bytes of text in a group, and of window hashes in a range, about.
GROUP_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
WORD = re.compile(r"[^ \t-\r]+")


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, window: int, multiplier: np.uint64 = MULTIPLIERS[0]) -> np.ndarray:
    """The polynomial hash of each window of word hashes, modulo 2**64."""
    n = max(0, len(words) - window + 1)
    out = np.zeros(n, np.uint64)
    for k in range(window if n else 0):
        out *= multiplier
        out += words[k : k + n]
    return out


def packed(values: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers, as compressed planes of the bytes of their differences."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize).T).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def run_starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(sorted_by[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)))


def pieces(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, behind the last) of each range of the first 32 bits that the sorted hashes meet."""
    of = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    starts = run_starts(of)
    return [*zip(of[starts].tolist(), starts.tolist(), np.append(starts, len(of))[1:].tolist(), strict=True)]


def by_group(groups: list[int], of: np.ndarray, values: np.ndarray) -> pa.Table:
    """Values, sorted in each group, as a message to it."""
    back = np.argsort(of, kind="stable")
    values, cut = values[back], np.searchsorted(of[back], np.arange(len(groups) + 1))
    rows = [(g, packed(values[a:b])) for g, a, b in zip(groups, cut[:-1], cut[1:], strict=True) if b > a]
    return pa.Table.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["_group", "hashes"])


class Group:
    """The windows of the documents of a group."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int) -> None:
        own = [word_hashes(t) for t in texts]
        self.counts = np.array([len(x) for x in own], np.int64)
        words = np.concatenate(own) if own else np.zeros(0, np.uint64)
        first = window_hashes(words, window)
        doc = np.repeat(np.arange(len(own)), self.counts)
        self.at = np.flatnonzero(doc[: len(first)] == doc[len(doc) - len(first) :])
        first, second = first[self.at], window_hashes(words, window, MULTIPLIERS[1])[self.at]
        self.doc_ids, rank = np.unique(np.array(ids, np.int64), return_inverse=True)
        self.order = np.argsort(first, kind="stable")
        if ((first[self.order][1:] == first[self.order][:-1]) & (second[self.order][1:] != second[self.order][:-1])).any():
            self.order = np.lexsort((second, first))
        first, second = first[self.order], second[self.order]
        starts = run_starts(first, second)
        self.hashes, self.second = first[starts], second[starts]
        self.rank = rank[doc[self.at]][self.order].astype(np.uint32)
        self.least = np.minimum.reduceat(self.rank, starts) if len(starts) else np.zeros(0, np.uint32)
        self.sizes = np.diff(np.append(starts, len(first)))

    def covered(self, elsewhere: np.ndarray, window: int) -> np.ndarray:
        """The words to remove, given the hashes that start in a smaller document of another group."""
        hit = np.isin(self.hashes, elsewhere, assume_unique=True)
        bad = np.repeat(hit, self.sizes) | (self.rank > np.repeat(self.least, self.sizes))
        edge = np.zeros(int(self.counts.sum()) + 1, np.int32)
        at = self.at[self.order[bad]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        return np.cumsum(edge)[:-1] > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word behind the last) of each maximal run that the mask covers."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [*zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space behind each run of them."""
    words, out, at = [*WORD.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[at : words[a].start()])
        at = words[b].start() if b < len(words) else len(text)
    return "".join([*out, text[at:]])


def answered(answers: pa.Table) -> np.ndarray:
    every = [unpacked(b, np.uint64) for b in answers.column("hashes").to_pylist()]
    return np.concatenate(every) if every else np.zeros(0, np.uint64)


def first_messages(dealt: DataFrame, ranges: int, window: int) -> DataFrame:
    """_range, _group, hashes: the short hashes of the distinct windows of each group."""

    def send(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        g = Group(table.column("_id").to_pylist(), table.column("_text").to_pylist(), window)
        rows = [(r, key[0].as_py(), packed((own := g.hashes[a:b] >> SHORT)[run_starts(own)])) for r, a, b in pieces(g.hashes, ranges)]
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["_range", "_group", "hashes"])

    return dealt.groupBy("_group").applyInArrow(send, "_range long, _group long, hashes binary")


def repeated(dealt: DataFrame, ranges: int, window: int) -> DataFrame:
    """_group, hashes: the windows of a group that also start in a smaller document of another one."""

    def met(table: pa.Table) -> pa.Table:
        groups, hashes = table.column("_group").to_pylist(), [unpacked(h, np.uint64) for h in table.column("hashes").to_pylist()]
        every, of = np.concatenate(hashes), np.repeat(np.arange(len(groups)), [len(x) for x in hashes])
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        starts = run_starts(every)
        several = np.repeat((n := np.diff(np.append(starts, len(every)))) > 1, n)
        return by_group(groups, of[several], every[several])

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and answers.num_rows:
            g = Group(table.column("_id").to_pylist(), table.column("_text").to_pylist(), window)
            also = np.isin(g.hashes >> SHORT, answered(answers))
            first, second, least = g.hashes[also], g.second[also], g.least[also]
            for r, a, b in pieces(first, ranges):
                names, of = np.unique(least[a:b], return_inverse=True)
                rows.append((r, table.column("_group")[0].as_py(), packed(first[a:b]), second[a:b].tobytes(), packed(g.doc_ids[names]), packed(of.astype(np.uint32))))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["_range", "_group", "hashes", "second", "names", "least"])

    def late(table: pa.Table) -> pa.Table:
        groups, hashes, seconds, docs = table.column("_group").to_pylist(), [], [], []
        for h, s, n, m in zip(*(table.column(c).to_pylist() for c in ("hashes", "second", "names", "least")), strict=True):
            hashes.append(unpacked(h, np.uint64))
            seconds.append(np.frombuffer(s, np.uint64))
            docs.append(unpacked(n, np.int64)[unpacked(m, np.uint32)])
        of = np.repeat(np.arange(len(groups)), [len(x) for x in hashes])
        first, second, doc = np.concatenate(hashes), np.concatenate(seconds), np.concatenate(docs)
        order = np.lexsort((second, first))
        first, second, doc, of = first[order], second[order], doc[order], of[order]
        starts = run_starts(first, second)
        bad = doc > np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(first))))
        return by_group(groups, of[bad], first[bad])

    several = first_messages(dealt, ranges, window).groupBy("_range").applyInArrow(met, "_group long, hashes binary")
    again = dealt.groupBy("_group").cogroup(several.groupBy("_group")).applyInArrow(send, "_range long, _group long, hashes binary, second binary, names binary, least binary")
    return again.groupBy("_range").applyInArrow(late, "_group long, hashes binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, output: str = "words") -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, removed (array of word intervals), kept, and the columns of keep.

    kept: the words that stay, joined by one blank (output "words"), or the text with its own white space (output "text").
    """
    tune(docs.sparkSession)
    kept = keep or []
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    groups, ranges = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total * 1.3 / RANGE_BYTES))
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(kept)))
    dealt = source.where("_id is not null").withColumn("_group", F.pmod(F.xxhash64("_id", "_text"), F.lit(groups)))

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("_text").to_pylist()
        g = Group(table.column("_id").to_pylist(), texts, window)
        return cleaned(table, texts, g.counts, g.covered(answered(answers), window))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            counts = np.array([len((t or "").encode().split()) for t in texts], np.int64)
            yield from cleaned(pa.Table.from_batches([batch]), texts, counts, np.zeros(counts.sum(), bool)).to_batches()

    def cleaned(table: pa.Table, texts: list[str | None], counts: np.ndarray, mask: np.ndarray) -> pa.Table:
        spans, bodies, gone = [], [], []
        for t, a, n in zip(texts, (np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
            own = intervals(mask[a : a + n]) if n and mask[a : a + n].any() else []
            spans.append([{"first": x, "behind": y} for x, y in own])
            gone.append(sum(y - x for x, y in own))
            if output == "text":
                bodies.append(without(t, own) if own else t)
            else:
                words = (t or "").encode().split()
                for x, y in reversed(own):
                    del words[x:y]
                bodies.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
        own = [table.column("_id"), pa.array(counts), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(bodies, pa.string()), *(table.column(f"_keep{i}") for i in range(len(kept)))]
        return pa.Table.from_arrays(own, names=[f.name for f in out.fields])

    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("behind", T.LongType())]))
    out = T.StructType([T.StructField("_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.StringType()), *(T.StructField(f"_keep{i}", docs.schema[c].dataType) for i, c in enumerate(kept))])

    found = dealt.groupBy("_group").cogroup(repeated(dealt, ranges, window).groupBy("_group")).applyInArrow(remove, out)
    found = found.unionAll(source.where("_id is null").mapInArrow(whole, out))
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "removed", "kept", *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(kept)))
