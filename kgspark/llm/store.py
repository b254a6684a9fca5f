"""Content-addressed store of token ids.

A rolling hash over the ids of a document cuts it into chunks, so equal passages give equal chunks.
A chunk's address is the SHA-256 of its stored bytes (ids as little-endian unsigned 16-bit numbers, or
32-bit for a larger vocabulary); each distinct chunk is stored once. The folder holds three Parquet tables:

    packed/kind=chunk      address, n (ids), width, body
    packed/kind=recipe     recipes as the tasks made them, unordered
    recipes/kind=recipe    part, position, begin (ids before it in its part), doc_id, n, root, addresses
    recipes/kind=manifest  part, n (ids), root
    root                   parts (their number), n (ids), root

Recipes are ordered by doc_id over the parts and within each. A recipe's root is the Merkle root of its
addresses, a manifest's that of its recipes' roots, and the store's that of its manifests' roots. read()
checks every address against the body, every recipe against its root, every part against its manifest and
all manifests against the root of the store, and fails on the first difference. The driver holds a
manifest for each part, and there are as many parts as the shuffle that orders the documents has partitions.

Null and empty texts are stored as their end id, very long ones as many chunks. Rows of one doc_id are
stored each, ordered by their root; a null doc_id comes first. A table without rows gives a store without rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed, tune, windows, word_memo

#: Ids a rolling hash looks at; a cut at one position in MEAN on average; least and most ids of a chunk.
LOOK, MEAN, LEAST, MOST = 8, 1024, 64, 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the LOOK ids before a position asks for a cut."""
    if len(ids) < LOOK:
        return np.zeros(0, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(32)
    rolling = np.zeros(len(ids) - LOOK + 1, np.uint64)
    for k in range(LOOK):
        rolling *= MULTIPLIER
        rolling += mixed[k : k + len(rolling)]
    return np.flatnonzero((rolling >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + LOOK


def cuts(n: int, wanted: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, given where cuts are wanted."""
    ends, at = [], 0
    for end in wanted:
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST and end < n:
            ends.append(end)
            at = end
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n]


class Merkle:
    """The root of leaves added one by one; a leaf without a partner moves up as it is."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = leaf
                return
            leaf, self.levels[i] = hashlib.sha256(left + leaf).digest(), None
        self.levels.append(leaf)

    def root(self) -> bytes:
        out: bytes | None = None
        for left in self.levels:
            if left is not None:
                out = left if out is None else hashlib.sha256(left + out).digest()
        return out or hashlib.sha256(b"").digest()


def merkle_root(leaves: Iterator[bytes] | list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def addresses_of(joined: bytes) -> list[bytes]:
    return [joined[i : i + 32] for i in range(0, len(joined), 32)]


def chunked(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows of both kinds: each chunk once a task, each document's recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(tokenizer_path)
        width = 2 if max(memo.largest, end_id) < 1 << 16 else 4  # one for the whole store, so equal ids have one address
        task, made, seen = TaskContext.get().partitionId(), 0, set()
        for batch in windows(batches, 1):
            ids, counts = memo.many(batch.column(1).to_pylist())
            stops = np.cumsum(counts + 1)
            every = np.full(stops[-1], end_id, "<u4")
            every[np.delete(np.arange(len(every)), stops - 1)] = ids
            body, wanted = every.astype(f"<u{width}").tobytes(), marks(every)
            first = np.searchsorted(wanted, stops - counts - 1 + LOOK).tolist()
            last = np.searchsorted(wanted, stops).tolist()
            rows, start = [], 0
            for i, (name, stop) in enumerate(zip(batch.column(0).to_pylist(), stops.tolist(), strict=True)):
                at, own = start, []
                for cut in cuts(stop - start, (wanted[first[i] : last[i]] - start).tolist()):
                    piece = body[at * width : (start + cut) * width]
                    address = hashlib.sha256(piece).digest()
                    own.append(address)
                    if address not in seen:
                        seen.add(address)
                        rows.append(("chunk", address, None, start + cut - at, width, piece))
                    at = start + cut
                rows.append(("recipe", b"%16x%16x" % (task, made), name, stop - start, 32, b"".join(own)))
                made, start = made + 1, stop
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)], names=["kind", "address", "doc_id", "n", "width", "body"])

    tune(docs.sparkSession)
    return docs.mapInArrow(run, "kind string, address binary, doc_id long, n long, width int, body binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Store all documents under path, which must not exist."""
    spark = docs.sparkSession
    rows = chunked(renamed(docs, {"doc_id": doc_id, "text": text}), tokenizer_path, end_id)
    unique = rows.repartition("kind", "address").groupBy("kind", "address").agg(*(F.first(c).alias(c) for c in ("doc_id", "n", "width", "body")))
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/packed")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, begin, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "part", "position", "begin", "doc_id", "n", "root", "addresses"])
        for batch in batches:
            rows = []
            for name, n, root, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(("recipe", part, at, begin, name, n, root, joined))
                tree.add(root)
                at, begin = at + 1, begin + n
            yield made(rows)
        if at:
            yield made([("manifest", part, at, None, None, begin, tree.root(), None)])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root(addresses_of(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary()), batch.column(2)], names=["doc_id", "n", "root", "addresses"])

    recipes = table(spark, path, "packed", "recipe").select("doc_id", "n", F.col("body").alias("addresses")).mapInArrow(rooted, "doc_id long, n long, root binary, addresses binary")
    ordered = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root", "n")
    ordered.mapInArrow(number, "kind string, part int, position long, begin long, doc_id long, n long, root binary, addresses binary").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/recipes")
    found = sorted(tuple(r) for r in table(spark, path, "recipes", "manifest").select("part", "n", "root").collect())
    spark.createDataFrame([summary(found)], "parts int, n long, root binary").write.parquet(f"{path}/root")


def table(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    schema = "address binary, doc_id long, n long, width int, body binary" if name == "packed" else "part int, position long, begin long, doc_id long, n long, root binary, addresses binary"
    return spark.read.schema(f"{schema}, kind string").parquet(f"{path}/{name}").where(F.col("kind") == kind).drop("kind")


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """address, n, crc32 of the ids as 32-bit numbers; each body is held against its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for address, n, width, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(body).digest() != address or len(body) != n * width:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                sums.append(zlib.crc32(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["address", "n", "crc32"])

    return table(spark, path, "packed", "chunk").select("address", "n", "width", "body").mapInArrow(run, "address binary, n long, crc32 long")


def manifests(spark: SparkSession, path: str) -> list[tuple[int, int, bytes]]:
    """part, n and root of each part in order, held against the root of the store."""
    found = sorted(tuple(r) for r in table(spark, path, "recipes", "manifest").select("part", "n", "root").collect())
    if [summary(found)] != [(r["parts"], r["n"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/root").collect()]:
        raise ValueError("the manifests differ from the root of the store")
    return found


def summary(found: list[tuple[int, int, bytes]]) -> tuple[int, int, bytes]:
    return len(found), sum(n for _, n, _ in found), merkle_root([bytes(root) for _, _, root in found])


def check_parts(spark: SparkSession, path: str, found: list[tuple[int, int, bytes]]) -> None:
    """Fail unless the recipes of every part give the root of its manifest. A task holds one path of the tree."""
    wanted = {part: bytes(root) for part, _, root in found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree = None, Merkle()

        def done() -> pa.RecordBatch:
            if wanted.get(part) != tree.root():
                raise ValueError(f"part {part} differs from its manifest")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

        for batch in batches:
            for own, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != part:
                    if part is not None:
                        yield done()
                    part, tree = own, Merkle()
                tree.add(root)
        if part is not None:
            yield done()

    rows = table(spark, path, "recipes", "recipe").select("part", "position", "root")
    seen = rows.repartition("part").sortWithinPartitions("part", "position").select("part", "root").mapInArrow(run, "part int").collect()
    if {r["part"] for r in seen} != set(wanted):
        raise ValueError(f"no recipes of the parts {sorted(set(wanted) - {r['part'] for r in seen})}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: from the stored files, checked."""

    def addresses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, n_of = [], []
            for root, joined in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = addresses_of(joined)
                if merkle_root(own) != root:
                    raise ValueError("a recipe differs from its root")
                every += own
                n_of.append(len(own))
            spread = np.repeat(np.arange(batch.num_rows), n_of)
            at = np.concatenate([np.arange(k) for k in n_of]) if n_of else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(spread)), batch.column(1).take(pa.array(spread)), pa.array(at, pa.int64()), pa.array(every, pa.binary())], names=["part", "position", "at", "address"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros: dict[int, tuple[bytes, int]] = {}
        for batch in batches:
            sums, lengths = [], []
            for own in batch.column(2).to_pylist():
                crc, total = 0, 0
                for x in sorted(own, key=lambda x: x["at"]):
                    if x["n"] not in zeros:
                        zeros[x["n"]] = (z := bytes(4 * x["n"]), zlib.crc32(z))
                    z, nought = zeros[x["n"]]
                    crc, total = zlib.crc32(z, crc) ^ nought ^ x["crc32"], total + x["n"]
                sums.append(crc)
                lengths.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(lengths, pa.int64())], names=["part", "position", "ids_crc32", "n_tokens"])

    tune(spark)
    recipes = table(spark, path, "recipes", "recipe")
    uses = recipes.select("part", "position", "root", "addresses").mapInArrow(addresses, "part int, position long, at long, address binary")
    met = uses.join(checked_chunks(spark, path), "address").groupBy("part", "position").agg(F.collect_list(F.struct("at", "n", "crc32")).alias("own"))
    sums = met.select("part", "position", "own").mapInArrow(combined, "part int, position long, ids_crc32 long, n_tokens long")
    found = manifests(spark, path)
    check_parts(spark, path, found)
    before = spark.createDataFrame([(part, end - n) for (part, n, _), end in zip(found, accumulate(n for _, n, _ in found), strict=True)], "part int, before long")
    names = recipes.select("part", "position", "begin", "doc_id", "n").join(F.broadcast(before), "part")
    wrong = F.raise_error(F.lit("a recipe's chunks are missing or too long"))
    n_tokens = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(wrong.cast("long"))
    return names.join(sums, ["part", "position"], "left").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), n_tokens.alias("n_tokens"), "ids_crc32")


def reconstruct(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids (array of int) of the documents named in doc_ids (a column doc_id), from recipes and chunks."""
    own = table(spark, path, "recipes", "recipe").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    spread = own.select("doc_id", "part", "position", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("addresses") / 32).cast("int") - 1), lambda i: F.substring("addresses", i * 32 + 1, F.lit(32)))).alias("at", "address"))
    met = spread.join(table(spark, path, "packed", "chunk").select("address", "width", "body"), "address").groupBy("doc_id", "part", "position").agg(F.collect_list(F.struct("at", "width", "body")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(x["body"], f"<u{x['width']}").astype(np.int32) for x in sorted(own, key=lambda x: x["at"])]) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return met.select("doc_id", "own").mapInArrow(run, "doc_id long, ids array<int>")
