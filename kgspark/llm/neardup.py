"""MinHash near-dedup on SetSketch registers.

A document's set is its distinct shingles of consecutive words, A-Z lower-cased (words are runs of
characters other than blank and U+0009 to U+000D; with fewer words than a shingle has, all words are
one). A register holds the exponent, rounded down, of the smallest of the exponentially distributed
values of the set's elements: registers of a union are the larger ones of each pair, and two sets agree
in a register with a probability near their Jaccard similarity. Bands of registers name buckets.

Documents with equal sets are one class, a node of the graph, before anything is compared. Each class
is compared with the smallest of its bucket. In buckets that this leaves in several components, sizes bound
what can still be linked: two documents that share no rare shingle share at most what neither has of
rare ones. So pairs are first taken from the buckets, as far as that bound lets them reach the threshold:
with leading documents, those with the fewest rare shingles first, then with all others; and then
from the rare shingles, each of which a few documents have. No pair that shares a bucket and reaches
the threshold is passed over. Classes that are linked already need no comparison. A pair is first judged by
the maximum-likelihood estimate of its registers, and refused only if that lies more than six standard
errors under the bound; all others are confirmed on the full sets of their texts. With 32 bands of four
registers a pair at the bound of 0.8 shares no bucket with a chance of 5e-8.

Null and empty texts have an empty set and are linked with nothing; so are rows with a null doc_id, whose
component is null and which are kept. Rows of one doc_id are one document in what is linked, each of its
texts being compared by itself; each row is returned. A very long text is one set like any other, hashed
in the task that reads it. Ties need no rule: a component has one smallest id. A table without rows gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.checkpoints import counted, saved, scratch, small
from kgspark.operators import closure

from .common import tune

REGISTERS, ROWS = 128, 4
#: A shingle is rare if at most so many of the documents that are left have it.
RARE = 32
#: Members of a bucket that are paired in one block.
BLOCK = 256
#: Base, rate and largest exponent of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
SEEDS = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out *= STEP
        out += h[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; sets are not empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    for i, seed in enumerate(SEEDS):
        least[i] = np.minimum.reduceat(every * seed, starts)
    value = -np.log1p(-(least.T + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)) + LIMIT // 3, 0, LIMIT).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 128) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of rows of registers, given the sizes of the sets."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    most = np.minimum(u / v, v / u)
    at = most[:, None] * np.linspace(0, 1, steps + 1)[None, :]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(chance(u[:, None] - v[:, None] * at), 1e-12, 1), np.clip(chance(v[:, None] - u[:, None] * at), 1e-12, 1)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return at[np.arange(len(at)), fit.argmax(1)]


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, n_shingles, two keys of the set, registers (null for an empty set); docs has doc_id, text, mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(registers(full)) if full else iter(())
            marks = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None) for s in sets]
            own = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "mark", "n_shingles", "key1", "key2", "registers"])

    tune(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, mark long, n_shingles long, key1 long, key2 long, registers binary")


def confirm(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the bound; pairs carry sizes, registers and texts of both."""
    floor = percent / 100 - 6 * np.sqrt(0.25 / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            if doc not in memo:
                memo[doc] = shingles(text.as_py(), size)
                if len(memo) > 128:
                    memo.popitem(last=False)
            return memo[doc]

        for batch in batches:
            a, b, n_a, n_b, r_a, r_b = (c.to_pylist() for c in batch.columns[:6])
            t_a, t_b = batch.columns[6:]
            keep = []
            if a:
                look = lambda r: np.frombuffer(b"".join(r), "<u2").reshape(-1, REGISTERS)
                guess = likely_similarity(look(r_a), look(r_b), np.array(n_a, float), np.array(n_b, float))
                for i in np.flatnonzero(guess >= floor).tolist():
                    x, y = of(a[i], t_a[i]), of(b[i], t_b[i])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "registers_a", "registers_b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def each_shingle(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingle) for each distinct shingle of these documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))), pa.array(every.view(np.int64))], names=["node", "shingle"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingle long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, lead_turns: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest id reachable by links), kept."""
    with scratch(docs.sparkSession, broadcast=False):
        return saved(_near_duplicates(docs, size, percent, lead_turns, doc_id, text), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, size: int, percent: int, lead_turns: int, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))  # tells the texts of one id apart
    sketches = saved(sketch(own, size), "sketches")
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    sets = known.groupBy("key1", "key2").agg(first, F.min("n_shingles").alias("n"), F.min_by("registers", "doc_id").alias("registers"))
    classes = saved(sets.select(F.monotonically_increasing_id().alias("node"), "key1", "key2", "first.doc_id", "first.mark", "n", "registers"), "classes")
    again = saved(known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("key1").alias("low"), F.max("key1").alias("high")).where("rows > 1"), "again", several=F.count_if(F.expr("low <> high")))

    width = 2 * ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width)))))
    bands = classes.select("node", "n", band.alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("hub"), F.min("n").alias("least")).where("members > 1").drop("members")
    members = saved(bands.join(shared, "bucket"), "members")  # bucket, node, n, hub, least

    def nodes_of(rows: DataFrame) -> DataFrame:
        return saved(rows.select("node").distinct(), "nodes")

    picked = saved(classes.join(small(nodes_of(members)), "node", "left_semi").select("node", "doc_id", "mark"), "picked")
    texts = own.join(small(picked), ["doc_id", "mark"])
    texts = texts.dropDuplicates(["doc_id", "mark"]) if counted(again) else texts
    texts = saved(texts.select("node", "text").join(classes.select("node", "n", "registers"), "node"), "texts")

    def checked(pairs: DataFrame) -> DataFrame:
        side = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"), F.col("text").alias(f"text_{x}"))
        near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
        return confirm(pairs.join(side("a"), "a").join(side("b"), "b").where(near), size, percent)

    tested = [saved(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "tested")]
    links = checked(tested[0])
    if counted(again, "several"):  # texts of one id are one document
        at = known.join(small(again).where("low <> high"), "doc_id", "left_semi").join(classes.select("key1", "key2", "node"), ["key1", "key2"]).select("doc_id", "node").distinct()
        links = links.union(at.join(at.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b"))
    labels = closure.components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(small(labels), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    def shingles_of(rows: DataFrame) -> DataFrame:
        return each_shingle(texts.join(small(nodes_of(rows)), "node", "left_semi"), size)

    def able(own: str):
        """Whether a document with so many shingles of its own can be linked with any in its bucket."""
        return (F.col("n") - F.col(own)) * (100 + percent) - F.col("n") * percent >= F.col("least") * percent

    def feasible(a: Callable[[str], Column], b: Callable[[str], Column], own: str) -> Column:
        most = F.least(a("n") - a(own), b("n") - b(own))
        return (a("label") != b("label")) & (most * 100 >= (a("n") + b("n") - most) * percent)

    def linked_more(met: DataFrame) -> DataFrame:
        """The labels after the pairs (a, b) of met that were not compared before are."""
        fresh = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for earlier in tested:
            fresh = fresh.join(small(earlier), ["a", "b"], "left_anti")
        tested.append(saved(fresh, "fresh"))
        return closure.merged(labels, saved(checked(tested[-1]), "links")) if counted(tested[-1]) else labels

    def mixed(rows: DataFrame, *more: Column) -> DataFrame:
        """The buckets that hold several components."""
        found = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), *more)
        return saved(found.where("low <> high").drop("low", "high"), "mixed")

    split = members.join(small(mixed(labelled(members.select("bucket", "node")))).select("bucket"), "bucket", "left_semi")
    split = saved(split.select("bucket", "node", "n", "least"), "split")
    if counted(split):
        # What no other document has bounds a document by itself, so most need no further look.
        alone = shingles_of(split).groupBy("shingle").agg(F.count("*").alias("docs"), F.min("node").alias("node")).where("docs = 1").groupBy("node").agg(F.count("*").alias("own"))
        split = saved(split.join(small(saved(alone, "alone")), "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(able("own")).drop("own"), "split")
    if counted(split):
        each = saved(shingles_of(split), "each")
        times = saved(each.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("node").alias("node")).where(F.col("docs") <= RARE), "rare")
        few = saved(each.join(times.where("docs > 1").select("shingle"), "shingle"), "few")  # shingle, node
        own_of = times.where("docs = 1").select("node", F.lit(1).alias("u")).unionAll(few.select("node", F.lit(0).alias("u")))
        sizes = split.groupBy("node").agg(F.min("n").alias("n")).join(own_of.groupBy("node").agg(F.sum("u").alias("u"), F.count("*").alias("r")), "node", "left").na.fill(0)
        sizes = saved(sizes, "sizes")  # u: shingles that no other document has; r: those and the rare ones
        active = saved(split.select("bucket", "node", "least").join(small(sizes), "node").where(able("r")).select("bucket", "node", "n", "u", "r"), "active")

        part = lambda x: lambda c: F.col(f"{c}_{x}")
        side = lambda x, *keys: [F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "r", "label")), *keys]
        for turn in range(lead_turns if counted(active) else 0):
            now = saved(labelled(active), "labelled")
            order = F.col("r") / F.col("n") if turn == 0 else F.xxhash64("node", F.lit(turn))
            lead = mixed(now, F.min_by(F.struct(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n", "r", "label"))), order).alias("lead"))
            labels = linked_more(now.select("bucket", *side("a")).join(small(lead).select("bucket", "lead.*"), "bucket").where(feasible(part("a"), part("b"), "r")))
        if counted(active):  # all others, in blocks of a bucket, each pair in the first of its common buckets
            now = saved(labelled(active), "labelled")
            left = now.join(small(mixed(now)).withColumn("blocks", F.ceil(F.col("members") / BLOCK)).drop("members"), "bucket")
            left = left.join(now.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node")
            a = left.select("bucket", *side("a", F.col("buckets").alias("buckets_a")), F.pmod(F.xxhash64("node"), "blocks").alias("block"))
            b = left.select("bucket", *side("b", F.col("buckets").alias("buckets_b")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
            once = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
            labels = linked_more(a.join(b, ["bucket", "block"]).where((F.col("a") < F.col("b")) & feasible(part("a"), part("b"), "r") & once))
        # Pairs that share a rare shingle, of which a few documents have each.
        of = F.collect_list(F.struct("node", "n", "u", "label"))
        meet = labelled(few.join(small(sizes), "node")).groupBy("shingle").agg(of.alias("of"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        pairs = F.flatten(F.transform("of", lambda x: F.transform(F.filter("of", lambda y: (x["node"] < y["node"]) & feasible(lambda c: x[c], lambda c: y[c], "u")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
        labels = linked_more(meet.select(F.explode(pairs).alias("pair")).select("pair.*"))

    least = saved(labels.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    least = small(saved(labels.join(small(least), "component").select("node", "least"), "least"))
    found = classes.select("node", "key1", "key2", "doc_id").join(least, "node", "left").select("key1", "key2", F.coalesce("least", "doc_id").alias("least"))
    out = sketches.join(found, ["key1", "key2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that near_duplicates keeps, one row for each doc_id, with the columns of docs."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("_id"))
    repeated = not kept.where("_id is not null").groupBy("_id").count().where("count > 1").isEmpty()
    out = docs.join(kept.where("_id is not null").distinct() if repeated else kept.where("_id is not null"), docs["doc_id"] == kept["_id"], "left_semi")
    out = out.dropDuplicates(["doc_id"]) if repeated else out
    return out.unionByName(docs.where("doc_id is null"))
