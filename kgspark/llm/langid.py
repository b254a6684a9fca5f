"""Language ID: nearest centroid among several clustered centroids for each language.

A text becomes a vector of hashed byte trigrams of its lower-cased letters, weighted by the root of
their counts and by inverse document frequency over all labelled documents, of length 1. Each language
has a few centroids from spherical k-means over a bounded sample of its vectors; the language of the
nearest centroid by cosine is predicted. A text farther from that centroid than the language's bound is
rejected: the bound is a share of the smallest similarity but for a few of the sample.

Null texts and texts without a letter are `und` with score 0 and are rejected. Documents with a null
language or id, or under `least_letters` bytes of letters, teach nothing. With no documents to learn from, every text is
`und`. A very long text is one vector, made piece by piece. Equal cosines give the first language in
alphabetical order. A table without rows gives none.

Every language is learned, each in a task of its own that sends the driver its centroids. It is learned
from at most `sample` documents, those with the smallest hashes of their ids among the ones with enough
letters; there an id counts once however many rows it has, with the smallest of their vectors. Document
frequencies count every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

WIDTH = 1 << 12
LETTER = regex.compile(r"\p{L}")
#: ASCII other than a-z becomes blank; bytes of other characters stay.
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
BLANKS = re.compile(rb" +")
PIECE = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams; runs of other characters count as one blank."""
    body = np.frombuffer(b" " + BLANKS.sub(b" ", text.lower().encode().translate(LETTERS)) + b" ", np.uint8)
    out = np.zeros(WIDTH, np.int64)
    for at in range(0, len(body) - 2, PIECE):
        b = body[at : at + PIECE + 2].astype(np.uint32)
        out += np.bincount(((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2_654_435_761)) >> np.uint32(20), minlength=WIDTH)
    return out


@dataclass
class Model:
    weights: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    bounds: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.sqrt(np.array([trigrams(t) for t in texts], np.float32).reshape(-1, WIDTH)) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, similarity to the nearest centroid, rejected) of each text."""
        out = [("und", 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if at:
            near = self.vectors([texts[i] for i in at]) @ self.centroids.T
            for i, c, s in zip(at, near.argmax(1).tolist(), near.max(1).tolist(), strict=True):
                out[i] = (self.languages[c], min(1.0, max(0.0, s)), s < self.bounds[c])
        return out


def clustered(x: np.ndarray, k: int, turns: int = 12, starts: int = 6, least: float = 0.05) -> np.ndarray:
    """Spherical k-means from several k-means++ starts: the one with most clusters, then the nearest to its members.

    A cluster under the share `least` of the rows is given up, the smallest first, and its rows go to the others.
    """
    rng = np.random.default_rng(0)

    def settled(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(turns):
            own = (x @ c.T).argmax(1)
            c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return c, np.bincount((x @ c.T).argmax(1), minlength=len(c))

    best, found = (0, 0.0), x[:1]
    for _ in range(starts):
        chosen = [x[rng.integers(len(x))]]
        while len(chosen) < min(k, len(x)):
            far = np.maximum(1 - (x @ np.array(chosen).T).max(1), 0).astype(np.float64)
            if far.sum() < 1e-4:
                break
            chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        c, sizes = settled(np.array(chosen))
        while len(c) > 1 and sizes.min() < max(1, least * len(x)):
            c, sizes = settled(np.delete(c, sizes.argmin(), 0))
        if (mark := (len(c), float((x @ c.T).max(1).sum()))) > best:
            best, found = mark, c
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, sample: int = 400, clusters: int = 4, least_letters: int = 40, slack: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows of labelled, which holds no row that is kept for judging."""
    own = labelled.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("doc_id is not null and text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by trigram, their number, and by language those with enough letters to learn from."""
        seen, n, able = np.zeros(WIDTH, np.int64), 0, Counter()
        for batch in batches:
            for t, own_lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = trigrams(t)
                seen += grams > 0
                n += 1
                able[own_lang] += int(grams.sum() >= least_letters)
        langs = sorted(able)
        columns = [pa.array([*range(WIDTH + 1), *[-1] * len(langs)], pa.int32()), pa.array([None] * (WIDTH + 1) + langs, pa.string()), pa.array([*seen.tolist(), n, *(able[k] for k in langs)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["gram", "lang", "docs"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each language and mark the smallest counts; a task meets few marks, repeated rows share one."""
        least: dict[tuple[str, int], bytes] = {}
        for batch in batches:
            for mark, own_lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grams := trigrams(t)).sum() >= least_letters:
                    own = grams.astype("<u4").tobytes()
                    least[own_lang, mark] = min(own, least.get((own_lang, mark), own))
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([m for _, m in least], pa.int64()), pa.array([k for k, _ in least], pa.string()), pa.array([*least.values()], pa.binary())], names=["mark", "lang", "counts"])

    tune(labelled.sparkSession)
    seen, counts = np.zeros(WIDTH + 1), {}
    for r in own.select("text", "lang").mapInArrow(frequencies, "gram int, lang string, docs long").groupBy("gram", "lang").agg(F.sum("docs").alias("docs")).collect():
        if r["lang"] is None:
            seen[r["gram"]] = r["docs"]
        elif r["docs"]:
            counts[r["lang"]] = r["docs"]
    weights = (np.log((1 + seen[WIDTH]) / (1 + seen[:WIDTH])) + 1).astype(np.float32)
    model = Model(weights, np.zeros((0, WIDTH), np.float32), [], np.zeros(0))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (1.5 * sample + 50) / n) * (1 << 30))))) if counts else F.lit(None)
    picked = own.where(mark < share[F.col("lang")]) if counts else own.limit(0)

    def centroids_of(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("mark").to_pylist(), table.column("counts").to_pylist(), strict=True))[:sample]
        x = np.sqrt(np.array([np.frombuffer(c, "<u4") for _, c in rows], np.float32)) * weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = clustered(x, clusters)
        bound = slack * float(np.quantile((x @ c.T).max(1), 0.005))
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * len(c), pa.string()), pa.array([r.astype("<f4").tobytes() for r in c], pa.binary()), pa.array([bound] * len(c), pa.float64())], names=["lang", "centroid", "bound"])

    sampled = picked.select(mark.alias("mark"), "lang", "text").mapInArrow(vectors, "mark long, lang string, counts binary").groupBy("lang", "mark").agg(F.min("counts").alias("counts"))
    found = sorted(tuple(r) for r in sampled.groupBy("lang").applyInArrow(centroids_of, "lang string, centroid binary, bound double").collect())
    centroids = [np.frombuffer(c, "<f4").reshape(1, WIDTH) for _, c, _ in found]
    model.languages, bounds = [lang for lang, _, _ in found], [bound for _, _, bound in found]
    if centroids:
        model.centroids, model.bounds = np.concatenate(centroids).astype(np.float32), np.array(bounds)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns named, lang_pred, score (cosine, 0 to 1) and rejected."""
    names = columns if columns is not None else docs.columns
    own = docs.select(F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(0).to_pylist())
            own = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=[*names, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    tune(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return own.mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score, rejected. Held-out documents teach nothing."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), **options)
    found = predict(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with the columns of docs."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), **options)
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    found = predict(own, model, text=f"c{names.index('text')}").where(~F.col("rejected"))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
