"""What the operators of this subpackage share: Arrow mapping, tokenizer memos."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker. Texts may be long, so batches are short.
BATCH_ROWS = 64
#: Bytes of texts that are looked at together where that saves time, and characters of a text encoded at once.
WINDOW_BYTES, PIECE = 8 << 20, 4 << 20
#: Entries of each of the two generations of a memo of encoded chunks. It changes speed alone.
MEMO_ENTRIES, WORD_ENTRIES = 500_000, 450_000


def tune(spark: SparkSession) -> None:
    """Short Arrow batches, so that a worker's memory follows a few texts and not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def windows(batches: Iterator[pa.RecordBatch], column: int, limit: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, joined up to about so many bytes of the column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., tuple | None]],
    schema: str,
    arrow: pa.Schema,
    repeat: bool = False,
) -> DataFrame:
    """Apply a Python function to the given columns of each row, batch by batch.

    make() runs once in a task and returns the row function; with repeat that returns a list of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)
            out = [y for x in rows for y in row(*x)] if repeat else [row(*x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)] if out else [pa.array([], t) for t in arrow.types],
                names=arrow.names,
            )

    tune(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def renamed(df: DataFrame, wanted: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The wanted columns under the operator's own names; other columns cannot clash, as they go."""
    return df.select(*(F.col(f"`{v}`").alias(k) for k, v in wanted.items()), *(F.col(f"`{c}`") for c in keep or []))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_ALPHABET = byte_alphabet()
#: ASCII characters that are neither letters, digits nor white space.
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


class Memo(dict):
    """Encoded chunks of text. At its bound the entries become the older generation, from which those
    that are met again come back, so frequent chunks stay. A worker keeps it from task to task."""

    def __init__(self, entries: int = MEMO_ENTRIES) -> None:
        self.entries, self.older = entries, {}

    def encoded(self, chunk: str) -> bytes:
        raise NotImplementedError

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self.encoded(chunk)
        if len(self) >= self.entries:
            self.older = self.copy()
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


#: Of each byte of lower-cased UTF-8: 0 blank, 1 of a letter (a-z, and those from U+00C0 to U+00FF), 2 sign, 3 any other.
BYTE_KIND = np.array([0 if b == 0x20 else 1 if 0x61 <= b <= 0x7A or b == 0xC3 or 0x80 <= b <= 0xBF and b not in (0x97, 0xB7) else 2 if chr(b) in SIGNS else 3 for b in range(256)], np.uint8)
#: How the word-level tokenizer must treat a text before its merges, fixed values of its file.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordMemo(Memo):
    """A word-level BPE, giving little-endian unsigned 32-bit ids.

    The tokenizer drops white space and no merge, normal form or lower-casing reaches over a blank or
    a line break, so the ids of a text are those of its chunks in order. Letters with signs behind them
    are two pre-tokens, whose ids are looked up one by one. A word of letters below U+0180 is in normal
    form already: its lower-cased bytes go to the tokenizer's merges directly, all else through the whole tokenizer.
    A file that treats texts in another way is used through the whole tokenizer alone.
    """

    def __init__(self, path: str, entries: int = WORD_ENTRIES) -> None:
        from tokenizers import Tokenizer

        super().__init__(entries)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.known = spec["normalizer"] == WORD_NORMALIZER and split.get("pattern") == {"Regex": WORD_SPLIT} and all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.merges = self.tok.model.tokenize
        self.largest = max(self.tok.get_vocab().values())

    def encoded(self, chunk: str) -> bytes:
        if not chunk.isalpha():
            core = chunk.rstrip(SIGNS)
            if len(core) < len(chunk) and core.isalpha() and core[-1] != "\u0130":  # that one lower-cases to a letter and a mark
                return self[core] + self[chunk[len(core) :]]
        else:
            low = chunk.lower()
            if low != chunk and low.isascii():
                return self[low]
            if low.isalpha() and max(low) < "\u0180":
                shown = low if low.isascii() else "".join([BYTE_ALPHABET[b] for b in low.encode()])
                return array("I", [t.id for t in self.merges(shown)]).tobytes()
        return array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()

    def whole(self, text: str) -> bool:
        """Whether a text must go through the tokenizer in one piece: "<|" may begin a special token, told by case."""
        return not self.known or "<|" in text

    def chunks(self, text: str) -> str:
        """The text with one blank between its chunks, lower-cased where the tokenizer does that by character, so chunks that differ in case alone are one."""
        try:
            if not text.isascii():
                text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole(text):
            if not self.known:
                return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.__getitem__, self.chunks(text).split(" ")))

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind another, and how many each has."""
        out, counts = [], np.zeros(len(texts), np.int64)
        held: list[str] = []
        of: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                ids, n = self.block(held)
                out.append(ids)
                np.add.at(counts, of, n)
                held.clear()
                of.clear()
                size = 0

        for i, t in enumerate(texts):
            if t and self.whole(t):
                flush()
                out.append(np.frombuffer(self.ids(t), "<u4"))
                counts[i] = len(out[-1])
                continue
            t, at = self.chunks(t or ""), 0
            while at <= len(t):  # a very long text in pieces that end before a blank
                end = len(t) if len(t) - at <= PIECE or (end := t.find(" ", at + PIECE)) < 0 else end
                held.append(t[at:end])
                of.append(i)
                size += end - at
                at = end + 1
                if size >= PIECE:
                    flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, "<u4"), counts

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As many(), for texts as chunks() gives them. Each distinct chunk is looked up once.

        Signs behind a word of letters are made a chunk of their own, so that the memo holds the word once.
        """
        parts = [t.encode() for t in texts]
        body = np.frombuffer(b" " + b" ".join(parts), np.uint8)
        starts = np.cumsum([len(p) + 1 for p in parts])
        kind, at = BYTE_KIND[body], np.flatnonzero(body == 0x20)
        signs = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
        mixed = np.zeros(len(at), bool)
        mixed[np.searchsorted(at, np.flatnonzero((kind[1:] == 3) | (kind[1:] == 1) & (kind[:-1] == 2)) + 1) - 1] = True
        signs = signs[~mixed[np.searchsorted(at, signs) - 1]]
        starts += np.searchsorted(signs, starts)
        body = np.insert(body, signs, 0x20)
        at = np.flatnonzero(body == 0x20)
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(body)).astype("<i4")), pa.py_buffer(body)]).dictionary_encode()
        _, offsets, own = cut.dictionary.buffers()
        own = own[1 : int(np.frombuffer(offsets, "<i4")[len(cut.dictionary)])].to_pybytes().decode()
        found = [*map(self.__getitem__, own.split(" "))]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat, index = np.frombuffer(b"".join(found), "<u4"), cut.indices.to_numpy()
        counts = lengths[index]
        ends = np.cumsum(counts)
        ids = np.repeat((np.cumsum(lengths) - lengths)[index] - (ends - counts), counts)
        ids += np.arange(len(ids))
        return flat[ids], np.diff(ends[np.searchsorted(at, starts) - 1], prepend=0)


@lru_cache(maxsize=4)
def word_memo(path: str) -> WordMemo:
    return WordMemo(path)


#: White space as the byte-level pre-tokenizer sees it (Unicode White_Space), fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNSAFE_BLANK = re.compile(f"[{WHITE}] ")
