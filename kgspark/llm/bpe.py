"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by joining vocabulary strings.

Null text is empty text. An empty text has no ids and decodes to the empty text. Tables without rows
give results without rows; repeated rows are encoded one by one; other columns are ignored. A very long
text is encoded whole, by the row. Of equal ranks the leftmost pair is merged first. A file whose rules
before the merges are not those of a plain byte-level BPE is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_ALPHABET, MEMO_ENTRIES, UNSAFE_BLANK, WHITE, Memo, map_rows, renamed


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the symbols of one pre-token, lowest rank first and leftmost among equals.

    Symbols form a doubly linked list over their first positions. The queue holds (rank, position,
    left, right); an entry is stale when either symbol has changed since, and is skipped.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    if n == 2:
        hit = ranks.get((symbols[0], symbols[1]))
        return [hit[1]] if hit else symbols
    sym = [*symbols]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        if hit := ranks.get((sym[i], sym[i + 1])):
            queue.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue
        sym[i], sym[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if hit := ranks.get((made, sym[k])):
                heapq.heappush(queue, (hit[0], i, made, sym[k], hit[1]))
        if (h := before[i]) >= 0 and (hit := ranks.get((sym[h], made))):
            heapq.heappush(queue, (hit[0], h, sym[h], made, hit[1]))
    return [s for s in sym if s >= 0]


class ByteBpe(Memo):
    """A byte-level BPE read from a tokenizer file, with a bounded memo of encoded chunks."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES) -> None:
        import regex

        super().__init__(entries)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: normalizer, pre_tokenizer or added tokens are not those of a plain byte-level BPE")
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of_byte = BYTE_ALPHABET
        to_byte = {c: b for b, c in of_byte.items()}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed([*enumerate(pairs)])}
        self.first = [vocab[of_byte[b]] for b in range(256)]
        both = vocab | added
        self.strings = [b""] * (max(both.values()) + 1)
        for token, i in both.items():
            self.strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.decimal = [str(i) for i in range(len(self.strings))]
        self.added = added
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

    def token(self, piece: str) -> bytes:
        first = self.first
        return b"".join(i.to_bytes(4, "little") for i in merge_symbols([first[b] for b in piece.encode()], self.ranks))

    def encoded(self, chunk: str) -> bytes:
        pieces = self.split(chunk)
        return self.token(chunk) if len(pieces) == 1 else b"".join([self[p] for p in pieces])

    def _plain(self, text: str) -> bytes:
        if UNSAFE_BLANK.search(text):
            return b"".join(map(self.__getitem__, self.split(text)))
        head, *rest = text.split(" ")  # a blank behind a visible character always begins a pre-token
        return (self[head] if head else b"") + b"".join([self[x] for x in map(" ".__add__, rest)])

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.specials and any(t in text for t in self.added):
            parts = self.specials.split(text)
            return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self._plain(p) for p in parts if p)
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text."""

    def make():
        bpe = byte_bpe(path)
        return lambda d, t: (d, np.frombuffer(bpe.ids(t), "<u4"))

    return map_rows(renamed(docs, {"doc_id": doc_id, "text": text}), ["doc_id", "text"], make, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: vocabulary strings of the ids, joined; bytes that are no UTF-8 become U+FFFD."""

    def make():
        bpe = byte_bpe(path)
        return lambda d, ids: (d, bpe.decode(ids or []))

    return map_rows(encoded, ["doc_id", "ids"], make, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass without a shuffle."""

    def make():
        bpe = byte_bpe(path)

        def row(d, t):
            ids = np.frombuffer(bpe.ids(t), "<u4").tolist()
            listed = ",".join(map(bpe.decimal.__getitem__, ids))
            return d, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

        return row

    return map_rows(
        renamed(docs, {"doc_id": doc_id, "text": text}), ["doc_id", "text"], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    )
