import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kgspark.llm import bpe, packing, store
from kgspark.llm.common import word_memo

from .helpers import corpus, frame

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_both_memos_agree_with_the_library(libraries):
    word, byte = libraries
    memo, own = word_memo(WORD), bpe.byte_bpe(BYTE)
    rng = random.Random(3)
    alphabet = "abcXYZéÉßÄñşŞıİŉſΣσς中ª²½_'.,!|<>*-  \n\t\r\x0b\x1c\x85\xa0　́​0123"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 15))) for _ in range(3000)]
    for t in [*texts, *(t for _, t in corpus() if t is not None), "<|endoftext|>", "A<|ENDOFTEXT|>b", "<|startoftext|>x", "x" * 500]:
        assert ids_of(memo.ids(t)) == word.encode(t, add_special_tokens=False).ids, t
        mine = ids_of(own.ids(t))
        assert mine == byte.encode(t, add_special_tokens=False).ids, t
        assert own.decode(mine) == byte.decode(mine, skip_special_tokens=False), t


def test_small_memos_forget_and_stay_right(libraries):
    own = bpe.ByteBpe(BYTE, entries=3)
    text = "the quick brown fox jumps over the lazy dog and the quick fox"
    assert ids_of(own.ids(text)) == libraries[1].encode(text, add_special_tokens=False).ids


def test_stale_entries_are_skipped():
    ranks = {(1, 2): (0, 10), (2, 3): (1, 11), (10, 3): (2, 12)}
    assert bpe.merge_symbols([1, 2, 3], ranks) == [12]
    assert bpe.merge_symbols([1, 2, 1, 2], ranks) == [10, 10]
    assert bpe.merge_symbols([3, 3], ranks) == [3, 3]


def test_round_trip_table(spark, libraries):
    rows = corpus()
    got = bpe.round_trip(frame(spark, rows), BYTE).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        ids = libraries[1].encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    encoded = bpe.encode(frame(spark, rows), BYTE)
    assert sorted((r["text"] or "") for r in bpe.decode(encoded, BYTE).collect()) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(frame(spark, []), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_plan_packs_every_token_once_and_fills_every_window(lengths):
    windows = packing.plan(lengths)
    seen = {i: [] for i in range(len(lengths))}
    for window, pieces in windows:
        assert window & (window - 1) == 0 and window <= 4096
        assert sum(p[2] for p in pieces) == window
        for doc, start, length in pieces:
            seen[doc].append((start, length))
    for doc, own in seen.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == lengths[doc]


def test_step_groups_are_balanced():
    sizes = [4096] * 20 + [512] * 64
    group = packing.step_groups(sizes, 16_384)
    load = [sum(s for s, g in zip(sizes, group, strict=True) if g == k) for k in set(group)]
    assert max(load) - min(load) <= 4096


def test_packed_table(spark, libraries):
    rows = corpus()
    df = packing.pack(frame(spark, rows), WORD, block_tokens=3000)
    got = df.collect()
    encoded = [(d, libraries[0].encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    by_sequence, by_doc = {}, {}
    for r in got:
        ids = ids_of(r["ids"])
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["window"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for own in by_sequence.values():
        at = 0
        for offset, length, window in sorted(own):
            assert offset == at
            at += length
        assert at == window <= 4096
    rebuilt = {k[0]: [x for _, ids in sorted(v) for x in ids] for k, v in by_doc.items() if k[0] != 5}  # the id 5 stands for two rows
    assert rebuilt == {d: e for d, e in encoded if d != 5}
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == sum(len(e) for d, e in encoded if d == 5)
    assert packing.pack(frame(spark, []), WORD).count() == 0


def test_store_round_trip_and_damage(spark, libraries, tmp_path):
    rows = corpus()
    path = f"file://{tmp_path}/store"
    store.write(frame(spark, rows), path, WORD)
    got = [tuple(r) for r in store.read(spark, path).collect()]
    assert len(got) == len(rows)
    encoded = [(d, np.array(libraries[0].encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for d, t in rows]
    assert sorted((-1 if d is None else d, n, c) for d, _, n, c in got) == sorted((-1 if d is None else d, len(e), zlib.crc32(e.tobytes())) for d, e in encoded)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [(-1 if d is None else d) for d, start, _, _ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)
    back = store.reconstruct(spark, path, spark.createDataFrame([(7,), (120,)], "doc_id long"))
    assert {r["doc_id"]: r["ids"] for r in back.collect()} == {d: e.tolist() for d, e in encoded if d in (7, 120)}
    chunks = store.table(spark, path, "packed", "chunk")
    assert chunks.count() == chunks.select("address").distinct().count()
    bad = chunks.selectExpr("address", "doc_id", "n", "width", "cast(reverse(cast(body as string)) as binary) as body", "'chunk' as kind").limit(3)
    bad.write.mode("append").partitionBy("kind").parquet(f"{path}/packed")
    with pytest.raises(Exception, match="damaged"):
        store.read(spark, path).collect()


def test_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    store.write(frame(spark, []), path, WORD)
    assert store.read(spark, path).count() == 0


def test_merkle_roots_follow_order_and_content():
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    pair = hashlib.sha256(a + b).digest()
    assert store.merkle_root([a]) == a
    assert store.merkle_root([a, b]) == pair
    assert store.merkle_root([a, b, c]) == hashlib.sha256(pair + c).digest()
    assert store.merkle_root([b, a]) != pair


def test_cuts_follow_content():
    ids = np.random.Generator(np.random.PCG64(1)).integers(0, 40_000, 20_000).astype("<u4")
    ends = store.cuts(len(ids), store.marks(ids).tolist())
    assert ends[-1] == len(ids) and ends == sorted(set(ends))
    assert all(b - a <= store.MOST for a, b in zip([0, *ends], ends, strict=False))
    shifted = np.concatenate([ids[:37], ids])

    def pieces(x):
        ends = store.cuts(len(x), store.marks(x).tolist())
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    assert len(pieces(ids) & pieces(shifted)) >= len(pieces(ids)) - 2


def test_many_texts_at_once_agree_with_the_library(libraries, monkeypatch):
    from kgspark.llm import common

    rng = random.Random(5)
    alphabet = "abcXYZéÉßÄñşŞıİŉſΣσς中ª²½÷×_'.,!|<>*-  \n\t\r\x0b\x1c\x85\xa0　́​0123"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(2000)]
    texts += [t for _, t in corpus()] + [None, "", " ", "don't. we're! l'été, straße... 日本. a<|endoftext|>b", "Ab, " * 4000, "x" * 9000]
    for piece in (common.PIECE, 50):
        monkeypatch.setattr(common, "PIECE", piece)
        ids, counts = common.WordMemo(WORD, entries=1000).many(texts)
        at = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == libraries[0].encode(t or "", add_special_tokens=False).ids, t
            at += n
        assert at == len(ids)


def test_a_file_with_other_rules_goes_through_the_whole_tokenizer(tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    memo, tok = word_memo(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    text = "The Quick, brown\nFox"
    assert memo.many([text])[0].tolist() == ids_of(memo.ids(text)) == tok.encode(text, add_special_tokens=False).ids != Tokenizer.from_file(WORD).encode(text).ids
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "bytes.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.ByteBpe(str(tmp_path / "bytes.json"))


def test_a_lost_part_is_noticed(spark, tmp_path):
    import glob
    import os
    import shutil

    rows = [(i, f"text number {i} " * 9) for i in range(60)]
    whole = f"{tmp_path}/whole"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write(frame(spark, rows), f"file://{whole}", WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.read(spark, f"file://{whole}").count() == 60
    for kinds in (("recipe", "manifest"), ("recipe",), ("manifest",)):
        cut = f"{tmp_path}/cut-{len(kinds)}-{kinds[0]}"
        shutil.copytree(whole, cut)
        lost = sorted(f for k in kinds for f in glob.glob(f"{cut}/recipes/kind={k}/part-00001-*.parquet"))
        assert lost, "the store has several parts"
        for f in lost:
            os.remove(f)
        with pytest.raises(Exception, match="root of the store|no recipes|missing"):
            store.read(spark, f"file://{cut}").collect()


def test_equal_ids_have_one_address(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write(frame(spark, [(i, "the same words " * 30 + ("\U0001f600 " * (i % 2))) for i in range(0, 200, 2)] + [(500, "the same words " * 30)]), path, WORD)
    assert store.table(spark, path, "packed", "chunk").select("width").distinct().count() == 1
    assert store.table(spark, path, "packed", "chunk").count() == 1
