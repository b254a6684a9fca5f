import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kgspark.llm import chat, langid, quality

from .helpers import words
from .test_texts import brute_components, brute_substrings


def brute_pair(chosen, rejected):
    key = lambda t: (t[0], t[1] or "user", (t[2] or "").replace("<|", "< |"))
    a, b = ([key(t)[1:] for t in sorted(x, key=key)] for x in (chosen, rejected))
    n = 0
    while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
        n += 1

    def shown(turns):
        text, mask = "", []
        for role, said in turns:
            text += f"<|{role}|>\n"
            if role == "assistant":
                mask.append((len(text), len(text) + len(said)))
            text += said + "<|end|>\n"
        return text, mask

    return n, shown(a[:n])[0], *shown(a[n:]), *shown(b[n:])


def test_preferences_match_brute_force(spark):
    rng = random.Random(8)
    sides = ({}, {})
    for p in range(40):
        common = [(i, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "", None, "a <|end|> b", "é日"])) for i in range(rng.randrange(5))]
        for side in sides:
            side[p] = common + [(len(common) + i, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "perhaps so"])) for i in range(rng.randrange(3))]
    sides[0][40], sides[1][40] = [(0, "user", "q"), (0, "user", "q")], [(0, "user", "q"), (1, "assistant", "r")]
    frames = [spark.createDataFrame([(p, *t) for p, own in s.items() for t in own] + [(None, 0, "user", "x")], "pair_id long, turn long, role string, text string") for s in sides]
    got = {r["pair_id"]: r for r in chat.preferences(*frames).collect()}
    assert set(got) == {p for p in sides[0] if sides[0][p] and sides[1][p]}
    for p, r in got.items():
        spans = lambda m: [(x["first"], x["behind"]) for x in m]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], spans(r["chosen_mask"]), r["rejected"], spans(r["rejected_mask"])) == brute_pair(sides[0][p], sides[1][p]), p
    assert chat.preferences(frames[0].limit(0), frames[1]).count() == 0
    plan = chat.preferences(*frames)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_swapped_answers_pair_neighbours(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "A"), (0, 2, "user", "more"), (1, 0, "user", "p"), (1, 1, "assistant", "B"), (2, 0, "user", "alone"), (3, 0, "assistant", "C"), (None, 0, "assistant", "D")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.preferences(*chat.swapped_answers(df)).collect()}
    assert set(got) == {0, 1}
    assert got[0]["prompt"] == "<|user|>\nq<|end|>\n" and "A" in got[0]["chosen"] and "B" in got[0]["rejected"]


def brute_branched(rows):
    own = {}
    for c, *t in rows:
        if c is not None:
            own.setdefault(c, []).append((t[0], t[1] or "user", t[2] or ""))
    own = {c: sorted(t) for c, t in own.items()}
    answers = lambda c: [i for i, t in enumerate(own[c]) if t[1] == "assistant"]
    ids = sorted(c for c in own if answers(c))
    want = {}
    for c, turns in own.items():
        other = ids[(ids.index(c) + 1) % len(ids)] if c in ids else c
        if other == c:
            clean = [(r, x.replace("<|", "< |")) for _, r, x in turns]
            want[c] = (len(turns), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in clean), None, None, None, None)
        else:
            k = c % min(len(answers(c)), len(answers(other)))
            both = turns, turns[: answers(c)[k]] + own[other][answers(other)[k] :]
            want[c] = brute_pair(*([(i, r, x) for i, (_, r, x) in enumerate(t)] for t in both))
    return want


def check_branched(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spans = lambda m: m and [(x["first"], x["behind"]) for x in m]
    found = chat.preferences(*chat.branched(df), one_sided=True)
    got = found.collect()
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()
    mine = {r["pair_id"]: (r["n_prompt_turns"], r["prompt"], r["chosen"], spans(r["chosen_mask"]), r["rejected"], spans(r["rejected_mask"])) for r in got}
    assert len(got) == len(mine) and mine == brute_branched(rows)
    return mine


def test_branched_gives_every_conversation_a_row(spark):
    rng = random.Random(9)
    rows = [(None, 0, "assistant", "D"), (7, 0, "user", "alone"), (-5, 0, "assistant", "C <| c"), (1 << 60, 3, "assistant", "far"), (1 << 60, 4, "user", "trailing")]
    for c in rng.sample(range(300), 80):
        rows += [(1000 + c, i, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "yes", "", None, "é日", "a <|end|> b"])) for i in range(1 + rng.randrange(7))]
    got = check_branched(spark, rows)
    assert set(got) == {r[0] for r in rows} - {None}
    shared = {r[0] for r in got.values() if r[2] is not None}
    assert len(shared) > 2 and got[7][2] is None and got[1 << 60][2].endswith("trailing<|end|>\n")
    # a copy of the next conversation: the search goes on to the last common turn, far behind the branch
    same = [(c, i, "assistant" if i % 2 else "user", f"t{i}") for c in (0, 4) for i in range(6)]
    assert {r[0] for r in check_branched(spark, same).values()} == {5}
    check_branched(spark, same[:6])
    df = spark.createDataFrame(same, "conv_id long, turn long, role string, text string")
    assert chat.preferences(*chat.branched(df.limit(0)), one_sided=True).count() == 0
    assert chat.preferences(*chat.branched(df.where("turn = 0")), one_sided=True).count() == 2


def test_op4_chat_all_on_tables(spark):
    from kgspark.llm import queries

    n = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id").distinct().count()
    got = queries.op4_chat_all(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len({r["pair_id"] for r in got}) == n > queries.op4_chat(spark, "/root/testdata/sf0.01").count()


def documents(spark):
    rng = random.Random(6)
    rows, texts = [], []
    passage = words(rng, 60)
    for i in range(120):
        t = " ".join(w if k % 4 else "the" for k, w in enumerate(words(rng, 60 + rng.randrange(80)).split()))
        if i % 10 == 3 and texts:
            t = rng.choice(texts)
        elif i % 10 == 4 and texts:
            w = rng.choice(texts).split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 10 == 5:
            t = t + "\n" + passage
        elif i % 10 == 6:
            t = " ".join(x + "***" for x in t.split())
        texts.append(t)
        rows.append((i, t, "en", "src0", len(t)))
    rows += [(500, None, "en", None, None), (501, "", None, "s", 0), (502, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "s", 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_match_brute_force(spark):
    docs = documents(spark)
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "substring_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in quality.score(docs).where("kept").collect()}
    step = stage["quality_rules"](spark, docs, "")
    assert step.columns == names and {r["doc_id"] for r in step.collect()} == kept and not {500, 501} & kept
    step = stage["language_id"](spark, step, "").cache()
    assert step.columns == names
    assert {r["doc_id"] for r in step.collect()} == {r["doc_id"] for r in langid.identify(quality.filtered(docs)).where("not rejected").collect()}
    want = brute_components([(r["doc_id"], r["text"]) for r in step.collect()], 5, 80)
    step2 = stage["near_duplicates"](spark, step, "").cache()
    assert {r["doc_id"] for r in step2.collect()} == {d for d, (_, c) in want.items() if c == d}
    removed = {d: n for d, _, n, _ in brute_substrings([(r["doc_id"], r["text"]) for r in step2.collect()], 13)}
    step3 = stage["substring_dedup"](spark, step2, "").cache()
    assert step3.columns == names and any(removed.values())
    before = {r["doc_id"]: r["text"] for r in step2.collect()}
    for r in step3.collect():
        assert len(before[r["doc_id"]].split()) - len(r["text"].split()) == removed[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    pieces = stage["packing"](spark, step3, "").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(p["length"] for p in pieces) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in step3.collect())
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in step3.collect()}


def test_run_on_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_chat_with_clashing_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' as chosen", "1 as pair_id", "'p' as prompt", "'r' as `a.b`", "2 as first")
    plain = chat.preferences(*chat.branched(df.select("conv_id", "turn", "role", "text")), one_sided=True)
    own = chat.preferences(*chat.branched(df), one_sided=True)
    assert own.columns == plain.columns and sorted(map(repr, own.collect())) == sorted(map(repr, plain.collect()))
