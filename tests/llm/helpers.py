"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SYLLABLES = ["the", "of", "and", "lo", "ra", "mi", "ken", "sto", "bri", "ul"]


def words(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(1 + rng.randrange(vocabulary) % 3)) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(None, "a text without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "İ ß <|endoftext|> \x1c\xa0 日本 😀  x"), (7, "word " * 5000), (8, "a" * 9000)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(" ".join(w))
        else:
            texts.append(words(rng, rng.randrange(20, 120)))
        rows.append((100 + i, texts[-1] + rng.choice(["", ".\n", ", " + words(rng, 5)])))
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' as kept", "1 as n_words", "cast(null as string) as lang", "doc_id as ids", "'s' as `a.b`") if extra else df
