"""Small documents with the cases that operators must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, n string, size long, bucket string, print string, score string, draws string, _key string"


def vocabulary(rng: random.Random, n: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdeéstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def messy(seed: int = 1, n: int = 60) -> list[tuple]:
    """Nulls in any column, empty, blank, short and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts += [texts[0], texts[0].replace(" ", "\n\t"), texts[1] + " ", "", None, "  \t ", "word", "two words", "Word", "é" * 60, "ab" * 200]
    for i in range(12):  # near copies of one text, of one another
        ws = " ".join(texts[2:8]).split()
        ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws[i % 3 :]))
    texts.append(" ".join(rng.choice(vocab) for _ in range(30_000)))
    texts.append(" ".join(["x"] * 3_000))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None), (None, None, None, None, None), (7, "another text under an id that is taken", "en", "a", 1), rows[5], rows[5], rows[5]]
    return [(*r, "key", "shard", "n", -1, "bucket", "print", "score", "draws", "_key") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(messy() if rows is None else rows, DOCS)
