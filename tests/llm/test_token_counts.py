import random

import pytest
from tokenizers import Tokenizer

from tests.llm.data import DOCS, frame, messy
from tracewell.llm import packing, token_counts as t
from tracewell.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(tokenizer_path())
    out.encode_special_tokens = True
    return lambda text: out.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encoder, rng = packing.PieceEncoder(tokenizer_path()), random.Random(3)
    texts = [r[1] or "" for r in messy()] + ["a  b", " a", "a ", "\n\n a\tb \n", "it's  we'll x", "<|endoftext|> a", "x\x1cy z", "１２３ ４５", "a  b", "é ​ z"]
    texts += ["".join(rng.choice(" \n\tabé1'.,　") for _ in range(60)) for _ in range(200)]
    for text in texts:
        assert encoder.ids(text).tolist() == tokenizer(text)


def test_edits_follow_a_full_count(tokenizer):
    counter, rng = t.Counter(tokenizer_path()), random.Random(1)
    pool = ["", " ", "  ", " a", "\n\n", "x", " it's  \n y ", "\t", "é ", "  end", "."]
    for text in [r[1] or "" for r in messy()[:40]]:
        tree = t.build(text, counter)
        for k in range(12):
            by = rng.choice(pool) * rng.choice((1, 2, 400 if k == 6 else 3))
            tree, text, _ = t.edit(tree, text, rng.randrange(len(text) + 3), rng.choice((0, 1, 3, 50, 10_000)), by, counter)
            assert (int(tree.tokens[1]), int(tree.chars[1])) == (len(tokenizer(text)), len(text))


def test_added_tokens_count_once():
    tok, counter, rng, end = Tokenizer.from_file(tokenizer_path()), t.Counter(tokenizer_path()), random.Random(5), "<|endoftext|>"
    text = " ".join(rng.choice(("word", end, f"a{end}b", "<|endof text|>", "  ", "x\n")) for _ in range(600))
    tree = t.build(text, counter)
    for _ in range(60):  # edits make such tokens and break them
        at = rng.choice([i for i, c in enumerate(text) if c in " <|"])
        tree, text, _ = t.edit(tree, text, at, rng.choice((0, 1, 1, 2)), rng.choice(("", "", end, "<|", " ")), counter)
        assert int(tree.tokens[1]) == len(tok.encode(text, add_special_tokens=False).ids)


def test_only_what_is_touched_is_encoded():
    counter = t.Counter(tokenizer_path())
    text = "some words here " * 20_000
    tree = t.build(text, counter)
    _, _, n = t.edit(tree, text, 160_000, 5, "other", counter)
    assert n < 2_000


def test_tables(spark, tokenizer):
    docs = frame(spark)
    edits = spark.createDataFrame([(0, 2, 0, 4, "Q"), (0, 1, 3, 0, " and "), (1, 1, None, None, None), (10_000, 1, 0, 1, "x"), (None, 1, 0, 0, "y")], "doc_id long, seq int, start int, length int, text string")
    out = t.edited(t.trees(docs, tokenizer=tokenizer_path()), edits, tokenizer=tokenizer_path()).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["n_after"] == len(tokenizer(r["text"])) == sum(r["tokens"])
    text = messy()[0][1]
    text = text[:3] + " and " + text[3:]
    assert next(r["text"] for r in out if r["doc_id"] == 0) == "Q" + text[4:]
    assert t.trees(spark.createDataFrame([], DOCS), tokenizer=tokenizer_path()).count() == 0
