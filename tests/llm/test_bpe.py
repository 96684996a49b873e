from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary())), t


def same(tools, texts):
    enc, ref = tools
    ids, counts = enc.batch(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    want = ref.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, w in enumerate(want):
        assert w.ids == ids[at[i] : at[i + 1]].tolist(), texts[i]


def test_perfect_hash_is_minimal(tools):
    v = tools[0].v
    assert sorted(v.slot.tolist()) == list(range(len(v.ids)))


def test_mixed_texts(tools):
    rng = random.Random(1)
    pool = list("  \n\t\r''' 　\xa0stmdrevelLl!?.,09٣Ⅷ中文字éö́​\U0001f600\u0085\x1c") + ["'s", "'re", "'ll", ' "', " 's", "''", "<|endoftext|>"]
    same(tools, ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "\n"])


def test_every_character_class(tools):
    same(tools, [f"{chr(c)}a{chr(c)} {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000])


def test_long_text_and_long_run(tools):
    same(tools, ["字" * 50_000, "ab" * 40_000, "x y " * 400_000])


def test_query_shape(spark):
    df = spark.createDataFrame([(1, "the cat", 5), (2, None, 5), (3, "", 5), (4, "the cat", 5)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got[1] == got[4] and len(got[1]) == 2 and got[2] == [] and got[3] == []
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
