import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableweave.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    " ", "  ", "\n", "\r\n", "\t", "a", "Hello", "don't", "I'll", "'s", " x", "é", "ß", "日本", "😀", " ", " ", "　", "\u0085",
    "​", "—", "12", "3.14", "²", "Ⅷ", "!!", "<|endoftext|>", "<|endof", "text|>", "_", "\x0b", "\x1c", "é", "﻿", ".",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def tricky(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_segments_encode_as_whole_texts(library):
    texts = tricky(3000) + ["", " ", "a b", " a", "a ", "x" * 3000, "plain words of prose here.\nAnd a line. " * 30]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    encoder = bpe.Encoder(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.counts(data, offsets).tolist() == [len(w) for w in want]
    ids, counts = encoder.encoded(data, offsets)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_spliced_counts_equal_whole_ones(spark, library):
    rng = random.Random(3)
    texts = [None, "", "short text"] + ["".join(tricky(60, s)) for s in range(12)]
    texts += [" ".join(rng.choice(["word", "don't", "été", "12,5"]) for _ in range(900)), "y" * 2000, "ab" * 300 + " tail of words " * 40]
    texts += [texts[-3]]
    rows = [(i if i != 4 else None, t, -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows
    )
    got = tokencount.token_counts(df, PATH, chunk_bytes=300, overlap=16, limit=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0


def test_whole_table(spark, library):
    data = Path("/root/testdata/sf0.001/documents.parquet")
    if not data.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(data))
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
