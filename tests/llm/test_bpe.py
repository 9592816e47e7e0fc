import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "  a", "a ", "\n\n", "\ta\tb", "it's 's\n's", "a b c", "Zäzu – «x» “y”", "漢字 仮名。\n漢字", " a  b",
       "a <|endoftext|> b<|endoftext|>c", "\U0001f600 \U0001f600\n\U0001f600", "12 345\n6", "x\r\ny", "a \nb", "a\n b", "é́ é"]


class Counting:
    """The library, with the number of texts it is given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def packed(raws):
    offsets = np.cumsum([0, *map(len, raws)])
    return np.frombuffer(b"".join(raws), np.uint8), offsets


def same_as_library(encoder, texts):
    ids, counts = encoder.encoded(*packed([t.encode() for t in texts]))
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_new_segments_travel_in_few_texts():
    encoder = bpe.Encoder(PATH)
    encoder.library = Counting(encoder.library)
    same_as_library(encoder, [" ".join(f"word{i:x}" for i in range(k, k + 500)) + "\nnext" for k in range(0, 10_000, 500)])
    assert encoder.library.texts <= 10


@pytest.mark.parametrize("most", [10, 10**6])
def test_odd_texts_and_a_full_store(monkeypatch, most):
    monkeypatch.setattr(bpe, "_MOST_SEGMENTS", most)
    encoder, draw = bpe.Encoder(PATH), random.Random(3)
    alphabet = "ab Z'\n\t .,9é漢– 　\U0001f600"
    for _ in range(40):
        texts = ODD + ["".join(draw.choices(alphabet, k=draw.randrange(30))) for _ in range(40)]
        same_as_library(encoder, draw.sample(texts, len(texts)))
        assert len(encoder.keys) == len(encoder.count) == len(encoder.met) == len(np.unique(encoder.where))


def test_often_met_segments_stay(monkeypatch):
    monkeypatch.setattr(bpe, "_MOST_SEGMENTS", 100)
    encoder = bpe.Encoder(PATH)
    for k in range(5):
        once = " ".join(f"one{k}x{i}" for i in range(90))
        same_as_library(encoder, [f"often met here {once}" if k < 4 else once])
    kept = encoder.library = Counting(encoder.library)
    encoder.encoded(*packed([b"often met here"]))
    assert kept.texts == 0


def test_bytes_that_are_no_utf8():
    raws = [b"good \xff\xfe bad good", b"cut \xe6\xbc end", b"\x80 a b"]
    encoder = bpe.Encoder(PATH)
    ids, counts = encoder.encoded(*packed(raws))
    library = Tokenizer.from_file(PATH)
    want = [library.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids for r in raws]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
