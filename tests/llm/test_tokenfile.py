import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from tableweave.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 5, 17, 1000, 20_000):
        h = tokenfile.key_hashes(pd.Series(np.arange(n) * 7 - 3, dtype="Int64"))
        shifts, slot = tokenfile.build(h)
        assert sorted(slot) == list(range(n)) and len(shifts) == -(-n // 4)
        slots = np.zeros(n, tokenfile.SLOT)
        slots["print"][slot] = tokenfile._parts(h, len(shifts))[1]
        assert (tokenfile.find(h, shifts, slots) == slot).all()
        other = tokenfile.key_hashes(pd.Series(np.arange(10 * n, 12 * n) * 7, dtype="Int64"))
        assert (tokenfile.find(other, shifts, slots) >= 0).mean() < 0.01


def expected(rows):
    """(id, start, n, crc) of records in id order, null first, repeated ids in either order."""
    library = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_round_trip(spark):
    rows = [(i * 3, f"Document {i} has some words.\n" * (i % 17)) for i in range(500)]
    rows += [(None, "no id"), (7, None), (2**62 + 1, "big id <|endoftext|> !"), (-5, "minus"), (8, "long " * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, record int")
    files = tokenfile.write(df, PATH, bucket_keys=60, shards=5)
    assert files.width == 2 and len(files.buckets) == 9 and len(files.shards) <= 5
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read(df, files).collect()), key=lambda r: r[1])
    want = sorted(expected(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert len(got) == len(want)
    for (i, start, n, crc), w in zip(got, want):
        assert (i, n, crc) == w and start == at
        at += n
    library = Tokenizer.from_file(PATH)
    assert [a.tolist() for a in tokenfile.get(files, 2**62 + 1)] == [library.encode("big id <|endoftext|> !").ids + [0]]
    assert tokenfile.get(files, 4) == [] and len(tokenfile.get(files, None)) == 1


def test_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b c"), (1, "b c"), (0, "")], "doc_id long, text string")
    got = tokenfile.token_records(df, PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected([(1, "a"), (1, "b c"), (1, "b c"), (0, "")]))
    assert sorted(r.start for r in got)[0:2] == [0, 1]
    assert tokenfile.token_records(df.limit(0), PATH).count() == 0
