"""The registered queries over whole tables: against their SQL, or against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tableweave.llm import queries

from ..oracle import compare, connect
from .test_mixing import brute_targets
from .test_packing import check
from .test_sanitise import expected as expected_spans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) < set(names) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert compare(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name]) is None


def test_op1(spark, duck):
    rows = [(i, v) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    got = defaultdict(list)
    for r in queries.QUERIES["op1_ann_rotated_bits"](spark, DATA).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -9
        best = set(ids[np.lexsort((ids, -scores))[:20]])
        hit += len(best & {i for _, i, _ in found})
        for rank, i, s in found:
            assert abs(s - scores[ids == i][0]) < 1e-12
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
    assert hit / (20 * len(got)) > 0.97


def test_op2(spark, texts):
    rows = queries.QUERIES["op2_best_fit_packing"](spark, DATA).collect()
    check(rows, {i: len((t or "").split()) for i, t in texts.items()}, (512, 1024, 2048, 4096, 8192))


def test_op4(spark, duck):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = duck.execute("SELECT doc_id, text, source FROM documents").fetchall()
    sizes, of = defaultdict(int), {}
    for i, t, s in docs:
        of[i] = s, len(word.findall(t or ""))
        sizes[s] += of[i][1]
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in queries.QUERIES["op4_source_mix"](spark, DATA).collect():
        source, size = of[r.doc_id]
        assert (r["size"], r.source_size) == (size, sizes[source]) and r.target == pytest.approx(float(want[source]))
        assert 0 <= r.taken <= 2 * size
        taken[source] += r.taken
    assert all(abs(taken[s] - float(want[s])) <= 0.5 + 1e-6 for s in sizes)


def test_op5(spark, texts):
    rows = queries.QUERIES["op5_pii_sanitisation"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == expected_spans(texts[r.doc_id])
        base = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_op8(spark, duck, texts):
    rows = queries.QUERIES["op8_quality_classifier"](spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in out) / len(out) > 0.8


def test_op9_and_op10(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    rows = queries.QUERIES["op9_token_counts"](spark, DATA).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [
        (i, len((texts[i] or "").encode()), len(ids[i]), len(ids[i]) > 512) for i in sorted(ids)
    ]
    at, want = 0, []
    for i in sorted(ids):
        full = ids[i] + [0]
        want.append((i, at, len(full), zlib.crc32(np.array(full, "<u4").tobytes())))
        at += len(full)
    rows = queries.QUERIES["op10_token_id_output"](spark, DATA).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want
