import hashlib
import re
from pathlib import Path

import pytest

from tableweave.llm import sanitise

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [
        (m.start(), KINDS.index(k), m.end(), k)
        for k in KINDS for m in PLAIN[k].finditer(text or "") if holds(k, m.group())
    ]
    return sorted(found)


def expected(text):
    found = base_spans(text)
    shown = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (*[sum(f[3] == k for f in found) for k in KINDS], hashlib.sha256(shown.encode()).hexdigest())


TEXTS = [
    None, "", " ", "mail a@b.co and _d@e.f, x@y, a.b@c-d.e-f.g.", "a@b.c_d@e.f.g", "q@r.s@t.u", "@@a@b.c..d",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004 1.2.3", "v10.20.30.40x 256.1.1.1.1",
    "4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111-", "79927398713 799273987130 0000 0000 0000",
    "12  4111111111111111 5-4111111111111111", "+1 (202) 555-0173. +49 30 901820 +123 +1((((( +4123456789 x",
    "é😀 +41 44 668 18 00 ñ a@b.cd 😀 10.0.0.1", "4" * 40, "1." * 300, "a@" + "b." * 5000 + "c", "x" * 200_000 + "@y.z",
]


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.personal_data(df).collect()}
    for i, text in enumerate(TEXTS):
        row = got[i]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == expected(text), text
        assert row.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(text))


def test_whole_table(spark):
    data = Path("/root/testdata/sf0.001/documents.parquet")
    if not data.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(data))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sanitise.personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == expected(texts[r.doc_id])


def telling_documents():
    name = "zorblatt"
    rows = [(i, f"Number {i} has {name} from the {w} office, write to jane@x.org about the {w} matter today.")
            for i, w in enumerate(["green", "yellow", "purple", "orange"])]
    rows += [(100 + i, f"The office about matter today number {w} from here.") for i, w in enumerate("abcdefghijklmnopqrstuvwx")]
    return rows


def test_terms_that_reveal_an_entity(spark):
    rows = telling_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.personal_data(df).collect()}
    for i, text in rows[:4]:
        at = text.index("zorblatt")
        assert f"term:{at}:{at + 8}" in got[i].spans
        assert "office" not in [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in got[i].spans.split(",")]
        assert got[i].n_email == 1 and got[i].base_sha256 == expected(text)[-1]
    assert all(got[i].spans == "" for i, _ in rows[4:])
    clean = {r.doc_id: r.text for r in sanitise.sanitised(df).collect()}
    assert clean[0] == "Number 0 has  from the green office,  to [EMAIL] about the green matter today."
    assert all(clean[i] == t for i, t in rows[4:])


def test_copies_are_one_piece_of_evidence(spark):
    text = "Ask zorblatt in the hall or mail jane@x.org."
    df = spark.createDataFrame([(i, text) for i in range(20)] + [(50, "the hall"), (51, "else")], "doc_id long, text string")
    assert {r.spans for r in sanitise.personal_data(df).where("doc_id < 20").collect()} == {"email:33:43"}


def test_telling_terms_anywhere_in_a_text(spark):
    far = ["green", "yellow", "purple", "orange"]
    rows = [
        (i, f"Zorblatt {'filler ' * 60}{w} mail zanelle@x.org now {'filler ' * 3000}ask Zanelle or zorblatt 😀 ZORBLATT.")
        for i, w in enumerate(far)
    ]
    rows += [(None, rows[0][1]), (None, rows[0][1])]
    rows += [(100 + i, f"filler mail about {w}") for i, w in enumerate("abcdefghijklmnopqrstuvwx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.spans) for r in sanitise.personal_data(df).collect()]
    assert len(got) == len(rows)
    for i, text in rows[:6]:
        email = text.index("zanelle@x.org")
        want = [f"email:{email}:{email + 13}"]
        want += [f"term:{m.start()}:{m.end()}" for m in re.finditer("zorblatt|zanelle(?!@)", text, re.I)]
        want = ",".join(sorted(want, key=lambda s: int(s.split(":")[1])))
        assert len(want.split(",")) == 5 and (i, want) in got
    assert all(not spans for i, spans in got if i is not None and i >= 100)
    for r in sanitise.sanitised(df).where("doc_id < 100 or doc_id is null").collect():
        assert not re.search("zorblatt|zanelle", r.text, re.I)


def test_terms_far_from_the_match_count(spark):
    # Near the match in one text only, but in every text of the entity.
    rows = [(i, f"{'zorblatt ' if i == 0 else ''}case {i} jane@x.org {'filler ' * 50}zorblatt") for i in range(5)]
    rows += [(10 + i, f"filler case {i}") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.count("term:") for r in sanitise.personal_data(df).collect()}
    assert got == {i: 2 if i == 0 else int(i < 5) for i, _ in rows}


def test_sanitised_keeps_columns_rows_and_overlaps(spark):
    rows = [
        (1, "ring +4111111111111111 or 10.0.0.1😀", "k", 1), (1, "ring +4111111111111111 or 10.0.0.1😀", "k", 1),
        (None, "a@b.co", "n", 2), (3, None, None, None), (4, "", "", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, start int")
    got = sanitise.sanitised(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(
        map(str, spark.createDataFrame(
            [(1, "ring +[CARD] or [IP]😀", "k", 1)] * 2 + [(None, "[EMAIL]", "n", 2), (3, None, None, None), (4, "", "", 4)],
            df.schema).collect())
    )
    assert sanitise.sanitised(df.limit(0)).count() == 0
    assert sanitise.personal_data(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(telling_documents(), "doc_id long, text string")
    for out in (sanitise.personal_data(df), sanitise.sanitised(df), sanitise.spans(df)):
        assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
