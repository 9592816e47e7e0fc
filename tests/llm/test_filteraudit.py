import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from tableweave.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        words = WORD.findall(t)
        failed = {
            name for name, bad in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                bool(set(t) & set("#$%&*|")), i is not None and first[t] < i)) if bad
        }
        parts[lang or ""].append((failed, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                c = Counter()
                for failed, g, t in rows:
                    gone = bool(failed & earlier)
                    c["kept"] += not gone and f not in failed
                    c["redundant"] += gone and f in failed
                    here = f in failed and not gone
                    c["removed"] += here
                    c["good"] += here and g
                    c["toxic"] += here and t
                    c["unique"] += failed == {f}
                removed_by[f] += c["removed"]
                out[part, order, step] = [c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def data(seed=4):
    rng = random.Random(seed)
    docs = []
    for i in range(150):
        n = rng.choice([0, 3, 199, 200, 260])
        t = rng.choice([" ", "\n", "\t "]).join(rng.choice(["Word", "und", "é", "x1", f"u{rng.randrange(400)}", f"v{rng.randrange(400)}"]) for _ in range(n))
        docs.append((i, t + rng.choice(["", "", " $", " 😀"]), rng.choice(["en", "de", None, ""])))
    docs += [(200 + k, docs[k % 30][1], "fr") for k in range(40)] + [(None, docs[3][1], "en"), (500, None, "en"), (500, None, "en"), (501, "", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 240, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(*d, True, "k") for d in docs], "doc_id long, text string, lang string, good boolean, part string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def found(spark, docs, labels):
    rows = filteraudit.audit(*frames(spark, docs, labels)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_equal_to_plain_counting(spark):
    docs, labels = data()
    assert found(spark, docs, labels) == brute(docs, labels)


def test_many_parts_and_partitions(spark):
    docs, labels = data(5)
    docs = [(i, t, f"part {k % 90}") for k, (i, t, _) in enumerate(docs)]
    d, m = frames(spark, docs, labels)
    rows = filteraudit.audit(d.repartition(7), m).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == brute(docs, labels)


def test_fields_do_not_overflow():
    width = (1000).bit_length()
    kinds = [(mask, g, t) for mask in range(32) for g in (False, True) for t in (False, True)]
    total = sum(filteraudit.packed_outcomes(*kind, width) for kind in kinds) + 872 * filteraudit.packed_outcomes(31, True, True, width)
    fields = filteraudit.unpacked(total, width)
    single = [filteraudit.unpacked(filteraudit.packed_outcomes(*kind, 1), 1) for kind in kinds]
    heavy = filteraudit.unpacked(filteraudit.packed_outcomes(31, True, True, 1), 1)
    assert fields == [sum(column) + 872 * h for column, h in zip(zip(*single), heavy)] and max(fields) == 1000 - 64
    assert len(filteraudit.STEPS) == 600


def test_one_text_in_a_third_of_the_rows(spark):
    docs = [(i, "the same", "en") for i in range(2_000)] + [(None, "the same", "en")] * 500 + [(5_000 + i, f"own {i}", "en") for i in range(50)]
    got = found(spark, docs, [(i, 1, 1) for i in range(0, 6_000, 2)])
    assert got == brute(docs, [(i, 1, 1) for i in range(0, 6_000, 2)])
    assert got["en", "EABCD", 1][1] == 1_999


def test_no_rows(spark):
    docs, labels = frames(spark, *data())
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    assert filteraudit.audit(docs, labels.limit(0)).count() == 600 * 4
