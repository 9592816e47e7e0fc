"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded as the mean
of learned embeddings of its hashed words, next to a few counts of its form (capitals,
punctuation, repeats, …), and a hidden layer h. A gate gives its attention,
softmax over the document of w·(tanh(hV) ⊙ σ(hU)); the score is logistic in the sum of
the passages weighted by it. Labels belong to whole documents only.

The model is fitted on a bounded sample of labelled rows: at most ``sample`` labelled
documents of each class in hash order, with all their passages, encoded by Spark tasks.
Steps of the fit take bags of up to ``STEP_PASSAGES`` passages together, so a very long
document makes a step of its own. Class counts over all training labels correct the score for
the balanced sample. Scoring is one scan of whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, slices, span_hashes, text_bytes, words_of

PASSAGE = 100
STEP_PASSAGES = 4_096
SAMPLE = 2_500
BUCKETS = 2_048
_EMBED, _HIDDEN, _GATE = 8, 24, 12
THRESHOLD = 0.3


def _mask(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], bool)


_UPPER = _mask(lambda b: 65 <= b <= 90)
_LOWERCASE = _mask(lambda b: 97 <= b <= 122)
_DIGIT = _mask(lambda b: 48 <= b <= 57)
_MARK = _mask(lambda b: 33 <= b <= 126 and not chr(b).isalnum())
_WIDE = _mask(lambda b: b >= 0xC0)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each passage, form of each passage, first passage of each row).

    A row without words has one passage without words.
    """
    starts, ends, rows = words_of(data, offsets)
    counts = np.diff(rows)
    per_row = np.maximum(1, -(-counts // PASSAGE))
    first_passage = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(counts)), per_row)
    first = rows[:-1][row] + (np.arange(first_passage[-1]) - first_passage[:-1][row]) * PASSAGE
    last = np.minimum(first + PASSAGE, rows[1:][row])
    n = last - first

    h = span_hashes(LOWER[data], starts, ends)
    length = (ends - starts).astype(np.float64)

    def per_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask[data], dtype=np.int32)))
        return (sums[ends] - sums[starts]).astype(np.float64)

    upper, lower, digit, mark, wide = map(per_word, (_UPPER, _LOWERCASE, _DIGIT, _MARK, _WIDE))
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    breaks = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))
    lines = np.zeros(len(h))
    lines[1:] = np.minimum(breaks[starts[1:]] - breaks[starts[:-1]], 4)
    # A row's first word has none before it, whatever row stands there.
    opening = rows[:-1][counts > 0]
    same[opening] = lines[opening] = 0

    passage = np.repeat(np.arange(len(n)), n)
    key = np.sort((passage.astype(np.uint64) << np.uint64(20)) | (h & np.uint64(0xFFFFF)))
    fresh = np.ones(len(key))
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key >> np.uint64(20)).astype(np.int64), fresh, len(n))

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, len(n)) / np.maximum(n, 1)

    size = np.maximum(mean(length), 1e-9)
    form = np.stack(
        [mean(length) / 10, mean(upper) / size, mean(digit) / size, mean(mark) / size, mean(wide) / size,
         mean((upper > 1) & (lower == 0)), mean(mark > 1), mean((length == 1) & (mark == 1)), mean(same), mean(lines),
         distinct / np.maximum(n, 1), np.log1p(n) / 5],
        axis=1,
    )
    return (h % np.uint64(BUCKETS)).astype(np.uint16), first, form.astype(np.float32), first_passage


FORMS = 12


class Model:
    """Parameters, the forward pass and one gradient step."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = _EMBED + FORMS
        self.p = {
            "E": rng.normal(0, 0.1, (BUCKETS, _EMBED)), "W": rng.normal(0, wide**-0.5, (wide, _HIDDEN)), "b": np.zeros(_HIDDEN),
            "V": rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, _GATE)), "U": rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, _GATE)),
            "w": rng.normal(0, _GATE**-0.5, _GATE), "c": rng.normal(0, _HIDDEN**-0.5, _HIDDEN), "c0": np.zeros(1),
        }
        self.center, self.scale, self.shift = np.zeros(FORMS), np.ones(FORMS), 0.0

    def forward(self, words, passage, form, bag):
        """Logit of each bag; passage: of each word, bag: of each passage, both sorted."""
        p, n = self.p, len(form)
        count = np.maximum(np.bincount(passage, minlength=n), 1)
        rows = p["E"][words]
        mean = np.stack([np.bincount(passage, rows[:, j], n) for j in range(_EMBED)], 1) / count[:, None]
        x = np.concatenate([mean, (form - self.center) / self.scale], 1)
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (tv * su) @ p["w"]
        first = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1]))) if n else np.zeros(0, int)
        at = np.cumsum(np.concatenate(([0], bag[1:] != bag[:-1]))) if n else np.zeros(0, int)
        e = np.exp(a - np.maximum.reduceat(a, first)[at])
        alpha = e / np.add.reduceat(e, first)[at]
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        return z @ p["c"] + p["c0"][0], (count, x, h, tv, su, alpha, at, first, z)

    def gradients(self, words, passage, form, bag, y):
        logit, (count, x, h, tv, su, alpha, at, first, z) = self.forward(words, passage, form, bag)
        p = self.p
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        g = {"c": z.T @ d, "c0": np.array([d.sum()])}
        dz = d[:, None] * p["c"]
        dh = alpha[:, None] * dz[at]
        da = (h * dz[at]).sum(1)
        da = alpha * (da - np.add.reduceat(alpha * da, first)[at])
        g["w"] = (tv * su).T @ da
        dg = da[:, None] * p["w"]
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh += dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h**2)
        g["W"], g["b"] = x.T @ dx, dx.sum(0)
        de = (dx @ p["W"][:_EMBED].T) / count[:, None]
        g["E"] = np.stack([np.bincount(words, de[passage, j], BUCKETS) for j in range(_EMBED)], 1)
        return g

    def score(self, words, passage, form, bag) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(words, passage, form, bag)[0] + self.shift, -40, 40)))


def _steps(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Runs of at most ``batch`` documents and ``STEP_PASSAGES`` passages, or of one document."""
    lo = 0
    while lo < len(order):
        upto = np.cumsum(sizes[order[lo : lo + batch]])
        hi = lo + max(1, int(np.searchsorted(upto, STEP_PASSAGES, "right")))
        yield order[lo:hi]
        lo = hi


def fit(docs: list[tuple], labels: np.ndarray, *, epochs: int = 14, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """A model from encoded documents (words, words per passage, forms)."""
    model = Model(seed)
    sizes = np.array([len(d[1]) for d in docs])
    forms = np.concatenate([d[2] for d in docs]).astype(np.float64)
    model.center, model.scale = forms.mean(0), forms.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for some in _steps(order, sizes, batch):
            chosen = [docs[i] for i in some]
            per = np.concatenate([d[1] for d in chosen])
            g = model.gradients(
                np.concatenate([d[0] for d in chosen]).astype(np.int64), np.repeat(np.arange(len(per)), per),
                np.concatenate([d[2] for d in chosen]).astype(np.float64), np.repeat(np.arange(len(chosen)), [len(d[1]) for d in chosen]),
                labels[some],
            )
            step += 1
            for k in model.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k in ("E", "W"):
                    model.p[k] *= 1 - 0.1 * rate
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled documents as features of all their passages."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        words, per, forms = [], [], []
        for lo, hi in slices(offsets):
            bucket, first, form, rows = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.append(first[1:], len(bucket))
            for i in range(hi - lo):
                a, b = rows[i], rows[i + 1]
                words.append(bucket[first[a] : ends[b - 1]].tobytes())
                per.append((ends[a:b] - first[a:b]).astype(np.int32).tobytes())
                forms.append(form[a:b].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(x, pa.binary()) for x in (words, per, forms)], ["label", "words", "per", "forms"]
        )


def _scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            scores = np.full(batch.num_rows, 0.5)
            for lo, hi in slices(offsets, 1 << 19) if model else ():
                bucket, first, form, rows = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bucket))))
                bag = np.repeat(np.arange(hi - lo), np.diff(rows))
                scores[lo:hi] = model.score(bucket, passage, form, bag)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return run


def held_out(id_col: Column) -> Column:
    """True for the fifth of ids that training must not see; null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          *, sample: int = SAMPLE) -> Model | None:
    """A model from ``labels``; None without labelled training documents of both classes.

    Labels above 0 are good. A document with several labels has the greatest; null labels
    and null ids do not count, nor do labels of held-out ids.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    per_class = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0.0, 1.0)]
    chosen = F.broadcast(per_class[0].unionAll(per_class[1]))  # at most 2 * sample rows
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.join(chosen, "id").select("label", "text", "id").select("label", "text")
    rows = rows.mapInArrow(_encoded, "label double, words binary, per binary, forms binary").collect()
    rows.sort(key=lambda r: (r["label"], r["words"], r["forms"]))
    y = np.array([r["label"] for r in rows])
    if len(set(y)) < 2:
        return None
    encoded = [
        (np.frombuffer(r["words"], np.uint16), np.frombuffer(r["per"], np.int32),
         np.frombuffer(r["forms"], np.float32).reshape(-1, FORMS))
        for r in rows
    ]
    model = fit(encoded, y)
    model.shift = float(np.log(counts[1.0] / counts[0.0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def scored(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its text alone.

    Null texts are empty texts; empty ones are scored as one passage without words.
    Without a model every score is 0.5. No rows give no rows.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = docs.mapInArrow(_scorer(model), f"id {docs.schema['id'].dataType.simpleString()}, score double")
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose text the model does not reject, columns as they are."""
    packed = documents.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    rows = packed.mapInArrow(_scorer(model), f"id {kind}, score double")
    return rows.where(F.col("score") >= THRESHOLD).select("id.*")
