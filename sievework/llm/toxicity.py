"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (of ``<word>``) and itself, hashed into ``BUCKETS`` rows of an
embedding; an unseen misspelling shares most of its n-grams' vectors. The bags of ``WINDOW`` consecutive words are
averaged and fed to a two-class softmax. A text is scored by its most toxic window; windows begin every ``STEP`` words
and cover the whole text, so a few words in a very long text count as much as in a short one (README has figures for both readings).

Labels are of whole texts, so training alternates: the executors look through all windows of the labelled texts under the current model and return the
highest one of each text (for clean texts the ``HARD_WINDOWS`` highest and ``CLEAN_WINDOWS`` random ones); passes over these windows update the embeddings and
the softmax together, and the model is the mean of the last ``LAST`` rounds. First the windows are ranked by the log odds of their n-grams in the other texts. A toxic text without any window that other texts'
labels speak for teaches nothing and is left out. It uses about ``rows_per_class`` rows of each class (at most twice that, by a hash threshold from
exact counts), each as a whole; the driver holds some windows of each, whatever its length. At last the texts' highest windows are calibrated to the shares of the
classes among all labels.

Defined results: a null or empty text has one empty window, scored by the bias. Without training rows of
both classes every score is 0. Repeated rows get equal values; repeated labels of a row count once, as
toxic if any of them is; of rows that share an id, the smallest text is learned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, quoted, release_memory, releasing, small_batches, stored
from .wordtable import WordTable, blocks, hashed_grams

BUCKETS = 1 << 16
SIZE = 8
GRAMS = (3, 4, 5)
WINDOW, STEP = 2, 1
STEPS = 150
PRIOR = 2.0
CLEAN_WINDOWS, HARD_WINDOWS = 4, 4
ROUNDS, LAST = 8, 4
TASKS = 16
PICK = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
EDGES = ".,;:!?\"'()[]{}<>«»“”„…-–—*"


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(n - WINDOW, 0) + STEP, STEP)


def is_repeat(ids: np.ndarray) -> np.ndarray:
    """Whether the same word stands within the last WINDOW words; a repeat adds to a bag's size but not to its sum."""
    order = np.argsort(ids, kind="stable")
    out = np.zeros(len(ids), bool)
    out[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (order[1:] - order[:-1] < WINDOW)
    return out


class Model:
    """After training only one number per bucket is needed: the difference of the two classes' logits."""

    def __init__(self, logits: np.ndarray | None = None, bias: float = 0.0):
        self.logits, self.bias, self.token = logits, bias, uuid.uuid4().hex

    def table(self) -> WordTable:
        z = self.logits

        def rows(words: list[str]) -> np.ndarray:
            ids, owner = hashed_grams(words, GRAMS, BUCKETS)
            return np.stack([np.bincount(owner, z[ids], len(words)), np.bincount(owner, minlength=len(words))], 1)

        return WordTable(rows, 2)

    def score(self, texts: list[str | None], table: WordTable) -> list[float]:
        """A score for each text; words are looked up for a block of texts at once."""
        if self.logits is None:
            return [0.0] * len(texts)
        out = []
        for some in blocks(texts):
            words = list(map(words_of, some))
            rows, ids = table.take([w for x in words for w in x])
            end = 0
            for n in map(len, words):
                sums = np.zeros((n + 1, 2))
                if n:
                    own, end = rows[end : end + n], end + n
                    own[is_repeat(ids[end - n : end]), 0] = 0
                    np.cumsum(own, axis=0, dtype=np.float64, out=sums[1:])
                a = window_starts(n)
                d = sums[np.minimum(a + WINDOW, n)] - sums[a]
                top = float((d[:, 0] / np.maximum(d[:, 1], 1)).max()) + self.bias
                out.append(float(1 / (1 + np.exp(-np.clip(top, -40, 40)))))
        return out


class Windows:
    """The windows of one text: for each, its words' n-gram buckets (a word that was there less than ``WINDOW`` before adds to the size only)."""

    def __init__(self, text: str | None):
        words = words_of(text)
        vocab: dict[str, int] = {}
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int64)
        self.ids, self.of = hashed_grams(list(vocab), GRAMS, BUCKETS)
        order = np.argsort(self.of, kind="stable")
        self.ids, self.of = self.ids[order], self.of[order]
        lens = np.append(np.bincount(self.of, minlength=len(vocab)), 0)  # the last is for places beyond the end
        self.at = np.concatenate([[0], np.cumsum(lens)])
        starts = window_starts(len(ids))
        pad = np.full(WINDOW + STEP, len(vocab), np.int64)
        places = starts[:, None] + np.arange(WINDOW)
        self.once = np.concatenate([np.where(is_repeat(ids), len(vocab), ids), pad])[places]
        self.size = lens[np.concatenate([ids, pad])[places]].sum(1)

    def logits(self, z: np.ndarray) -> np.ndarray:
        word = np.append(np.bincount(self.of, z[self.ids], len(self.at) - 2), 0.0)
        return word[self.once].sum(1) / np.maximum(self.size, 1)

    def buckets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of window k, and how often it has them."""
        return np.unique(np.concatenate([self.ids[self.at[w] : self.at[w + 1]] for w in self.once[k]] or [np.empty(0, np.int64)]), return_counts=True)


class Pick(NamedTuple):
    """A window that training sees. ``kind``: 0 the text's highest, 1 another one."""

    text: int
    toxic: int
    kind: int
    logit: float
    size: int
    buckets: np.ndarray
    times: np.ndarray


def look(text_no: int, text: str | None, toxic: int, z: np.ndarray, seed: int) -> list[Pick]:
    """The picks of one text under the bucket logits ``z`` (a row for each class of text)."""
    w = Windows(text)
    logit = w.logits(z[toxic])
    order = np.argsort(-logit, kind="stable")
    chosen = [int(order[0])]
    if not toxic:
        rng = np.random.default_rng([seed, text_no])
        chosen += sorted({int(k) for k in [*order[1:HARD_WINDOWS], *rng.integers(0, len(order), CLEAN_WINDOWS)]} - {chosen[0]})
    return [Pick(text_no, toxic, int(j > 0), float(logit[k]), int(w.size[k]), *w.buckets(k)) for j, k in enumerate(chosen)]


def bucket_odds(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of each bucket in toxic and clean texts, without the text that is looked at: row 0 for clean texts, row 1 for toxic ones.
    They shrink to the odds of all texts, so a bucket that only that text has says nothing. ``count`` and ``n`` are texts by class."""

    def odds(own: int) -> np.ndarray:
        c, m = count.astype(float), n.astype(float)
        c[own] = np.maximum(c[own] - 1, 0)
        m[own] -= 1
        share = (c.sum(0) + 1e-9) / (m.sum() + 1e-9)
        return np.log((c[1] + PRIOR * share) / (m[1] + PRIOR)) - np.log((c[0] + PRIOR * share) / (m[0] + PRIOR))

    return np.stack([odds(0), odds(1)])


def fit(count: np.ndarray, n: np.ndarray, picks: Callable[[np.ndarray, int], list[Pick]], share: float = 0.5, batch: int = 128, rate: float = 0.5, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax. ``count`` and ``n``: texts by class, with each bucket and in all; ``picks`` looks through all texts
    under bucket logits; ``share`` of all labelled texts are toxic, and toxic windows have that
    share of the weight."""
    if not n.min():
        return Model()
    rng = np.random.default_rng(seed)
    emb = ((rng.random((BUCKETS, SIZE)) - 0.5) / SIZE).astype(np.float32)
    soft, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    soft[1], soft[0] = 0.1, -0.1
    g_emb, g_soft = np.full(BUCKETS, 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    silent: set[int] = set()
    total, shift = np.zeros(BUCKETS, np.float32), 0.0
    for r in range(ROUNDS):
        seen = picks(bucket_odds(count, n) if r == 0 else np.repeat((emb @ (soft[1] - soft[0]))[None], 2, 0), r)
        if r == 0:
            silent = {p.text for p in seen if p.toxic and p.logit <= 0}
            silent = set() if len(silent) == n[1] else silent
        seen = [p for p in seen if p.text not in silent]
        y = np.array([p.toxic for p in seen])
        size = np.maximum([p.size for p in seen], 1)
        lens = np.array([len(p.buckets) for p in seen])
        flat, times = np.concatenate([p.buckets for p in seen]), np.concatenate([p.times for p in seen])
        at = np.concatenate([[0], np.cumsum(lens)])
        weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
        for _ in range(max(2, min(30, STEPS * batch // len(y)))):
            mix = rng.permutation(len(y))
            for k in range(0, len(mix), batch):
                j = mix[k : k + batch]
                owner = np.repeat(np.arange(len(j)), lens[j])
                rows = np.repeat(at[j] - np.concatenate([[0], np.cumsum(lens[j])[:-1]]), lens[j]) + np.arange(lens[j].sum())
                ids, often, many = flat[rows], times[rows], size[j][:, None]
                hidden = np.stack([np.bincount(owner, emb[ids, c] * often, len(j)) for c in range(SIZE)], 1) / many
                p = hidden @ soft.T + bias
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = p.copy()
                d[np.arange(len(j)), y[j]] -= 1
                d *= weight[j][:, None] / len(j)
                d_hidden = d @ soft / many
                d_soft, d_bias = d.T @ hidden, d.sum(0)
                g_soft += (d_soft**2).mean(1) + d_bias**2
                soft -= (rate * d_soft / np.sqrt(g_soft)[:, None]).astype(np.float32)
                bias -= (rate * d_bias / np.sqrt(g_soft)).astype(np.float32)
                ub, ib = np.unique(ids, return_inverse=True)
                d_emb = np.stack([np.bincount(ib, d_hidden[owner, c] * often, len(ub)) for c in range(SIZE)], 1)
                g_emb[ub] += (d_emb**2).mean(1)
                emb[ub] -= (rate * d_emb / np.sqrt(g_emb[ub])[:, None]).astype(np.float32)
        if r >= ROUNDS - LAST:
            total += emb @ (soft[1] - soft[0]) / LAST
            shift += float(bias[1] - bias[0]) / LAST
    tops = [p for p in picks(np.repeat(total[None], 2, 0), ROUNDS) if p.kind == 0 and p.text not in silent]
    scale, more = calibrate(np.array([p.logit for p in tops]) + shift, np.array([p.toxic for p in tops]), share)
    return Model((total * scale).astype(np.float32), shift * scale + more)


def bucket_counts(texts: list[str | None], toxic: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """By class, the texts that have each bucket, and all texts."""
    count = np.zeros((2, BUCKETS), np.int64)
    for t, k in zip(texts, toxic):
        count[k, np.unique(hashed_grams(list(set(words_of(t))), GRAMS, BUCKETS)[0])] += 1
    return count, np.bincount(toxic, minlength=2)


def fit_texts(texts: list[str | None], toxic: list[int], share: float = 0.5) -> Model:
    """``fit`` on texts in memory."""
    return fit(*bucket_counts(texts, toxic), lambda z, r: [p for k, (t, y) in enumerate(zip(texts, toxic)) for p in look(k, t, y, z, r)], share)


def calibrate(x: np.ndarray, y: np.ndarray, share: float = 0.5, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic fit of the texts' highest windows to their labels; classes weigh the same."""
    a, b, w = 1.0, 0.0, np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p) + 1e-9
        m = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(m, [(g * x).sum() + 1e-4 * (a - 1), g.sum() + 1e-4 * b])
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int = 1400, usable=None) -> Model:
    """Fit a model on about ``rows_per_class`` rows of each class, among labels where ``usable`` holds."""
    marks = labels.where(F.lit(True) if usable is None else usable).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model()
    grain = 1 << 20
    limit = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(grain, -(-grain * rows_per_class // n)))]), F.col("y"))
    picked = marks.where(F.pmod(F.xxhash64("id", F.lit("tox")), F.lit(grain)) < limit).limit(2 * rows_per_class * len(counts))
    small_batches(docs.sparkSession)
    # a number for each id, the same in every round
    picked = picked.select("id", "y", F.row_number().over(W.orderBy("id")).alias("k"))
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where("text <> ''").join(F.broadcast(picked), "id")
    numbered = stored(rows.groupBy("k", "y").agg(F.min("text").alias("text")).repartition(TASKS, "k"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            c, m = bucket_counts(b.column(2).to_pylist(), b.column(1).to_pylist())
            total, n = total + c, n + m
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int32).tobytes()]), pa.array([n.tolist()])], ["counts", "n"])

    parts = numbered.mapInArrow(releasing(count), "counts binary, n array<long>").collect()
    n = np.sum([p.n for p in parts], axis=0) if parts else np.zeros(2, np.int64)
    if not n.min():
        return Model()
    total = np.sum([np.frombuffer(p.counts, np.int32).reshape(2, BUCKETS) for p in parts], axis=0)
    del parts

    def picks(z: np.ndarray, r: int) -> list[Pick]:
        z = z.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [p for k, y, text in zip(*(c.to_pylist() for c in b.columns)) for p in look(k, text, y, z, r)]
                columns = [pa.array([getattr(p, f) for p in found], t) for f, t in zip(Pick._fields, PICK)]
                yield pa.RecordBatch.from_arrays(columns, Pick._fields)

        got = numbered.mapInArrow(releasing(run), "text int, toxic int, kind int, logit double, size int, buckets array<int>, times array<int>").toArrow()
        got = got.sort_by([("text", "ascending"), ("kind", "ascending"), ("logit", "descending")])
        return [Pick(*row[:5], np.array(row[5], np.int64), np.array(row[6])) for row in zip(*(c.to_pylist() for c in got.columns))]

    model = fit(total, n, picks, counts[1] / (counts[0] + counts[1]))
    drop(numbered)
    release_memory()
    return model


def score(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``id_col`` and the columns in ``keep``, then (with ``prefix``) score double and predicted int, for every row."""
    small_batches(docs.sparkSession)
    keep = keep or []
    rows = docs.select(quoted(id_col).alias("c0"), *[quoted(k).alias(f"c{i}") for i, k in enumerate(keep, 1)], quoted(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.workers import kept

        table = kept("toxicity", "words", model.table, model.token)
        for b in batches:
            got = model.score(b.column(b.num_columns - 1).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], [*b.schema.names[:-1], "score", "predicted"])

    out = rows.mapInArrow(releasing(run), f"{kinds}, score double, predicted int")
    return out.select(F.col("c0").alias(id_col), *[F.col(f"c{i}").alias(k) for i, k in enumerate(keep, 1)], F.col("score").alias(f"{prefix}score"), F.col("predicted").alias(f"{prefix}predicted"))
