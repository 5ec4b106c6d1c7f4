"""Language identification by hierarchical discrimination.

A linear support vector machine picks the language family; one-versus-one machines then separate the languages
within that family, by votes and then by summed margins. Features are hashed character 1- to 3-grams of
``<word>`` and the whole word, averaged over a text's words, so every machine's output is a mean of per-word scores.
That makes prediction a table lookup per word (``WordTable``) over the whole text.

Training uses a sample of the rows that have a language: about ``rows_per_language`` of each (at most twice that, by a
hash threshold from exact counts). Executors turn sampled rows into vectors of ``DIM`` floats, so the driver
receives at most 2 * rows_per_language * languages * 8 KB, whatever the texts' length.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text if no row has a
language. Repeated rows get equal values. Ties go to the first language in alphabetical order.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, release_memory, releasing, small_batches
from .wordtable import WordTable, blocks, hashed_grams

DIM = 2048
SIZES = (1, 2, 3)
RUN = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no decimal digits
# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], f"only:{lang}")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (category L) in lower case."""
    runs = RUN.findall((text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


def text_vector(text: str | None) -> np.ndarray | None:
    """Mean of the word features' counts over the text's words; None without a letter."""
    words = words_of(text)
    if not words:
        return None
    counts = Counter(words)
    ids, owner = hashed_grams(list(counts), SIZES, DIM)
    return (np.bincount(ids, np.array(list(counts.values()))[owner], DIM) / len(words)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, y in {-1, 1}, by accelerated gradient steps; classes weigh the same."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    out = lambda v: x @ v[:-1] + v[-1]
    back = lambda g: np.append(x.T @ g, g.sum())
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(20):
        v = back(weight * out(v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (2.2 * float(np.linalg.norm(back(weight * out(v)))) + penalty)
    w, z, t = np.zeros(len(v), np.float32), np.zeros(len(v), np.float32), 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * out(z))
        new = z + rate * (2 * back(weight * y * gap) - penalty * z)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, z, t = new, new + (t - 1) / t_new * (new - w), t_new
    return w[:-1], float(w[-1])


class Model:
    """Stacked machines: families (one against the rest), then the pairs within each family."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        n = (len(self.families) if len(self.families) > 1 else 0) + len(self.pairs)
        self.weights, self.bias = np.zeros((DIM, n), np.float32), np.zeros(n, np.float32)
        self.token = uuid.uuid4().hex

    def fit(self, x: np.ndarray, langs: np.ndarray) -> "Model":
        mean, spread = x.mean(0), x.std(0) + np.float32(1e-3)
        z = x - mean
        z /= spread
        fam = np.array([family_of(v) for v in langs])
        tasks = [(fam == f, np.ones(len(z), bool)) for f in self.families] if len(self.families) > 1 else []
        tasks += [(langs == a, (langs == a) | (langs == b)) for _, a, b in self.pairs]
        for k, (positive, used) in enumerate(tasks):
            w, b = fit_svm(z if used.all() else z[used], np.where(positive[used], 1, -1).astype(np.float32))
            self.weights[:, k], self.bias[k] = w / spread, b - float(w @ (mean / spread))
        return self

    def table(self) -> WordTable:
        w = self.weights

        def rows(words: list[str]) -> np.ndarray:
            ids, owner = hashed_grams(words, SIZES, DIM)
            return np.stack([np.bincount(owner, c[ids], len(words)) for c in np.ascontiguousarray(w.T)], 1) if w.shape[1] else np.zeros((len(words), 0))

        return WordTable(rows, w.shape[1])

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """The language and a score from the machines' outputs."""
        squash = lambda m: 1 / (1 + np.exp(-4 * m))
        several = len(self.families) > 1
        at = len(self.families) if several else 0
        family, score = self.families[int(np.argmax(margins[:at]))] if several else self.families[0], 1.0
        if several:
            score = float(squash(margins[:at].max()))
        members = self.members[family]
        if len(members) == 1:
            return members[0], score
        votes, sums, worst = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, np.inf)
        for k, (f, a, b) in enumerate(self.pairs, at):
            if f == family:
                m = float(margins[k])
                votes[a if m >= 0 else b] += 1
                for lang, s in ((a, m), (b, -m)):
                    sums[lang] += s
                    worst[lang] = min(worst[lang], s)
        best = max(members, key=lambda x: (votes[x], sums[x]))
        return best, score * float(squash(worst[best]))

    def predict(self, texts: list[str | None], table: WordTable) -> list[tuple[str, float]]:
        """(language, score) of each text; words are looked up for a block of texts at once."""
        out = []
        for some in blocks(texts):
            words = [words_of(t) if self.langs else [] for t in some]
            n = np.fromiter(map(len, words), np.int64, len(words))
            rows, _ = table.take([w for x in words for w in x])
            full = np.flatnonzero(n)
            margins = iter(np.add.reduceat(rows, (np.cumsum(n) - n)[full], axis=0, dtype=np.float64) / n[full, None] + self.bias if len(full) else ())
            out += [self.decide(next(margins)) if k else ("und", 0.0) for k in n]
        return out


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str, usable: Column | None = None, rows_per_language: int = 800) -> Model:
    """Fit a model on about ``rows_per_language`` rows of each language among the rows where ``usable`` holds."""
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"), (F.lit(True) if usable is None else usable).alias("ok"))
    rows = rows.where("ok AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([])
    grain = 1 << 20
    limit = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(grain, -(-grain * rows_per_language // n)))]), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(grain)) < limit).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(lang, v) for lang, v in zip(b.column(0).to_pylist(), map(text_vector, b.column(1).to_pylist())) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["lang", "vector"])

    got = picked.mapInArrow(releasing(run), "lang string, vector binary").limit(2 * rows_per_language * len(counts)).toArrow().sort_by("lang")
    if not got.num_rows:
        return Model([])
    x = np.empty((got.num_rows, DIM), np.float32)
    for k, v in enumerate(got["vector"]):
        x[k] = np.frombuffer(v.as_buffer(), np.float32)
    langs = np.array(got["lang"].to_pylist())
    del got
    order = np.lexsort((x[:, 1], x[:, 0], langs))  # the same sums whatever order the rows came in
    x, langs = x[order], langs[order]
    model = Model(list(set(langs.tolist()))).fit(x, langs)
    del x, order
    release_memory()
    return model


def identify(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``id_col`` and the columns in ``keep``, then (with ``prefix``) lang_pred string and score double, for every row."""
    small_batches(docs.sparkSession)
    keep = keep or []
    rows = docs.select(quoted(id_col).alias("c0"), *[quoted(k).alias(f"c{i}") for i, k in enumerate(keep, 1)], quoted(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.workers import kept

        table = kept("langid", "words", model.table, model.token)
        for b in batches:
            got = model.predict(b.column(b.num_columns - 1).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    out = rows.mapInArrow(releasing(run), f"{kinds}, lang_pred string, score double")
    return out.select(F.col("c0").alias(id_col), *[F.col(f"c{i}").alias(k) for i, k in enumerate(keep, 1)], F.col("lang_pred").alias(f"{prefix}lang_pred"), F.col("score").alias(f"{prefix}score"))
