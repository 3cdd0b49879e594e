"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it.

Features are hashed counts of letter n-grams (one to three letters, words padded by a space) of the whole
text, square-rooted and scaled to unit length. One linear SVM per family (against the rest) picks the
family; inside it one SVM per pair of languages votes, ties by the sum of margins. The score is the
family's share of the softmax over family margins times the winner's mean logistic margin.

Training uses a bounded sample: for every language the ``per_language`` labelled rows (and at most
``languages`` languages, ``SAMPLE`` rows in all) whose hashed id and text are smallest, and of these only the
feature vectors leave the executors, so what the driver holds is bounded by ``SAMPLE * dims`` numbers (262 MB
as they are sent, twice that as they are used). The prediction itself is a map over all rows and needs no shuffle.

Edge cases: null text or a text without a letter gives ``und`` with score 0; without any labelled row every
text is ``und``; with one language every text with a letter is that one; rows with null labels never train;
a row with a null id is not held out and never trains; repeated rows are predicted each and train once; a
tie of families goes to the first by name, a tie of languages to the larger sum of margins and then the first by
name; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

DIMS = 4_096
PER_LANGUAGE = 500
LANGUAGES = 256
SAMPLE = 32_000
EPOCHS = 12
REGULARISE = 1e-4
UNKNOWN = "und"

#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), f"own:{base}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[str | None], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(unit-length vectors, whether the text has a letter)."""
    out = np.zeros((len(texts), dims), np.float32)
    some = np.zeros(len(texts), bool)
    shift = 33 - dims.bit_length()  # dims is a power of two
    for at, text in enumerate(texts):
        counts = np.zeros(dims)
        # in pieces, so that memory does not follow the text; two characters overlap to keep every n-gram
        low = (text or "").lower()
        for start in range(0, len(low), 1 << 20):
            codes = np.frombuffer((" " * (start == 0) + low[max(0, start - 2) : start + (1 << 20)] + " " * (start + (1 << 20) >= len(low))).encode("utf-32-le", "replace"), np.uint32)
            letter = _letters()[codes]
            some[at] |= bool(letter.any())
            codes = np.where(letter, codes, 32)
            codes = codes[letter | np.r_[True, letter[:-1]]]
            if len(codes) < 3:
                continue
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            x, y, z = a * np.uint32(0x85EBCA6B), b * np.uint32(0xC2B2AE35), c * np.uint32(0xFD7046C5)
            h = np.concatenate([y, (x ^ (y >> np.uint32(5))) + np.uint32(0x27D4EB2F), (x ^ (y >> np.uint32(7)) ^ (z >> np.uint32(11))) * np.uint32(0x9E3779B1)])
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2545F491)
            counts += np.bincount(h >> np.uint32(shift), minlength=dims)
        if some[at]:
            v = np.sqrt(counts)
            out[at] = v / max(np.linalg.norm(v), 1e-12)
    return out, some


def svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, regularise: float = REGULARISE) -> np.ndarray:
    """Weights (bias last) of a linear SVM for labels of -1 and 1: averaged stochastic subgradients, classes weighted evenly."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, total, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    chance = np.random.default_rng(7)
    batch = 32
    for _ in range(epochs):
        order = chance.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            step += 1
            rate = 1 / (regularise * (step + 10 / regularise * 0.02))
            wrong = y[some] * (x[some] @ w) < 1
            w *= 1 - rate * regularise
            if wrong.any():
                hit = some[wrong]
                w += rate / len(some) * ((y[hit] * weight[hit]) @ x[hit])
            total += w
    return (total / max(1, step)).astype(np.float32)


class Model:
    """Fitted weights; plain arrays, so it can be sent to every executor."""

    def __init__(self, x: np.ndarray, langs: list[str], dims: int = DIMS):
        self.dims = dims
        self.langs = sorted(set(langs))
        names = np.array(langs)
        self.families = sorted({family_of(n) for n in self.langs})
        self.members = {f: [n for n in self.langs if family_of(n) == f] for f in self.families}
        of = np.array([family_of(n) for n in langs])
        self.family_weights = np.stack([svm(x, np.where(of == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs: dict[tuple[str, str], np.ndarray] = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (names == a) | (names == b)
                self.pairs[a, b] = svm(x[rows], np.where(names[rows] == a, 1.0, -1.0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x, some = features(texts, self.dims)
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        x = np.c_[x, np.ones(len(x), x.dtype)]
        if self.family_weights is None:
            chosen, trust = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.family_weights.T
            grown = np.exp(2 * np.clip(margins - margins.max(axis=1, keepdims=True), -50, 0))
            chosen, trust = margins.argmax(axis=1), grown.max(axis=1) / grown.sum(axis=1)
        langs, scores = [UNKNOWN] * len(x), [0.0] * len(x)
        for at, f in enumerate(self.families):
            rows = np.flatnonzero(some & (chosen == at))
            names = self.members[f]
            if not len(rows):
                continue
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for (a, b), w in self.pairs.items():
                if a in names:
                    m = x[rows] @ w
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    p = 1 / (1 + np.exp(-2 * np.clip(m, -25, 25)))
                    sums[:, i] += p
                    sums[:, j] += 1 - p
            best = (votes + sums / (len(names) + 1)).argmax(axis=1)
            for k, row in enumerate(rows):
                langs[row] = names[best[k]]
                inner = sums[k, best[k]] / (len(names) - 1) if len(names) > 1 else 1.0
                scores[row] = float(min(1.0, max(0.0, trust[row] * inner)))
        return langs, scores


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, dims: int = DIMS) -> Model:
    """Train on the bounded sample of ``labelled`` (every row of it may train)."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names = [(r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not names:
        return Model(np.zeros((0, dims), np.float32), [], dims)
    per_language = max(1, min(per_language, SAMPLE // len(names)))
    # a hash range per language that about per_language rows fall into; repeats of a row count once
    within = F.lit(False)
    for name, count in names:
        share = min(1.0, 1.3 * per_language / count)
        within = within | ((F.col("lang") == name) & (F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x, _ = features(part.column(2).to_pylist(), dims)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "h", "v"])

    sample = rows.filter(within).dropDuplicates(["lang", "h"]).mapInArrow(run, "lang string, h long, v binary").collect()
    sample = sorted(sample, key=lambda r: (r["lang"], r["h"], r["v"]))
    kept, seen = [], {}
    for r in sample:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_language:
            kept.append(r)
    x = np.stack([np.frombuffer(r["v"], np.float16).astype(np.float32) for r in kept])
    return Model(x, [r["lang"] for r in kept], dims)


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` added (columns of those names are replaced)."""
    source = documents.drop("lang_pred", "score")
    at = source.columns.index(text_col)
    schema = source.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                langs, scores = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all: the rows with held_out, lang_pred and score."""
    small_batches(documents.sparkSession)
    model = fit(documents.filter(F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))), id_col, text_col, lang_col)
    return predict(documents.withColumn("held_out", is_held_out(F.col(id_col))), model, text_col)
