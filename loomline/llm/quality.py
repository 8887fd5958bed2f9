"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is how many of its two ratings are good: 0 (junk and toxic) < 1 (one of them) < 2 (sound). One weight per hashed text feature is shared by all grades;
ordered thresholds t0 < t1 cut the score: P(grade <= k) = logistic(t_k - w.x). So the score gives an expected grade
and the tail probability P(grade >= 2), by which documents are selected.

The model is fitted on a bounded sample of rated rows (in hash order of the key, SAMPLE rows with LISTED features at most), which is all that the driver gets. Scoring reads every whole text, one pass, no shuffle.

A null text counts as empty. Unrated or null ratings are left out of the fit; without any rating, or with one grade only, nothing
is known against a document and every one is selected. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import CACHE_ENTRIES, batch, dropped, key_columns, written

#: Rated rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Features of those rows together, at most: 64 MiB on the driver.
LISTED = 1 << 24
#: Hashed feature space, and the features with weights: those that tell grades apart best.
SPACE = 1 << 20
FEATURES = 4096
#: Rated rows that a feature is in, at least, and its least chi-square over the grades: chance hardly gets there.
SUPPORT, EVIDENCE = 4, 25.0
GRADES = 3
#: First letters by which words are grouped.
BEGINNING = 5
#: Least tail probability P(grade >= 2) of a selected document.
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_SIGNS = b"!#$%&*+<=>@^_|~{}[]\\"
_DIGITS = bytes(range(48, 58))
_TRIM = re.compile(r"^\W+|\W+$")


class _Words(dict):
    """Word as it stands in the text -> index of its hashed, trimmed and lower-cased form."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 2 * CACHE_ENTRIES:
            self.clear()
        value = self[word] = _index("w", _TRIM.sub("", word).lower())
        return value


class _Beginnings(dict):
    """Word as it stands in the text -> index of its first letters; 0 for short words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 2 * CACHE_ENTRIES:
            self.clear()
        clean = _TRIM.sub("", word).lower()
        value = self[word] = _index("b", clean[:BEGINNING]) if len(clean) > BEGINNING else 0
        return value


class _Known:
    """The caches of one worker."""

    def __init__(self):
        self.words, self.beginnings = _Words(), _Beginnings()


def _index(kind: str, value: object) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}={value}") % SPACE


def _shapes(text: str, words: list[str]) -> list[int]:
    """Features of the whole text: shares of capitals, signs, digits, repeated words and lines, in steps."""
    data = text.encode("utf-8", "replace")
    n, count = max(1, len(data)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    share = lambda kinds: (n - len(data.translate(None, kinds))) / n
    steps = {
        "upper": share(_UPPER),
        "signs": share(_SIGNS),
        "digits": share(_DIGITS),
        "repeated": 1 - len(set(words)) / count,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    found = [_index(k, min(10, int(20 * v + 0.5))) for k, v in steps.items()]
    return [*found, _index("size", min(12, len(words).bit_length())), _index("length", min(15, n // count))]


def features(text: str, known: _Known) -> np.ndarray:
    """Distinct hashed features of a text, ascending: words, how many different words share their first letters, shapes."""
    parts = text.split()
    distinct = set(parts)
    shared = Counter(map(known.beginnings.__getitem__, distinct))
    del shared[0]
    steps = {(b * 31 + min(n, 4)) % SPACE for b, n in shared.items() if n > 1}
    return np.unique(np.fromiter({*map(known.words.__getitem__, distinct), *steps, *_shapes(text, parts)}, np.uint32))


@dataclass
class Model:
    indices: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    #: None: nothing was learned, every document is selected.
    fitted: bool = True

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. GRADES - 2."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -60, 60)))


def likelihood(w: np.ndarray, raw: np.ndarray, column: np.ndarray, owner: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood less the ridge's half, and its gradient by the weights and the two raw thresholds (t0 = raw0, t1 = raw0 + exp(raw1)). column, owner: the features that each text has."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    low, high, n = grades == 0, grades == GRADES - 1, len(grades)
    score = np.bincount(owner, w[column], minlength=n)
    t0, t1 = raw[0], raw[0] + np.exp(raw[1])
    a, b = sigmoid(t0 - score), sigmoid(t1 - score)
    likely = np.maximum(np.where(low, a, np.where(high, 1 - b, b - a)), 1e-9)
    da = np.where(high, 0, np.where(low, 1, -1)) * a * (1 - a) / likely
    db = np.where(low, 0, np.where(high, -1, 1)) * b * (1 - b) / likely
    down = (da + db) / n  # derivative by -score
    slope = np.concatenate([-np.bincount(column, down[owner], minlength=len(w)) - ridge * w, [down.sum(), db.mean() * np.exp(raw[1])]])
    return float(np.log(likely).mean() - ridge / 2 * (w * w).sum()), slope


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 5e-5) -> Model:
    """Maximum likelihood of the cumulative-link model by full-batch Adam steps; deterministic."""
    if not len(rows) or len(np.unique(grades)) < 2:
        return Model(np.empty(0, np.uint32), np.empty(0), np.array([-40.0, -40.0]), False)
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    names, column = np.unique(flat, return_inverse=True)
    by_grade = np.stack([np.bincount(column[grades[owner] == g], minlength=len(names)) for g in range(GRADES)])
    seen, share = by_grade.sum(0), np.bincount(grades, minlength=GRADES) / len(grades)
    expected = share[:, None] * seen
    gain = np.where(seen >= SUPPORT, ((by_grade - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0), -1)
    best = np.sort(np.argsort(-gain, kind="stable")[: min(FEATURES, int((gain >= EVIDENCE).sum()))])
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    used = place[column] >= 0
    column, owner = place[column][used], owner[used]
    w, raw = np.zeros(len(best)), np.array([-1.0, 0.0])  # thresholds: t0 = raw0, t1 = raw0 + exp(raw1)
    state = [np.zeros(len(best) + 2), np.zeros(len(best) + 2)]
    for step in range(1, steps + 1):
        _, g = likelihood(w, raw, column, owner, grades, ridge)
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, raw = w + move[:-2], raw + move[-2:]
    return Model(names[best].astype(np.uint32), w, np.array([raw[0], raw[0] + np.exp(raw[1])]))


def grade(labels: DataFrame) -> DataFrame:
    """doc_id, grade: how many ratings are good (quality 1, toxic 0); a null rating gives no row."""
    value = (F.col("quality") == 1).cast("int") + (F.col("toxic") == 0).cast("int")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), value.alias("grade")).where("grade is not null and doc_id is not null")


LISTS = "doc_id long, grade int, found binary"


def train(docs: DataFrame, graded: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, listed: int = LISTED) -> Model:
    """Fit on at most `sample` rated rows, and on so many of them that their distinct features are `listed` at most; each key counts once. These two bound what the driver gets."""
    chosen = graded.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Known()
        for rows in batches:
            yield batch(LISTS, doc_id=rows.column(0), grade=rows.column(2), found=[features(x.as_py(), words).tobytes() for x in rows.column(1)])

    rated = written(key_columns(docs, key, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade").mapInArrow(run, LISTS), "lists")
    # The lists that fit, in hash order: one number a row decides, for at most `sample` rows (and copies of their keys).
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = rated.groupBy("doc_id").agg(F.max(F.length("found")).alias("size")).withColumn("sum", F.sum("size").over(order)).where(F.col("sum") <= 4 * listed).select("doc_id")
    one = F.min(F.struct("grade", "found")).alias("row")
    rows = sorted((r.doc_id, r.row.grade, bytes(r.row.found)) for r in rated.join(F.broadcast(fitting), "doc_id").groupBy("doc_id").agg(one).collect())
    dropped(rated)
    return fit([np.frombuffer(r[2], np.uint32) for r in rows], np.array([r[1] for r in rows], int))


SCORED = "doc_id long, score double, expected_grade double, p_junk double, p_sound double, selected boolean"


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: score, expected grade, P(grade = 0), P(grade = 2) and whether that reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = _Known(), np.zeros(SPACE)
        weights[model.indices] = model.weights
        for rows in batches:
            scores = np.array([weights[features(x.as_py(), words)].sum() for x in rows.column(1)])
            below = model.probabilities(scores) if len(scores) else np.empty((0, GRADES - 1))
            yield batch(
                SCORED,
                doc_id=rows.column(0),
                score=scores,
                expected_grade=GRADES - 1 - below.sum(1),
                p_junk=below[:, 0],
                p_sound=1 - below[:, 1],
                selected=(1 - below[:, 1] >= threshold) if model.fitted else np.ones(len(scores), bool),
            )

    return key_columns(docs, key, text).mapInArrow(run, SCORED)


def select(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose tail probability reaches the threshold, with all their columns; no shuffle."""
    column = _selector(model, threshold)
    return docs.where(column(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _selector(model: Model, threshold: float):
    held: dict = {}

    def sound(texts: pd.Series) -> pd.Series:
        if not held:
            held["words"], held["weights"] = _Known(), np.zeros(SPACE)
            held["weights"][model.indices] = model.weights
        scores = np.array([held["weights"][features(x, held["words"])].sum() for x in texts])
        if not model.fitted or not len(scores):
            return pd.Series(np.ones(len(scores), bool))
        return pd.Series(1 - model.probabilities(scores)[:, 1] >= threshold)

    return pandas_udf(sound, "boolean")
