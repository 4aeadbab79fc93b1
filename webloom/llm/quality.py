"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Features are rates of marks, words and lines over the whole text, counted on its
bytes an Arrow batch at a time. Pairs of a good and a bad labelled document are
preferences; the probability that the first wins is the logistic function of the
difference of linear scores (Bradley and Terry, 1952), fitted by logistic loss
on feature differences. The cut is a quantile of the scores: the share of bad
labels among the labelled rows learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.words import Words, text_runs
from webloom.runtime import ship_package

#: Classes of bytes that are counted, by what they hold.
MARKS = ("#$%&*@^~=_<>{}[]\\+", "!?", "|", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:", "\"'`()", " \t\r", "\n")
NAMES = (
    "length", "symbols", "bangs", "bars", "digits", "upper", "stops", "quotes", "breaks", "word_length", "repeated_lines", "short_words",
    "inverse_length", "distinct_words", "growth_of_words", "squared_symbols", "squared_bars", "squared_upper",
)
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _marks in enumerate(MARKS):
    _CLASS[list(_marks.encode())] = _i + 1
_CLASS[0x80:0xC0] = len(MARKS) + 1  # later bytes of a character
_LINES = np.ones(256, dtype=bool)
_LINES[10] = False


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; a null text counts as empty."""
    rows = np.zeros((len(texts), len(NAMES)))
    for at, run in text_runs(texts):
        words, lines = Words(run, positions=True), Words(run, letters=_LINES)
        classes = _CLASS[words.data]
        short = np.append(0, np.cumsum(words.ends - words.starts <= 3))
        for i in range(len(run)):
            a, b = words.stops[i], words.stops[i + 1]
            counts = np.bincount(classes[a:b], minlength=len(MARKS) + 2)
            chars = max(1, b - a - counts[-1])
            u, v = words.first[i], words.first[i + 1]
            n, distinct = v - u, len(np.unique(words.hashes[u:v]))
            x, y = lines.first[i], lines.first[i + 1]
            rate = np.log1p(200 * counts[1:-1] / chars)
            spaces = counts[8] + counts[9] + 1
            rows[at + i] = (
                np.log1p(chars), *rate[:7], np.log1p(200 * counts[9] / spaces), chars / spaces,
                1 - len(np.unique(lines.hashes[x:y])) / max(1, y - x), np.log1p(200 * (short[v] - short[u]) / spaces),
                1 / spaces, distinct / max(1, n), np.log1p(distinct) / np.log1p(max(1, n)), rate[0] ** 2, rate[2] ** 2, rate[4] ** 2,
            )
    return rows


@dataclass(frozen=True)
class Model:
    """score = logistic(sum of weight * (feature - mean) / scale - cut + logit(threshold))."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    cut: float
    threshold: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1; the cut quantile maps to the threshold."""
        raw = (features(texts) - np.array(self.means)) / np.array(self.scales) @ np.array(self.weights)
        shift = float(np.log(self.threshold / (1 - self.threshold))) - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + shift, -500, 500)))

    def score(self, text: Column) -> Column:
        def scored(texts: pa.Array) -> pa.Array:
            return pa.array(self.scores(texts), pa.float64())

        ship_package()
        return F.arrow_udf(scored, "double")(text)


def _features(texts: pa.Array) -> pa.Array:
    rows = features(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)), pa.array(rows.ravel()))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    max_rows: int = 20_000,
    pairs: int = 200_000,
    ridge: float = 1e-3,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Learn from labelled documents: docs and labels are joined by id.

    At most max_rows labels are used, those whose hashed ids are smallest; that
    bounds the side of the join that is broadcast and what reaches the driver,
    which is the features of their documents. `pairs` preference pairs are drawn
    from them. Rows with a null id or label are left out; of rows of docs that
    share an id, the one whose features are least is learned from. With labels of one
    kind only there are no pairs: every score is then above the threshold if the
    labels are 1, or none are known, and below it if they are 0.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null and _label in (0, 1)").distinct()
    rows = rows.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "_label").limit(max_rows)
    names = NAMES
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(rows), F.col("_doc") == F.col("_id"))
    found = joined.select("_id", "_label", F.arrow_udf(_features, "array<double>")(F.col("_text")).alias("x"))
    # of rows that share an id the one of the least features counts, so that runs agree and the bound holds
    got = found.groupBy("_id", "_label").agg(F.min("x").alias("x")).toPandas().sort_values(["_id", "_label"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(names))
    y = got["_label"].to_numpy(dtype=int)
    if not len(y) or y.min() == y.max():
        zero = (0.0,) * len(names)
        return Model(names, zero, zero, (1.0,) * len(names), -8.0 if not len(y) or y[0] == 1 else 8.0, threshold)
    means, scales = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - means) / scales
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(len(names))
    for _ in range(30):  # Newton's method for the logistic loss, whose minimum is unique with the ridge
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -50, 50)))
        gradient = -(diff * (1 - p)[:, None]).mean(axis=0) + ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = np.sort(z @ w)
    at = int((y == 0).sum())
    # the middle between the neighbours of the quantile
    cut = float(raw[at - 1] + raw[min(at, len(raw) - 1)]) / 2
    return Model(names, tuple(map(float, w)), tuple(map(float, means)), tuple(map(float, scales)), cut, threshold)


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how: int
) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per input row.

    Labels are learned only from rows whose crc32 of the id as text is not 0
    modulo folds; the others, and rows with a null id, are held out. Scores come
    from texts alone; null texts score as empty ones. predicted is 1 where the
    score is at least the threshold. An empty table gives an empty result.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))
    model = fit(docs.filter(~held), labels.filter(~held), threshold, id_col=id_col, text_col=text_col, label_col=label_col, **how)
    scored = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), model.score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
