"""Quality classifier by co-training on two views.

One view is the text's content (hashed byte trigrams), the other the page's
metadata (language, source and stated length, nothing of the text).  Each view
has a logistic regression, fitted to a bounded sample of labelled documents.
In each round both classifiers judge all other documents of the corpus in one
pass: where one is sure, by calibrated probability, its label becomes a row of
the other's training set.  Such rows enter by their summed gradient, so a task
returns one vector for each view and class whatever it reads; the curvature of
the step is that of the labelled rows.  Pseudo-labels weigh as much as the
labelled rows at most, by class.  Held-out labelled documents calibrate both
views, so that sureness is a calibrated one, and turn steps away that worsen
the learner.  A small regression combines the calibrated views, and every
document is scored in one pass over the whole texts.

Only the labelled sample is bounded: LABELLED documents, those of the smallest
hashes of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, slices, workspace, written

#: Labelled documents used for training, at most.
LABELLED = 4000
#: Every so many labelled documents one is held out for calibration.
HELD_OUT = 4
TEXT_DIM, LANG_DIM, SOURCE_DIM, STEPS = 512, 16, 64, 20
#: Rounds of exchange, the calibrated probability of a pseudo-label, and the weight of all of them against the labelled rows.
ROUNDS, SURE, WEIGHT = 3, 0.95, 1.0
RIDGE = 1e-3
#: Trigrams at which a text's features have half their weight.
FEW = 60
VIEWS = ("text", "meta")


def text_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, and the share of words that repeat the one before.

    Both shrink towards 0 for texts of few trigrams, which say little.
    """
    out = np.zeros(TEXT_DIM, dtype=np.float32)
    words = text.split()
    repeats = sum(map(eq, words, islice(words, 1, None))) / max(1, len(words))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = 0
    for at in range(0, max(0, len(data) - 2), 1 << 20):  # blocks overlap by two bytes
        b = data[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        out += np.bincount(h >> np.uint32(23), minlength=TEXT_DIM).astype(np.float32)
        total += len(h)
    if total:
        out = np.sqrt(out / total) * 4
    return np.append(out, np.float32(8 * math.sqrt(repeats))) * np.float32(total / (total + FEW))


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed language and source, and steps of the stated length; all zero for a null or negative length."""
    out = np.zeros(LANG_DIM + SOURCE_DIM + STEPS, dtype=np.float32)
    out[crc32((lang or "").encode()) % LANG_DIM] = 1
    out[LANG_DIM + crc32((source or "").encode()) % SOURCE_DIM] = 1
    if n_chars is not None and n_chars >= 0:
        out[LANG_DIM + SOURCE_DIM + min(STEPS - 1, int(math.log2(1 + n_chars)))] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = RIDGE, steps: int = 8) -> np.ndarray:
    """Logistic regression by Newton steps; the bias is the last weight and has no ridge."""
    x = with_bias(x.astype(np.float64))
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


def calibrated(z: np.ndarray, ab: np.ndarray) -> np.ndarray:
    """Calibrated log-odds."""
    return ab[0] * z + ab[1]


class CoTraining:
    """The two views' classifiers while they learn from each other."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        """Fits both views to labelled rows, whose order is fixed so that results repeat; both classes must be there."""
        held = np.arange(0, len(y), HELD_OUT)
        own = np.setdiff1d(np.arange(len(y)), held)
        if len(np.unique(y[held])) < 2 or len(np.unique(y[own])) < 2:
            held = own = np.arange(len(y))
        self.own, self.held = [x[own] for x in views], [x[held] for x in views]
        self.y, self.truth = y[own], y[held]
        good = self.truth.sum()
        self.soft = np.where(self.truth == 1, (good + 1) / (good + 2), 1 / (len(held) - good + 2))  # keeps the odds finite
        self.weights, self.calibration, self.loss = [None, None], [None, None], [math.inf, math.inf]
        #: (round, learner, labels given by the other view, whether they were taken).
        self.history: list[tuple[int, str, int, bool]] = []
        for v in range(2):
            self.take(v, fit(self.own[v], self.y))

    def take(self, v: int, w: np.ndarray) -> bool:
        """Calibrates the weights of a view and keeps them unless they are worse on the held-out rows."""
        z = logit(self.held[v], w)
        ab = fit(z[:, None], self.soft, ridge=1e-6, steps=30)
        p = np.clip(sigmoid(calibrated(z, ab)), 1e-9, 1 - 1e-9)
        loss = float(-np.mean(self.truth * np.log(p) + (1 - self.truth) * np.log(1 - p)))
        if loss > self.loss[v]:
            return False
        self.weights[v], self.calibration[v], self.loss[v] = w, ab, loss
        return True

    def model(self) -> dict[str, np.ndarray]:
        """Weights and calibrations by name, and the weights that combine the views."""
        out = dict(zip(VIEWS, self.weights, strict=True)) | {f"{name}_ab": ab for name, ab in zip(VIEWS, self.calibration, strict=True)}
        both = np.stack([calibrated(logit(x, w), ab) for x, w, ab in zip(self.held, self.weights, self.calibration, strict=True)], axis=1)
        return out | {"both": fit(both, self.soft, ridge=1e-4, steps=30)}

    def learn(self, v: int, gradients: dict[float, tuple[int, np.ndarray]], turn: int) -> None:
        """A step of a view towards the other's pseudo-labels: class -> (rows, gradient summed over them)."""
        pull, mass = np.zeros_like(self.weights[v]), 0.0
        for label, (n, gradient) in gradients.items():
            share = min(float(n), WEIGHT * len(self.y) * float((self.y == label).mean()))
            pull, mass = pull + gradient * (share / n), mass + share
        w, x = self.weights[v], with_bias(self.own[v].astype(np.float64))
        p = sigmoid(x @ w)
        penalty = np.append(np.full(len(w) - 1, RIDGE * (len(x) + mass)), 1e-9)
        curvature = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x * (1 + mass / len(x)) + np.diag(penalty)
        step = np.linalg.solve(curvature, x.T @ (p - self.y) + penalty * w + pull)
        taken = mass > 0 and any(self.take(v, w - step * part) for part in (1.0, 0.5, 0.25))
        self.history.append((turn, VIEWS[v], int(sum(n for n, _ in gradients.values())), taken))


def offers(docs: DataFrame, model: dict[str, np.ndarray]) -> list[dict[float, tuple[int, np.ndarray]]]:
    """For each view, by class: the rows that the other view is sure of, and the view's gradient summed over them.

    One pass over the documents; a task returns a vector for each view and
    class.  Sums are of decimals, so they do not depend on the tasks' order.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, float], list] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            views = _features(batch)
            p = [sigmoid(calibrated(logit(x, model[name]), model[f"{name}_ab"])) for x, name in zip(views, VIEWS, strict=True)]
            for v in range(2):
                for label, sure in ((1.0, p[1 - v] >= SURE), (0.0, p[1 - v] <= 1 - SURE)):
                    if sure.any():
                        x = views[v][sure]
                        error = sigmoid(logit(x, model[VIEWS[v]])) - label
                        row = sums.setdefault((v, label), [0, 0.0])
                        row[0] += len(x)
                        row[1] = row[1] + np.append(error @ x, error.sum())
        if sums:
            yield pd.DataFrame([(v, label, n, g.tolist()) for (v, label), (n, g) in sums.items()], columns=["view", "label", "n", "g"])

    parts = docs.mapInPandas(rows, "view int, label double, n long, g array<double>").select("view", "label", "n", F.posexplode("g").alias("k", "g"))
    total = F.sum((F.col("g") * 1e6).cast("decimal(27,0)")).cast("double")
    out: list[dict[float, tuple[int, np.ndarray]]] = [{}, {}]
    for r in parts.groupBy("view", "label", "k").agg(F.sum("n").alias("n"), (total / 1e6).alias("g")).collect():
        of = len(model[VIEWS[r.view]])
        out[r.view].setdefault(r.label, (r.n, np.zeros(of)))[1][r.k] = r.g
    return out


def probabilities(model: dict[str, np.ndarray] | float, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a good document by content, by metadata, and by both."""
    if isinstance(model, float):
        return (np.full(len(text), model),) * 3
    a, b = calibrated(logit(text, model["text"]), model["text_ab"]), calibrated(logit(meta, model["meta"]), model["meta_ab"])
    return sigmoid(a), sigmoid(b), sigmoid(logit(np.stack([a, b], axis=1), model["both"]))


def _read(docs: DataFrame, id_col: str) -> DataFrame:
    """The columns that features need; absent metadata counts as null."""

    def column(name: str, kind: str):
        return (F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)).alias(name)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(column("text", "string"), F.lit("")).alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "double"))


def _features(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_features(t) for t in batch["text"]])
    meta = np.stack([meta_features(*row) for row in zip(batch["lang"], batch["source"], batch["n_chars"], strict=True)])
    return text, meta


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> CoTraining | float:
    """Trains both views; a constant if the labels name one class at most. See train()."""
    with workspace(docs.sparkSession):
        judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) > 0.5).cast("double").alias("y"))
        ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
        chosen, _ = written(judged.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(LABELLED), "quality-sample")
        everything = _read(docs, id_col)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for batch in slices(whole):
                    text, meta = _features(batch)
                    yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "t": [x.tobytes() for x in text], "m": [x.tobytes() for x in meta]})

        kind = docs.schema[id_col].dataType.simpleString()
        featured = join_sized(everything, chosen, "id", "inner").mapInPandas(rows, f"id {kind}, y double, t binary, m binary")
        # one row of each id, so a hot id does not reach the driver whole
        got = featured.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("t", "m")).alias("x")).select("id", "y", "x.t", "x.m").toPandas().sort_values("id")
        y = got["y"].to_numpy(dtype=float)
        if len(np.unique(y)) < 2:
            return float(y.mean()) if len(y) else 1.0
        state = CoTraining(tuple(np.stack([np.frombuffer(x, dtype=np.float32) for x in got[c]]) for c in ("t", "m")), y)
        rest = join_sized(everything, chosen.select("id"), "id", "left_anti")
        for turn in range(ROUNDS):
            given = offers(rest, state.model())
            before = list(state.weights)
            for v in range(2):
                state.learn(v, given[v], turn)
            if all(a is b for a, b in zip(before, state.weights, strict=True)):
                break  # neither view takes the other's labels, so a further round would offer the same
        return state


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict[str, np.ndarray] | float:
    """Trains on at most LABELLED labelled documents and on all others without their labels.

    A document with several labels counts as good if their mean is above one
    half; null labels and null ids are left out, labels of absent documents
    have no effect, and of several rows of one labelled id that of the smallest
    features counts.  Labels of one class give a constant; no labels or no
    documents give one that keeps everything.  Texts are read whole.
    """
    state = co_train(docs, labels, id_col, label_col)
    return state if isinstance(state, float) else state.model()


def score(docs: DataFrame, model: dict[str, np.ndarray] | float, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Scores every document by its whole text and metadata.

    Returns id, p_text, p_meta, p_good and keep (p_good at least `least`, so a
    tie is kept).  Null and empty texts have no content features, null metadata
    is a value of its own; very long texts are hashed in blocks; repeated rows
    give repeated rows; null ids stay; other columns, whatever their names, are
    not read; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in slices(whole):
                a, b, c = probabilities(model, *_features(batch))
                yield pd.DataFrame({"id": batch["id"], "p_text": a, "p_meta": b, "p_good": c, "keep": c >= least})

    kind = docs.schema[id_col].dataType.simpleString()
    return _read(docs, id_col).mapInPandas(rows, f"id {kind}, p_text double, p_meta double, p_good double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: dict[str, np.ndarray] | float, least: float = 0.5) -> DataFrame:
    """The rows whose document is good, in one pass: all columns stay, none is shuffled; cases as in score()."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BooleanType())
    def good(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars})
        parts = [probabilities(model, *_features(part))[2] >= least for part in slices(frame)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=bool)

    columns = [F.col(c).cast(k) if c in docs.columns else F.lit(None).cast(k) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "double"))]
    return docs.where(good(F.coalesce(F.col("text"), F.lit("")), *columns))
