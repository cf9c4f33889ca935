"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch
from flowloom.llm.sketch import U, pieces_of, prefix_hashes

PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of a fit: about `positive` confirmed toxic and `unlabelled` other texts are drawn by hash, whole, and `features` hashed features kept."""

    positive: int = 4000
    unlabelled: int = 12000
    features: int = 1024
    least_z: float = 6.0
    steps: int = 600
    rate: float = 0.05
    decay: float = 0.0
    threshold: float = 0.7


@dataclass
class Model:
    """Weights of hashed words and word beginnings, sorted by hash; a text's logit is bias plus the weights it has."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            seen = np.zeros(len(self.features), bool)
            for h in hashed(text):
                seen[_found(self.features, h)] = True
            out[i] = self.bias + self.weights[seen].sum()
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _found(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where in the sorted names those of the values stand that are among them."""
    if not len(names):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return at[names[at] == values]


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of a text's words and their first bytes, piece by piece: runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    for piece in pieces_of(text):
        yield from prefix_hashes(piece, PREFIXES)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, how: Fit) -> Model:
    """Fit a linear model on sets of hashed features by non-negative PU risk (Kiryo et al. 2017).

    Risk = prior * E_p[l(s)] + max(0, E_u[l(-s)] - prior * E_p[l(-s)]) with logistic
    loss l. When the second part falls below 0, a step raises it instead of lowering
    the sum, so the model can't fit unlabelled text as negative at any price.
    Features are those whose rate in positive text is significantly above that in
    unlabelled text (z of least_z or more); their weights are never negative.
    """
    if not positive or not unlabelled:
        return Model(np.empty(0, U), np.empty(0), -60.0)
    names, counts = np.unique(np.concatenate(positive), return_counts=True)
    names, counts = names[counts >= 3], counts[counts >= 3]
    other = np.zeros(len(names), np.int64)
    for x in unlabelled:
        other[_found(names, x)] += 1
    a, b = counts / len(positive), other / len(unlabelled)
    both = (counts + other + 1) / (len(positive) + len(unlabelled) + 2)
    z = (a - b) / np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)))
    best = np.flatnonzero(z >= how.least_z)
    best = np.sort(best[np.argsort(-z[best], kind="stable")][: how.features])
    names = names[best]

    def table(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows of features that sets have, and the share of sets with each."""
        kinds, counts = np.unique(np.stack([np.packbits(np.bincount(_found(names, x), minlength=len(names)) > 0) for x in sets]), axis=0, return_counts=True)
        return np.unpackbits(kinds, axis=1, count=len(names)).astype(np.float64), counts / len(sets)

    (p, np_), (u, nu) = table(positive), table(unlabelled)
    strong = z[best] >= z[best].max(initial=0) / 2
    seen_p, seen_u = (p[:, strong].any(1) * np_).sum(), (u[:, strong].any(1) * nu).sum()
    if seen_p:
        # for any event, its rate in all text over that in toxic text is an upper bound of the prior
        prior = min(prior, max(seen_u / seen_p, 0.001))
    w, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -60, 60)))
    for step in range(1, how.steps + 1):
        sp, su = p @ w + bias, u @ w + bias
        lp, lu = sigmoid(sp), sigmoid(su)
        rest = nu @ np.logaddexp(0, su) - prior * (np_ @ np.logaddexp(0, sp))
        gp, gu, gn = -(1 - lp) * np_, lu * nu, lp * np_
        lower = np.append(u.T @ gu - prior * (p.T @ gn), gu.sum() - prior * gn.sum())
        grad = np.append(prior * (p.T @ gp), prior * gp.sum()) + lower if rest >= 0 else -lower
        grad[:-1] += how.decay * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = how.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    return Model(names, w, bias)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative PU risk of logits of positive and unlabelled texts, by its definition."""
    loss = lambda s: np.logaddexp(0, -s).mean()
    return prior * loss(positive) + max(0.0, loss(-unlabelled) - prior * loss(-positive))


def held_out(id_col: Column) -> Column:
    """Rows whose labels no fit may use: crc32 of the id as text leaves 1 on division by 3. A null id is not one."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from confirmed toxic documents and a sample of all others, neither held out.

    The prior is the share of toxic ones among the labelled rows it may use (0.1
    without any; kept between 0.001 and 0.5). Null labels, ids and texts are not
    drawn. Without toxic examples the model scores everything 0.
    """
    usable = labels.where(~held_out(F.col(id_col))).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    count, toxic = usable.agg(F.count("*"), F.coalesce(F.sum((F.col(label_col) == 1).cast("int")), F.lit(0))).first()
    prior = min(max(toxic / count, 0.001), 0.5) if count else 0.1
    drawn = lambda c, share: F.pmod(F.xxhash64(c, F.lit(77)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    known = usable.where((F.col(label_col) == 1) & drawn(F.col(id_col), how.positive / max(toxic, 1))).select(F.col(id_col).alias("id")).distinct()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out(F.col("id")) & F.col("text").isNotNull())
    total = docs.count()
    sample = read.join(F.broadcast(known.withColumn("known", F.lit(1))), "id", "left")  # about `positive` ids
    other = drawn(F.concat_ws(":", F.col("id").cast("string"), F.lit("u")), how.unlabelled / max(total, 1))
    rows = sample.select("text", F.col("known").isNotNull().alias("toxic"), F.coalesce(other, F.lit(False)).alias("other")).where("toxic or other")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sets = [np.unique(np.concatenate([np.empty(0, U), *hashed(t)])).tobytes() for t in x["text"]]
            yield pd.DataFrame({"toxic": x["toxic"], "other": x["other"], "features": sets})

    positive, unlabelled = [], []
    # written first: an iterator over the corpus itself would read one partition after the other
    scratch = Scratch(docs.sparkSession)
    drawn_rows = scratch.save(rows.mapInPandas(features, "toxic boolean, other boolean, features binary"))
    for r in drawn_rows.toLocalIterator():
        x = np.frombuffer(r["features"], U)
        if r["toxic"]:
            positive.append(x)
        if r["other"]:
            unlabelled.append(x)
    model = train(positive, unlabelled, prior, how)
    del positive, unlabelled
    scratch.drop(drawn_rows)
    return model


def score(docs: DataFrame, model: Model, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1, higher is likelier toxic) and predicted (1 from the threshold on) for every row, from its whole text.

    A null or empty text has the score of a text without features. Rows with a null
    id are not held out. Repeated rows get equal scores; other columns are not used.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = model.scores(x["text"].tolist())
            yield pd.DataFrame({id_col: x["id"], "held_out": x["held_out"], "score": s, "predicted": (s >= how.threshold).astype(np.int32)})

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return read.mapInPandas(work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, how: Fit = Fit(), text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores the threshold or more; all columns as they are."""

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.tolist()) >= how.threshold)

    return docs.where(~toxic(F.col(text_col)))
