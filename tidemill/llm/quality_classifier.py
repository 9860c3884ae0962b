"""Quality classifier by positive-unlabelled learning.

A text is described by eight rates of its words and by the mean log-likelihood ratio of its n-grams (three bytes, hashed
to 16 bits) between trusted positives and all documents. Each of these numbers is cut into four bins at the 1, 50 and 99
per cent points of the trusted positives, so no bound is set by hand, and there are at most 262,144 different
descriptions. The unlabelled distribution is a count of descriptions over all documents, the positive one a count over
trusted positives; both are sums that Spark makes, bounded in size. On them a logistic model over the bins is
fitted by minimising the non-negative unbiased risk (Kiryo et al., 2017):

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the loss log(1 + exp(-z)). Where the second part falls below zero, its gradient is reversed. The class prior is
estimated as the least ratio of the unlabelled to the positive distribution over sets of bins that hold enough
positives: there, unlabelled texts are hardly anything but positives. It is kept within ``PRIOR`` of 0 and 1.

Trusted positives are ``LABELLED_ROWS`` labelled documents at most, those with the least hashes of their ids. One half,
by a hash, gives the n-gram model, the other bins and positives, which so are as strange to it as other texts. All
documents are unlabelled ones. Texts are read twice: for n-gram sums, and for descriptions.

Defined results: null text counts as empty; empty texts get the score of their description; a document labelled more
than once is a trusted positive only if all its labels say so; without positives the prior is 0.5 and so are all
scores; repeated rows give repeated results; an empty table gives no rows; a very long text is a block of its own, its
words and n-grams are counted in slices; extra columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, id_text, small, written
from .language_id import BITS, COUNTS, count_n_grams, gram_counts
from .quality_rules import text_counts

RATES = ("symbols_per_word", "upper_share", "shouted_words", "repeated_lines", "repeated_words", "twin_words", "word_length", "words", "n_gram_ratio")
BINS = 4
#: Points of the trusted positives' distribution that part the bins; most trusted positives; least distance of the
#: estimated class prior to 0 and 1.
POINTS, LABELLED_ROWS, PRIOR = (0.01, 0.5, 0.99), 50_000, 0.001


def rates(text: str | None) -> tuple[float, ...]:
    n, chars, symbols, dup, repeats, lines, upper, bangs, twins = text_counts(text)[:9]
    w = max(n, 1)
    return (symbols / w, upper / max(chars, 1), bangs / w, dup / max(lines, 1), repeats / w, twins / w, chars / w, n)


def ratios(texts: list[str], grams: np.ndarray) -> np.ndarray:
    """The mean of ``grams`` (a log-ratio for each hashed n-gram) over each text's n-grams; 0 without any."""
    doc, gram, n = gram_counts(texts)
    total = np.bincount(doc, weights=n, minlength=len(texts))
    return np.bincount(doc, weights=n * grams[gram], minlength=len(texts)) / np.maximum(total, 1)


def n_gram_ratios(docs: DataFrame, text: str = "text", trusted: str = "trusted", smooth: float = 0.5) -> np.ndarray:
    """log P(n-gram | trusted positive) - log P(n-gram), by sums over all ``docs``; ``trusted`` is 0 for the positives that
    are to be learned from."""
    kind = F.when(F.col(trusted) == 0, "trusted").otherwise("rest")
    rows = docs.select(F.col(text).alias("text"), kind.alias("lang")).mapInArrow(count_n_grams("text", "lang"), COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((2, 1 << BITS))
    np.add.at(sums, ((rows.column("lang").to_numpy(zero_copy_only=False) == "trusted").astype(int), rows.column("gram").to_numpy()), rows.column("n").to_numpy())
    if not sums[1].any():
        return np.zeros(1 << BITS)
    pos, every = sums[1] + smooth, sums.sum(axis=0) + smooth
    return np.log(pos / pos.sum()) - np.log(every / every.sum())


def columns() -> list[str]:
    return [f"rate_{r}" for r in RATES]


def with_description(df: DataFrame, text: str = "text", drop: tuple[str, ...] = (), grams: np.ndarray | None = None) -> DataFrame:
    """``df`` with a column for each of :data:`RATES`; without ``grams`` the n-gram ratio is 0."""
    held = df.sparkSession.sparkContext.broadcast(grams)

    def compute(texts: list) -> list[pa.Array]:
        table = np.zeros((len(texts), len(RATES)))
        for i, t in enumerate(texts):
            table[i, :-1] = rates(t)
        if held.value is not None:
            table[:, -1] = ratios([t or "" for t in texts], held.value)
        return [pa.array(np.ascontiguousarray(c)) for c in table.T]

    return append_columns(df, text, [T.StructField(c, T.DoubleType()) for c in columns()], compute, drop)


def _digits(cells: np.ndarray) -> np.ndarray:
    powers = BINS ** np.arange(len(RATES) - 1, -1, -1)
    return cells[:, None] // powers % BINS


def design(cells: np.ndarray) -> np.ndarray:
    """Bins as indicator columns, and a constant."""
    digits = _digits(cells)
    hot = np.zeros((len(cells), len(RATES) * BINS + 1))
    hot[:, -1] = 1
    for i in range(len(RATES)):
        hot[np.arange(len(cells)), i * BINS + digits[:, i]] = 1
    return hot


def risk(w: np.ndarray, x: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(what positives lose, what unlabelled ones lose beyond positives, the direction to descend) at weights ``w``, of
    descriptions ``x`` with the positive and unlabelled distributions ``p`` and ``u``."""
    f = x @ w
    s = 1 / (1 + np.exp(-f))
    as_pos = x.T @ (p * (s - 1))
    as_neg = x.T @ (u * s) - prior * (x.T @ (p * s))
    positive = prior * float(p @ np.logaddexp(0, -f))
    negative = float(u @ np.logaddexp(0, f) - prior * (p @ np.logaddexp(0, f)))
    return positive, negative, prior * as_pos + as_neg if negative >= 0 else -as_neg


def class_prior(pos: np.ndarray, unl: np.ndarray, cells: np.ndarray, share: float = 0.2) -> float:
    """The least ratio of unlabelled to positive mass, over bins of one rate or two that hold ``share`` of the positives
    or more, each with one standard error, so that few positives do not make it small by chance."""
    if not pos.sum() or not unl.sum():
        return 0.5
    p, u = pos / pos.sum(), unl / unl.sum()
    one = design(cells)[:, :-1]
    own, every = one.T @ (one * p[:, None]), one.T @ (one * u[:, None])  # by pairs of bins; the diagonal is single ones
    held = own >= share
    if not held.any():
        return 0.5
    least = every[held] / own[held] * (1 + np.sqrt((1 - own[held]).clip(0) / (own[held] * pos.sum())))
    return float(np.clip(least.min(), PRIOR, 1 - PRIOR))


@dataclass(frozen=True)
class QualityModel:
    """``bounds``: of each rate, the points that part its bins."""

    weights: tuple[float, ...]
    prior: float
    bounds: tuple[tuple[float, ...], ...] = ((0.0,) * len(POINTS),) * len(RATES)

    def score(self, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(cells) @ np.array(self.weights), -30, 30)))


def fit(cells: np.ndarray, pos: np.ndarray, unl: np.ndarray, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> QualityModel:
    """Minimises the non-negative risk over descriptions ``cells`` with their counts, by Adam on the full sums."""
    prior = class_prior(pos, unl, cells)
    x = design(cells)
    w = np.zeros(x.shape[1])
    if not pos.sum() or not unl.sum():
        return QualityModel(tuple(w), prior)
    p, u = pos / pos.sum(), unl / unl.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = risk(w, x, p, u, prior)[2] + decay * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return QualityModel(tuple(map(float, w)), prior)


def held_out(column: str = "doc_id", fold: int = 1, folds: int = 3) -> Column:
    return F.crc32(id_text(column)) % folds == fold


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = LABELLED_ROWS) -> DataFrame:
    """The ids of trusted positives, and ``trusted``: 0 for those of the n-gram model, 1 for the others."""
    good = labels.where("quality is not null").groupBy(id_col).agg(F.min("quality").alias("least")).where("least = 1")
    return good.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(most).withColumn("trusted", F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)).cast("int"))


def _cell(bounds: tuple[tuple[float, ...], ...]) -> Column:
    """The description as a number to base :data:`BINS`; a digit is the number of bounds that a rate is above."""
    out = F.lit(0)
    for name, points in zip(columns(), bounds):
        out = out * BINS + sum(((F.col(name) > b).cast("int") for b in points), F.lit(0))
    return out.cast("int").alias("cell")


def train(described: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> QualityModel:
    """``described``: ids and rates of all documents, the unlabelled ones; ``labels``: ids and ``quality`` that may be
    learned from. The driver gets one row for each description that occurs, 262,144 at most."""
    marked = described.join(small(trusted_ids(labels, id_col)), id_col, "left")
    points = marked.where("trusted = 1").agg(*[F.percentile(c, list(POINTS)).alias(c) for c in columns()]).first()
    bounds = tuple(tuple(points[c]) if points[c] else (0.0,) * len(POINTS) for c in columns())
    rows = marked.groupBy(_cell(bounds)).agg(F.count("*").alias("unl"), F.sum(F.coalesce("trusted", F.lit(0))).alias("pos")).toPandas().sort_values("cell")
    model = fit(rows["cell"].to_numpy(dtype=np.int64), rows["pos"].to_numpy(dtype=float), rows["unl"].to_numpy(dtype=float))
    return QualityModel(model.weights, model.prior, bounds)


def scored(described: DataFrame, model: QualityModel) -> DataFrame:
    """``described`` with ``score`` and ``predicted``: a bounded sum over the description's digits, by Spark."""
    f = F.lit(model.weights[-1])
    for i in range(len(RATES)):
        digit = F.floor(F.col("cell") / F.lit(BINS ** (len(RATES) - 1 - i))).cast("int") % BINS
        part = F.lit(model.weights[i * BINS + BINS - 1])
        for b in range(BINS - 1):
            part = F.when(digit == b, model.weights[i * BINS + b]).otherwise(part)
        f = f + part
    score = 1 / (1 + F.exp(-f))
    found = described.withColumn("cell", _cell(model.bounds)).withColumn("score", score)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = documents(spark, sf_dir, "labels").where(~held_out())
    trusted = written(trusted_ids(labels), "quality-trusted")
    grams = n_gram_ratios(docs.join(small(trusted), "doc_id", "left"))
    described = written(with_description(docs, drop=("text",), grams=grams), "quality-rates")
    return scored(described, train(described, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
