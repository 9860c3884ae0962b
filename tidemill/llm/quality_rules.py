"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be
trusted, and the posterior probability of quality decides.

Rules belong to families of defects (noise, shape, shouting, repetition). Junk of one kind tells nothing of another, so each
family has a latent defect of its own with its own expectation-maximisation, and a document's quality is the product of
its families' probabilities of no defect. Abstentions are no evidence. Rules of a family whose bad votes fall on nearly
the same documents share one rule's weight. Estimates are anchored: a prior belief (``ANCHOR``) that weighs
``TRUST`` of every estimate settles what votes leave open, as they do in a family of one rule; and a bad vote is at
least as likely with the defect as without it (a rule that comes out worse is pooled, and then tells nothing).

Plan: one Arrow pass computes a few counts per text; a partial aggregation counts vote patterns (at most ``3 ** rules``
rows, whatever the input's size); the model is fitted on those pattern counts, which hold all documents; the posterior
is evaluated by Spark. Nothing is shuffled but pattern counts. ``keep_good`` reads the texts once: rows and counts are
a written table, of which the fit reads the counts only.

Defined results: null text counts as empty; an empty text has zero words and fails the base rule; repeated rows and
ties get the same verdict; an empty table gives no rows; a very long text is a block of its own, of which the
words of one slice are held, and 128-bit digests of its windows and lines, with equal counts; extra columns pass through
``keep_good`` whatever their names, and in ``assess`` take no part.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import word_slices as slicing
from ._common import append_columns, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_twins", "n_symbol_words")
#: Lines of a very long text that are held at once.
_HELD_LINES = 1 << 14
_SYMBOL_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r#*$%&|<>]*[#*$%&|<>][^ \t\n\x0b\x0c\r]*")


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _lines_by_slices(data: bytes) -> tuple[int, int]:
    """As ``_lines``, by 128-bit digests of lines."""
    found = [np.zeros((0, 2), dtype="<u8")]
    lines = (x.removesuffix(b"\n") for x in io.BytesIO(data) if x.strip())
    while part := list(islice(lines, _HELD_LINES)):
        found.append(slicing.digests(part))
    rows = np.concatenate(found)
    again = rows[slicing.repeats(rows)]
    return len(rows), len(again) - len(np.unique(again, axis=0))


def _repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    repeats, last = 0, -1
    for i, window in enumerate(windows):
        if counts[window] > 1:
            repeats += i + 3 - max(i, last)
            last = i + 3
    return repeats


def _repeated_words_by_slices(data: bytes) -> int:
    """As ``_repeated_words``, by 128-bit digests of windows."""
    at = np.flatnonzero(slicing.repeats(np.concatenate([slicing.digests(w) for w in slicing.windows(slicing.word_slices(data), 3)])))
    return 3 + int(np.minimum(np.diff(at), 3).sum()) if len(at) else 0


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of :data:`COUNTS` for one whole text. Words are runs without ASCII white space; ``n_upper`` counts
    A-Z, ``n_bangs`` words that end in ``!!``, ``n_twins`` words equal to the word before and ``n_symbol_words`` words
    with a symbol."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    shouted = b"!!" in data
    n = bangs = twins = 0
    words: list[bytes] = []
    before = None
    for words in slicing.word_slices(data):
        n += len(words)
        bangs += sum(1 for w in words if w.endswith(b"!!")) if shouted else 0
        twins += sum(map(bytes.__eq__, words, words[1:])) + (words[:1] == [before])
        before = words[-1] if words else before
    short = len(data) <= slicing.SLICE_BYTES
    lines, dup_lines = (_lines if short else _lines_by_slices)(data)
    return (
        n,
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        symbols,
        dup_lines,
        (_repeated_words(words) if short else _repeated_words_by_slices(data)) if n >= 4 else 0,
        lines,
        len(data) - len(data.translate(None, UPPER)),
        bangs,
        twins,
        sum(1 for _ in _SYMBOL_WORD.finditer(data)) if symbols else 0,
    )


def _arrays(texts: list) -> list[pa.Array]:
    table = np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(len(texts), len(COUNTS))
    return [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS))]


def with_counts(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    return append_columns(df, text, [T.StructField(c, T.LongType()) for c in COUNTS], _arrays, drop)


@dataclass(frozen=True)
class Rule:
    """Votes bad at or above ``bad``, good at or below ``good``, and abstains between, on ``value`` (SQL over counts).
    ``family``: the kind of defect that it looks for."""

    name: str
    value: str
    good: float
    bad: float
    family: str


RULES = (
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", 0.05, 0.15, "noise"),
    Rule("symbol_words", "n_symbol_words / greatest(n_words, 1)", 0.02, 0.1, "noise"),
    Rule("word_length", "abs(word_chars / greatest(n_words, 1) - 6)", 4, 9, "shape"),
    Rule("upper_share", "n_upper / greatest(word_chars, 1)", 0.08, 0.2, "shouting"),
    Rule("shouted_words", "n_bangs / greatest(n_words, 1)", 0.02, 0.1, "shouting"),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.1, 0.5, "repetition"),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.1, 0.4, "repetition"),
    Rule("twin_words", "n_twins / greatest(n_words, 1)", 0.05, 0.2, "repetition"),
)
#: Rules of a family whose bad votes overlap by this much (Jaccard) repeat each other.
TWINS = 0.8
#: Before any votes: P(bad vote | defect) and P(bad vote | none), and the weight of this belief in every estimate.
ANCHOR, TRUST = (0.8, 0.01), 0.2


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains. Texts without words get no votes."""
    out = []
    for r in rules:
        v = F.expr(f"CAST({r.value} AS DOUBLE)")
        vote = F.when(F.col("n_words") == 0, 0).when(v >= r.bad, -1).when(v <= r.good, 1).otherwise(0)
        out.append(vote.cast("int").alias(f"vote_{r.name}"))
    return out


@dataclass(frozen=True)
class FamilyModel:
    """``sound``: share of documents without the defect. Of each rule (by its place in the list): P(bad vote | defect),
    P(bad vote | none), both of documents on which it votes, and its weight."""

    sound: float
    rules: tuple[int, ...]
    bad: tuple[float, ...]
    good: tuple[float, ...]
    weight: tuple[float, ...]

    def ratios(self) -> list[tuple[int, float, float]]:
        """(rule, what its bad vote adds to the log-odds of no defect, what its good vote adds)."""
        rows = zip(self.rules, self.bad, self.good, self.weight)
        return [(i, w * math.log(g / b), w * math.log((1 - g) / (1 - b))) for i, b, g, w in rows]

    def probability(self, vote: np.ndarray) -> np.ndarray:
        """P(no defect) of patterns."""
        z = np.full(len(vote), math.log(self.sound / (1 - self.sound)))
        for i, bad, good in self.ratios():
            z += np.where(vote[:, i] < 0, bad, np.where(vote[:, i] > 0, good, 0.0))
        return 1 / (1 + np.exp(np.clip(-z, -500, 500)))


@dataclass(frozen=True)
class VoteModel:
    families: tuple[FamilyModel, ...]

    def probability(self, vote: np.ndarray) -> np.ndarray:
        out = np.ones(len(vote))
        for f in self.families:
            out *= f.probability(vote)
        return out

    def quality(self, rules: tuple[Rule, ...] = RULES) -> Column:
        out = F.lit(1.0)
        for f in self.families:
            z = F.lit(math.log(f.sound / (1 - f.sound)))
            for i, bad, good in f.ratios():
                v = F.col(f"vote_{rules[i].name}")
                z = z + F.when(v < 0, bad).when(v > 0, good).otherwise(0.0)
            out = out * (1 / (1 + F.exp(-z)))
        return out


def twin_weights(vote: np.ndarray, counts: np.ndarray, least: float = TWINS) -> np.ndarray:
    """One over the number of rules, itself included, whose bad votes are nearly those of each rule."""
    bad = (vote < 0).astype(float)
    both = (bad * counts[:, None]).T @ bad
    own = np.diag(both)
    either = own[:, None] + own[None, :] - both
    same = np.where(either > 0, both / np.maximum(either, 1e-300), 0.0) >= least
    np.fill_diagonal(same, True)
    return 1 / same.sum(axis=1)


def fit_family(vote: np.ndarray, counts: np.ndarray, places: tuple[int, ...], rounds: int = 2000) -> FamilyModel:
    """Expectation-maximisation of one family: ``vote`` has a row for each pattern and a column for each of its rules.
    It starts from "no defect unless a rule objects"."""
    k = vote.shape[1]
    said_bad, said_good = (vote < 0).astype(float), (vote > 0).astype(float)
    weight = twin_weights(vote, counts)
    sound = np.where((vote < 0).any(axis=1), 0.1, 0.9)
    model = FamilyModel(0.9, places, (ANCHOR[0],) * k, (ANCHOR[1],) * k, tuple(map(float, weight)))
    for _ in range(rounds if counts.sum() else 0):
        votes_of = [(w @ said_bad, w @ (said_bad + said_good)) for w in ((1 - sound) * counts, sound * counts)]
        bad, good = ((1 - TRUST) * (n + a) / (of + 1) + TRUST * a for (n, of), a in zip(votes_of, ANCHOR))
        worse = bad < good  # than chance: pooled
        pooled = (votes_of[0][0] + votes_of[1][0] + 0.5) / (votes_of[0][1] + votes_of[1][1] + 1)
        bad, good = np.where(worse, pooled, bad), np.where(worse, pooled, good)
        share = float((sound @ counts + 1) / (counts.sum() + 2))
        model = FamilyModel(share, places, tuple(map(float, bad)), tuple(map(float, good)), model.weight)
        local = FamilyModel(share, tuple(range(k)), model.bad, model.good, model.weight)
        new = local.probability(vote)
        moved, sound = np.abs(new - sound).max(), new
        if moved < 1e-9:
            break
    return model


def fit(patterns: np.ndarray, counts: np.ndarray, rules: tuple[Rule, ...] = RULES, rounds: int = 2000) -> VoteModel:
    """The model of vote patterns (rows of -1, 0, 1, a column for each rule) with their counts."""
    out = []
    for family in dict.fromkeys(r.family for r in rules):
        places = tuple(i for i, r in enumerate(rules) if r.family == family)
        own = np.asarray(patterns, dtype=int).reshape(len(counts), len(rules))[:, list(places)]
        seen, back = np.unique(own, axis=0, return_inverse=True)
        summed = np.bincount(back.reshape(-1), weights=counts, minlength=len(seen)) if len(seen) else np.zeros(0)
        out.append(fit_family(seen, summed, places, rounds))
    return VoteModel(tuple(out))


def fit_votes(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """The model of all rows of ``counted`` (with :data:`COUNTS`); the driver gets one row per vote pattern."""
    names = [f"vote_{r.name}" for r in rules]
    rows = counted.where("n_words > 0").select(*votes(rules)).groupBy(*names).agg(F.count("*").alias("_n")).collect()
    rows.sort(key=lambda r: tuple(r[:-1]))
    return fit(np.array([r[:-1] for r in rows], dtype=int).reshape(len(rows), len(names)), np.array([r[-1] for r in rows], dtype=float), rules)


def judged(counted: DataFrame, model: VoteModel, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``counted`` with votes, ``quality`` (posterior), ``base_failed`` and ``kept``; columns of those names go."""
    out = counted.drop(*[f"vote_{r.name}" for r in rules]).select("*", *votes(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"quality": model.quality(rules), "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )


def assess(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: its id, counts, votes, posterior and verdict."""
    counted = written(with_counts(df.select(id_col, text), text, drop=(text,)), "quality-counts")
    return judged(counted, fit_votes(counted))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with its columns as they were."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    counted = written(with_counts(plain, f"_{names.index(text)}"), "quality-rows")
    kept = judged(counted, fit_votes(counted)).where("kept")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return assess(documents(spark, sf_dir)).select(*columns)
