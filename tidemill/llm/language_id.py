"""Language identification by multilingual mixture inference.

A text is a bag of n-grams (three bytes of the text, folded to lower case, hashed to 16 bits). Each language is a
distribution over n-grams, counted over all training documents: every Arrow block adds up its counts by language, and
Spark sums them (at most languages x 65,536 rows, whatever the input's size). A text's language proportions are those
that maximise its likelihood under a mixture of the languages, by expectation-maximisation. The set of languages is
chosen by penalised likelihood: sets grow by the next language in the order of the proportions, and one more has to
gain more than ``PENALTY`` plus half the logarithm of the n-gram count. The likelihood is concave in the proportions, so
its slope at the likeliest single language bounds what any mixture can gain; texts for which that is too little are
settled without a search. The prediction is the set's largest language, and its proportion is the score.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts
first; null languages teach nothing; without any training text and in an empty table of it all are ``und``; an empty
table gives no rows; very long texts are counted in slices; the model takes 256 KB a language; repeated rows give repeated results; extra columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, blocks, id_text

BITS = 16
#: What a further language has to gain in log-likelihood, besides half the logarithm of the number of n-grams.
PENALTY = 20.0
ROUNDS = 12
#: Most bytes of texts whose n-grams are listed at once, and most n-grams times languages of an inference.
SLICE_BYTES, CELLS = 1 << 22, 1 << 23
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")  # and such numerals as ½ or Ⅷ, which are no letters


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def n_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed n-grams, the text each belongs to) of all texts, a slice at a time. Texts are edged by a blank."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
        for at in range(0, max(1, len(data) - 2), SLICE_BYTES):
            part = data[at : at + SLICE_BYTES + 2]  # an n-gram is in the slice that it begins in
            if held and size + len(part) > SLICE_BYTES:
                yield _listed(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield _listed(held)


def _listed(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(d for _, d in parts), dtype=np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    grams = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    part = np.repeat(np.arange(len(parts), dtype=np.int32), [len(d) for _, d in parts])
    inside = part[2:] == part[:-2]
    return grams[inside], np.array([i for i, _ in parts], dtype=np.int64)[part[:-2][inside]]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, how often), sorted by text and n-gram."""
    found = [np.unique((owner << BITS) | grams, return_counts=True) for grams, owner in n_grams(texts)]
    pairs, counts = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(found) > 1:
        pairs, back = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([c for _, c in found]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1), counts.astype(np.float64)


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])


def count_n_grams(text: str, lang: str):
    """A pass that sums n-grams by the column ``lang``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches, text):
            langs = np.array(block.column(lang).to_pylist(), dtype=object)
            texts = np.array([t or "" for t in block.column(text).to_pylist()], dtype=object)
            for name in {x for x in langs if x is not None}:
                for grams, _ in n_grams(texts[langs == name].tolist()):
                    sums[name] = sums.get(name, 0) + np.bincount(grams, minlength=1 << BITS)
            if len(sums) > 64:  # bounded memory, however many languages there are
                yield from out(sums)
                sums = {}
        yield from out(sums)

    def out(sums):
        for name, n in sorted(sums.items()):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=COUNTS.names)

    return run


@dataclass(frozen=True)
class LanguageModel:
    """``logp[gram, language]`` of the sorted ``languages``."""

    languages: tuple[str, ...]
    logp: np.ndarray


def train(df: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """Counts n-grams of all rows of ``df`` with a language. The driver gets languages x 65,536 sums at most."""
    counts = df.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(count_n_grams(text, lang), COUNTS)
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("lang").to_numpy(zero_copy_only=False)
    languages = tuple(sorted(set(names)))
    table = np.full((1 << BITS, len(languages)), smooth)
    if len(languages):
        place = np.searchsorted(np.array(languages, dtype=object), names)
        table[rows.column("gram").to_numpy(), place] += rows.column("n").to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _mixture(p: np.ndarray, n: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of texts whose n-grams (rows of ``p``, by language, ``n`` times) begin at
    ``first``; ``share``: proportions to begin with, where zero stays zero."""
    total = np.add.reduceat(n, first)[:, None]
    for _ in range(rounds):
        part = p * share[doc]
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total
    mixed = (p * share[doc]).sum(axis=1)
    return share, np.add.reduceat(n * np.log(np.maximum(mixed, 1e-300)), first)


def _of(chosen: np.ndarray, p: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of the ``chosen`` texts, which are numbered anew: their rows, counts, texts, and where each begins."""
    inside = chosen[doc]
    d = (np.cumsum(chosen) - 1)[doc[inside]]
    return p[inside], n[inside], d, np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)


def infer(model: LanguageModel, texts: list[str | None], rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """(largest language, its proportion, proportions of the chosen set) of each text."""
    k = len(model.languages)
    out = [UNDETERMINED] * len(texts)
    score = np.zeros(len(texts))
    shares: list[dict[str, float]] = [{} for _ in texts]
    if len(texts) > 1 and k * sum(min(len(t or ""), 1 << BITS) for t in texts) > CELLS:
        half = len(texts) // 2
        parts = [infer(model, some, rounds, penalty) for some in (texts[:half], texts[half:])]
        return parts[0][0] + parts[1][0], np.concatenate([p[1] for p in parts]), parts[0][2] + parts[1][2]
    own = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if not own or not k:
        return out, score, shares
    doc, gram, n = gram_counts([texts[i] for i in own])
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    logp = model.logp[gram].astype(np.float64)
    alone = np.add.reduceat(logp * n[:, None], first, axis=0)  # text, language
    best = alone.argmax(axis=1)
    rows = np.arange(len(own))
    top = alone[rows, best]
    proportion = np.zeros((len(own), k))
    proportion[rows, best] = 1
    size = np.add.reduceat(n, first)
    gain = penalty + 0.5 * np.log(size)
    if k > 1:
        likeliest = logp.max(axis=1, keepdims=True)
        base = np.add.reduceat(likeliest[:, 0] * n, first)
        p = np.exp(logp - likeliest)
        # what a mixture can gain at most: by each n-gram's likeliest language, and by the slope at the best one
        slope = np.add.reduceat(p * (n / p[np.arange(len(doc)), best[doc]])[:, None], first, axis=0).max(axis=1) - size
        live = np.minimum(base - top, slope) > gain
        at = np.flatnonzero(live)
        if len(at):
            p, n, d, f = _of(live, p, n, doc)
            every, _ = _mixture(p, n, f, d, np.full((len(at), k), 1 / k), rounds)
            place = np.argsort(np.argsort(-every, axis=1, kind="stable"), axis=1, kind="stable")
        for number in range(2, k + 1):
            if not len(at):
                break
            share, like = _mixture(p, n, f, d, np.where(place < number, 1 / number, 0.0), rounds)
            like = like + base[at]
            won = like - top[at] > gain[at]
            proportion[at[won]] = share[won]
            top[at[won]] = like[won]
            at, place = at[won], place[won]
            p, n, d, f = _of(won, p, n, d)
    leader = proportion.argmax(axis=1)
    for j, i in enumerate(own):
        out[i] = model.languages[leader[j]]
        score[i] = min(1.0, proportion[j, leader[j]])
        shares[i] = {model.languages[x]: float(proportion[j, x]) for x in np.flatnonzero(proportion[j])}
    return out, score, shares


def predict(df: DataFrame, model: LanguageModel, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``languages`` (proportions of the chosen set). The model, which is
    bounded, travels as a broadcast variable."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list) -> list[pa.Array]:
        lang, score, shares = infer(held.value, texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))]
    return append_columns(df, text, fields, compute, drop)


def held_out(column: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    return F.crc32(id_text(column)) % folds == fold


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model, drop=("text",))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
