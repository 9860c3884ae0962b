"""Secret scans by a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query (:mod:`.trigram_query`). The index is sharded: every
block of texts gets posting lists of its own (trigram to row numbers), in which the query's postings are intersected
and united; only candidate rows are verified by the expression itself. Rules without mandatory trigrams, such as a run
of hex digits, scan all rows. Posting lists hold the trigrams that some rule asks for, of whole texts. There is no
shuffle, and no state beyond one block.

Defined results: null text counts as empty and has no spans; very long texts form blocks of their own, indexed a slice
at a time; repeated rows give repeated results; an empty table gives no rows; extra columns pass through, and those with the names of computed
columns are replaced. Spans are code points, end exclusive, sorted by start, then by the rule's place in the list.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns
from .trigram_query import Query, trigram_query, trigrams_of
from .word_slices import SLICE_BYTES


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern`` count if ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False
    any_case: bool = False
    query: Query = field(default=None, compare=False)


#: The three base kinds come first; the others are public token formats.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |)PRIVATE KEY-----"),
)


class TrigramShard:
    """Posting lists of one block of texts, for the trigrams in ``slots``."""

    def __init__(self, data: list[bytes], table: np.ndarray, slots: dict[bytes, int]):
        self.rows = len(data)
        self.slots = slots
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        ends = np.cumsum(sizes + 2)  # two zero bytes part the texts: no rule asks for a trigram with them
        codes = np.frombuffer(b"\0\0".join(data) + b"\0\0", dtype=np.uint8)
        found = [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(codes) - 2, SLICE_BYTES):
            part = codes[at : at + SLICE_BYTES + 2]
            grams = part[:-2].astype(np.uint32)
            grams <<= 8
            grams |= part[1:-1]
            grams <<= 8
            grams |= part[2:]
            slot = table[grams]
            hit = np.flatnonzero(slot)
            owner = np.searchsorted(ends, hit + at, side="right")
            found.append(np.unique(slot[hit].astype(np.int64) * max(1, self.rows) + owner))
        pairs = np.unique(np.concatenate(found))
        gram, row = np.divmod(pairs, max(1, self.rows))
        cuts = np.searchsorted(gram, np.arange(1, len(slots) + 2))
        self.postings = [row[cuts[i] : cuts[i + 1]] for i in range(len(slots))]

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[self.slots[query]]
        kind, parts = query
        found = [self.candidates(p) for p in parts]
        if kind == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


class Scanner:
    """Compiled rules with their queries; one per Python worker."""

    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        grams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.slots = {g: i for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, dtype=np.uint8 if len(grams) < 255 else np.uint16)
        for g, i in self.slots.items():
            self.table[int.from_bytes(g, "big")] = i + 1

    def verify(self, k: int, text: str) -> list[tuple[int, int]]:
        rule = self.rules[k]
        return [m.span() for m in self.compiled[k].finditer(text) if len(m[rule.group]) >= rule.least]

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, rule's place, end) of each text's spans, sorted."""
        whole = [t or "" for t in texts]
        shard = TrigramShard([t.encode("utf-8", "surrogatepass").lower() for t in whole], self.table, self.slots)
        out: list[list[tuple[int, int, int]]] = [[] for _ in whole]
        for k, query in enumerate(self.queries):
            for row in shard.candidates(query).tolist():
                out[row] += [(start, k, end) for start, end in self.verify(k, whole[row])]
        for spans in out:
            spans.sort()
        return out


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners.clear()
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``secrets``, an array of (kind, start, end)."""

    def compute(texts: list) -> list[pa.Array]:
        found = scanner(rules).scan(texts)
        return [pa.array([[{"kind": rules[k].name, "start": a, "end": b} for a, k, b in spans] for spans in found], _ARROW_SPANS)]

    return append_columns(df, text, [T.StructField("secrets", T.ArrayType(SPAN))], compute, drop)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    if not spans:
        return text
    out, last, reach = [], 0, -1
    for start, _, end in spans:
        if start >= reach:
            out += [text[last if reach < 0 else reach : start], mark]
            last = start
        reach = max(reach, end)
    return "".join([*out, text[reach:]])


def redact(df: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``df``, its columns in their order, with secrets in ``text`` replaced; null stays null."""

    def compute(texts: list) -> list[pa.Array]:
        found = scanner(rules).scan(texts)
        return [pa.array([redacted(t, s, mark) for t, s in zip(texts, found)], pa.string())]

    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])  # no column of df has the name of the new one
    body = f"_{names.index(text)}"
    clean = append_columns(plain, body, [T.StructField("clean", T.StringType())], compute, drop=(body,))
    return clean.select(*[F.col("clean" if c == text else f"_{i}").alias(c) for i, c in enumerate(names)])


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.name for r in rules if r.base]
    spans = F.col("secrets")
    return found.select(
        id_col,
        *map(of_kind, base),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    return digest(scan(documents(spark, sf_dir).select("doc_id", "text"), drop=("text",)))


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
