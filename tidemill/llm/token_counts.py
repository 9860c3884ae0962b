"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Texts are cut where a pre-token must begin (a space before a non-space), so that each distinct cut is split into
pre-tokens once. The distinct pre-tokens of a block that are new to the worker form one ragged array: concatenated byte
symbols and offsets. In each round every sequence applies its lowest-rank pair, at all its places from the left, at
the same time as all others; what survives is counted. Counts are kept by cut text in a table of bounded size, which
only saves work: a full one is emptied.

Defined results: null text counts as empty (0 bytes, 0 tokens); very long texts form blocks of their own; a special
string inside a text is one token, as by the library's default; repeated rows give repeated results; an empty table
gives no rows; extra columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns

#: Distinct cut texts that a Python worker keeps counts of.
KEPT = 600_000
#: Most pre-token bytes that are merged as one ragged array.
MERGE_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if it is one, else from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class RankMerger:
    """Merge rules of a ``tokenizers`` file as sorted arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        self.size = max(vocab.values()) + 1
        self.byte = np.zeros(256, dtype=np.int64)
        for ch, b in alphabet.items():
            self.byte[b] = vocab[ch]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = np.append(order, NONE).astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special_rx = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        import regex

        self.pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        return np.where(hit, self.rank[np.where(hit, at, -1)], NONE)

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Number of symbols left of each non-empty sequence when no rule applies any more."""
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        counts = sizes.copy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbol = self.byte[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        rank = np.full(len(symbol), NONE)  # of the pair that begins at a symbol
        if len(symbol) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.ranks(symbol[:-1][same], symbol[1:][same])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            live = low < NONE
            if not live.all():  # sequences without a pair that merges are done
                counts[owner[starts[~live]]] = lengths[~live]
                keep = np.repeat(live, lengths)
                owner, symbol, rank = owner[keep], symbol[keep], rank[keep]
                low, lengths = low[live], lengths[live]
                if not len(symbol):
                    break
            hit = rank == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            if len(at) > 1:  # of pairs that overlap (a a a), every second one from the left
                run = np.r_[True, np.diff(at) != 1]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            owner, symbol, rank = owner[keep], symbol[keep], rank[keep]
            for left in (moved, moved[moved > 0] - 1):
                inside = left + 1 < len(symbol)
                rank[left[~inside]] = NONE
                left = left[inside]
                same = owner[left] == owner[left + 1]
                rank[left[~same]] = NONE
                left = left[same]
                rank[left] = self.ranks(symbol[left], symbol[left + 1])
        return counts

    def _learn(self, cuts: list[str]) -> None:
        """Counts of new cut texts. Letters after at most one space are one pre-token."""
        whole, mixed = [], []
        for c in cuts:
            (whole if (c[1:] if c[:1] == " " else c).isalpha() else mixed).append(c)
        split = [self.pre.findall(c) for c in mixed]
        words = set(whole).union(*split)
        words.difference_update(self.words)
        new = list(words)
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        start = 0
        while start < len(new):
            stop, size = start, 0
            while stop < len(new) and (stop == start or size + len(data[stop]) <= MERGE_BYTES):
                size += len(data[stop])
                stop += 1
            self.words.update(zip(new[start:stop], self.surviving(data[start:stop]).tolist()))
            start = stop
        count = self.words.__getitem__
        self.known.update(zip(whole, map(count, whole)))
        self.known.update(zip(mixed, [sum(map(count, w)) for w in split]))

    def _cuts(self, text: str) -> list[str]:
        if _ODD(text):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > KEPT or len(self.words) > KEPT:
            self.known, self.words = {}, {}
        parts: list[list[str]] = []
        extra: list[int] = []
        for text in texts:
            text = text or ""
            if self.special_rx and any(s in text for s in self.special):
                pieces = self.special_rx.split(text)
                parts.append([c for p in pieces for c in self._cuts(p)])
                extra.append(len(pieces) - 1)
            else:
                parts.append(self._cuts(text))
                extra.append(0)
        new = set().union(*parts)
        new.difference_update(self.known)
        self._learn(list(new))
        known = self.known.__getitem__
        return [e + sum(map(known, cuts)) for cuts, e in zip(parts, extra)]


NONE = np.iinfo(np.int64).max
_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r" \s| $").search
_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers.clear()
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``n_bytes`` and ``n_tokens`` (long) of whole texts. ``path``: the vocabulary file, on every node."""

    def compute(texts: list) -> list[pa.Array]:
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        gc.disable()  # many lists of strings, no cycles
        try:
            counts = merger(path).counts(texts)
        finally:
            gc.enable()
        return [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return append_columns(df, text, fields, compute, drop)


def query(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    from ._common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), drop=("text",))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
