"""SentencePiece encoding and decoding by a max-plus scan.

A text's encoding is a path through the lattice of its pieces. The scores are those of the (max, +) semiring: a step
from one piece to the next weighs 0 if merging by score would leave the two side by side, and minus infinity if not, so
the one path of weight 0 is the encoding that byte-pair merging gives (neighbouring pieces decide: a sequence is an
encoding if and only if each two neighbours are one). A prefix has one best last piece, hence the forward pass keeps
one piece for each position, and runs for all distinct words of a block at once.

Giant texts, of more than ``GIANT`` characters, are cut into chunks of ``PART`` characters wherever that falls, rows of
their own that are dealt over tasks. A boundary's states are the pieces that cover the character before it; each
chunk yields its transfer matrix, from the states before it to those behind; a document's matrices are combined
associatively by a max-plus prefix scan, the states that the whole path takes are read off backwards, and each chunk is
then backtraced on its own, again over tasks. Within a chunk, places that no piece can straddle (before a word mark
after a letter) have one state, so words between them are encoded once. Runs of more than ``LONGEST`` characters
without such a place go through the same scan by chunks of ``CHUNK`` within their task.

Defined results: null text counts as empty and gives no pieces; very long texts are scanned by chunks; characters
outside the vocabulary become byte pieces; the word mark U+2581 inside a text reads as a blank when decoded; repeated
rows give repeated results; an empty table gives no rows; extra columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLOCK_BYTES, append_columns, blocks, written

MARK = "▁"
#: Longest run that is encoded as one piece of lattice, and the length of the chunks of longer ones.
LONGEST, CHUNK = 256, 128
#: Distinct words that a Python worker keeps encodings of, and characters whose lattice is built at once.
KEPT = 150_000
#: Longest text that is encoded within one task, and the length of the chunks of longer ones, in characters.
GIANT, PART = 1 << 16, 1 << 13
LATTICE_CHARS = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int64(1 << 40)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PieceModel:
    """A SentencePiece vocabulary of kind BPE with byte fallback and identity normalization."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a BPE vocabulary with byte fallback and identity normalization")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.size = len(self.pieces)
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.plain: dict[str, int] = {}
        self.as_text: list[str | None] = []
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_id[b] = i
                self.as_text.append(chr(b) if b < 128 else None)
            elif p.type == 1:
                self.plain[p.piece] = i
                self.as_text.append(p.piece.replace(MARK, " "))
            else:
                self.as_text.append(" ⁇ " if p.type == 2 else "")
        self.key = np.full(self.size, -1, dtype=np.int64)  # when a piece is formed; single characters are there before
        for place, i in enumerate(sorted(self.plain.values(), key=lambda i: (-spec.pieces[i].score, i))):
            if len(self.pieces[i]) > 1:
                self.key[i] = place
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        for p, i in self.plain.items():
            if len(p) > 1:
                halves = self._halves(p)
                if halves is None:
                    self.key[i] = -2  # merging never forms it
                else:
                    self.left[i], self.right[i] = halves
        formed = {p: i for p, i in self.plain.items() if self.key[i] != -2}
        pairs = {(formed[p[:c]], formed[p[c:]]): i for p, i in self.plain.items() for c in range(1, len(p)) if p[:c] in formed and p[c:] in formed}
        flat = np.array([a * self.size + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(flat)
        self.pair = flat[order]
        merged = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        places = {i: n for n, i in enumerate(sorted(self.plain.values(), key=lambda i: (-spec.pieces[i].score, i)))}
        self.pair_key = np.array([places[i] for i in merged.tolist()], dtype=np.int64)
        self.straddles = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.plain)
        self.longest = max(map(len, self.plain))
        self.tables = {}
        for length in range(1, self.longest + 1):
            own = [(p, i) for p, i in formed.items() if len(p) == length]
            if own:
                chars = np.stack([codes(p) for p, _ in own])
                hashed = self._hash(chars)
                order = np.argsort(hashed)
                self.tables[length] = (hashed[order], np.array([i for _, i in own])[order], chars[order])
        self.widths = np.array([*map(len, self.pieces), 1], dtype=np.int64)  # the last is that of all odd characters
        self.odd: dict[int, int] = {}  # places of characters outside the vocabulary, behind its ids
        self.odd_chars: list[int] = []
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    @staticmethod
    def _hash(windows: np.ndarray) -> np.ndarray:
        out = np.zeros(windows.shape[:-1], dtype=np.uint64)
        for i in range(windows.shape[-1]):
            out = (out + windows[..., i].astype(np.uint64) + np.uint64(1)) * _BASE
        return out

    def _halves(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge forms ``piece`` when it is encoded alone; None if another encoding is left."""
        parts = list(piece)
        place = self.key
        while len(parts) > 1:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                j = self.plain.get(parts[i] + parts[i + 1])
                if j is not None and place[j] >= 0 and place[j] < best:
                    best, at = place[j], i
            if at < 0:
                return None
            if len(parts) == 2:
                a, b = self.plain.get(parts[0]), self.plain.get(parts[1])
                return None if a is None or b is None else (a, b)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def _merged_key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When the merge of two pieces comes; NONE if the vocabulary has no such piece."""
        inside = (a < self.size) & (b < self.size)
        want = np.where(inside, a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.pair_key[at], NONE)

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two pieces stay side by side when their texts are merged together. The merges that formed them
        are undone from the last one back: at each time before, the pieces that met must not have had a merge that
        comes earlier (at equal times, the left one is first)."""
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NONE)
        keys = np.append(self.key, -1)
        while len(live):
            crossed = self._merged_key(a, b) < limit
            out[live[crossed]] = False
            ka, kb = keys[np.minimum(a, self.size)], keys[np.minimum(b, self.size)]
            go = ~crossed & ((ka >= 0) | (kb >= 0))
            live, a, b, ka, kb = live[go], a[go], b[go], ka[go], kb[go]
            later = ka > kb
            limit = np.where(later, ka, kb + 1)
            a, b = np.where(later, self.right[np.minimum(a, self.size - 1)], a), np.where(later, b, self.left[np.minimum(b, self.size - 1)])
        return out

    def lattice(self, text: np.ndarray, base: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, character behind, piece) of all pieces in ``text``, several runs one after another, whose
        bounds are given for each character. Characters outside the vocabulary are pieces of their own."""
        n = len(text)
        starts, ends, pieces = [], [], []
        rolling = np.zeros(n, dtype=np.uint64)
        for length in range(1, self.longest + 1):
            if n < length:
                break
            at = np.arange(n - length + 1)
            rolling = (rolling[: len(at)] + text[length - 1 :].astype(np.uint64) + np.uint64(1)) * _BASE
            at = at[at + length <= end[: len(at)]]
            if length not in self.tables:
                continue
            hashed, ids, chars = self.tables[length]
            place = np.minimum(np.searchsorted(hashed, rolling[at]), len(hashed) - 1)
            hit = hashed[place] == rolling[at]
            at, place = at[hit], place[hit]
            same = np.ones(len(at), dtype=bool)
            for i in range(length):
                same &= text[at + i] == chars[place, i]
            if length == 1:
                known = np.zeros(n, dtype=bool)
                known[at] = True
                for j in np.flatnonzero(~known):
                    c = int(text[j])
                    if c not in self.odd:
                        self.odd[c] = self.size + len(self.odd_chars)
                        self.odd_chars.append(c)
                    starts.append(np.array([j]))
                    ends.append(np.array([j + 1]))
                    pieces.append(np.array([self.odd[c]]))
            starts.append(at[same])
            ends.append(at[same] + length)
            pieces.append(ids[place[same]])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)

    def forward(self, runs: list[str], entering: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The forward pass over ``runs`` (not empty), each after the piece ``entering`` (-1: none). Returns the last
        piece of the best path to the end of each character (-1: no path), where each run begins, and the lattice."""
        sizes = np.array([len(r) for r in runs], dtype=np.int64)
        stop = np.cumsum(sizes)
        base = stop - sizes
        text = codes("".join(runs))
        owner = np.repeat(np.arange(len(runs)), sizes)
        first, behind, piece = self.lattice(text, base[owner], stop[owner])
        run = owner[first]
        step = behind - base[run]
        order = np.argsort(step, kind="stable")
        first, behind, piece, run, step = first[order], behind[order], piece[order], run[order], step[order]
        cuts = np.searchsorted(step, np.arange(1, sizes.max() + 2))
        last = np.full(len(text), -1, dtype=np.int64)
        for e in range(len(cuts) - 1):
            a, b = cuts[e], cuts[e + 1]
            begins = first[a:b] == base[run[a:b]]
            before = np.where(begins, entering[run[a:b]], last[np.maximum(first[a:b] - 1, 0)])
            free = begins & (before < 0)
            check = np.flatnonzero(before >= 0)
            wide = np.int64(self.size + len(self.odd_chars) + 1)
            pairs, back = np.unique(before[check] * wide + piece[a:b][check], return_inverse=True)
            fine = free
            if len(pairs):
                fine[check] = self.neighbours(pairs // wide, pairs % wide)[back]
            at = np.flatnonzero(fine)
            last[behind[a:b][at] - 1] = piece[a:b][at]
        return last, base, (first, behind, piece, run)

    def width(self, piece: int) -> int:
        return 1 if piece >= self.size else len(self.pieces[piece])

    def _traced(self, last: list[int], base: int, stop: int) -> list[int]:
        """The pieces of the path to ``stop``, backwards from it."""
        out = []
        while stop > base:
            piece = last[stop - 1]
            out.append(piece)
            stop -= self.width(piece)
        return out[::-1]

    def _ids(self, path: list[int]) -> np.ndarray:
        if max(path) < self.size:
            return np.array(path, dtype=np.int32)
        out: list[int] = []
        for piece in path:
            if piece < self.size:
                out.append(piece)
            else:
                out += self.byte_id[list(chr(self.odd_chars[piece - self.size]).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, dtype=np.int32)

    def _keep(self, words: list[str], last: np.ndarray, base: np.ndarray) -> None:
        """Backtraces all ``words`` of a forward pass, a piece of each at a time, and keeps their ids."""
        stop = base + np.array([len(w) for w in words], dtype=np.int64)
        taken = np.zeros(len(last), dtype=bool)
        n_pieces = np.zeros(len(words), dtype=np.int64)
        live, at = np.arange(len(words)), stop.copy()
        while len(live):
            piece = last[at - 1]
            taken[at - 1] = True
            n_pieces[live] += 1
            at = at - self.widths[np.minimum(piece, self.size)]
            go = at > base[live]
            live, at = live[go], at[go]
        path = last[taken]
        ends = np.cumsum(n_pieces)
        begins = ends - n_pieces
        odd = np.flatnonzero(np.logical_or.reduceat(path >= self.size, begins))
        data = path.astype(np.int32).tobytes()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, (begins * 4).tolist(), (ends * 4).tolist()))
        for i in odd.tolist():  # characters outside the vocabulary become bytes
            self.known[words[i]] = self._ids(path[begins[i] : ends[i]].tolist()).tobytes()

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if len(w) <= LONGEST]
        at = 0
        while at < len(plain):
            upto, chars = at, 0
            while upto < len(plain) and (upto == at or chars + len(plain[upto]) <= LATTICE_CHARS):
                chars += len(plain[upto])
                upto += 1
            part = plain[at:upto]
            last, base, _ = self.forward(part, np.full(len(part), -1, dtype=np.int64))
            self._keep(part, last, base)
            at = upto
        for w in words:
            if len(w) > LONGEST:
                self.known[w] = self._ids(self.scan(w)).tobytes()

    def scan(self, run: str, chunk: int = CHUNK) -> list[int]:
        """The path of one long run by chunks: states, transfer matrices, their max-plus scan, and backtraces."""
        n = len(run)
        cuts = [*range(0, n, chunk), n]
        if len(cuts) > 2 and n - cuts[-2] < self.longest:
            del cuts[-2]
        text = codes(run)
        first, behind, piece = self.lattice(text, np.zeros(n, dtype=np.int64), np.full(n, n, dtype=np.int64))
        # the states at a boundary: the pieces that cover the character before it, by where they end
        states: list[list[tuple[int, int]]] = [[(0, -1)]]
        for c in cuts[1:]:
            own = np.flatnonzero((first < c) & (behind >= c))
            states.append(sorted((int(behind[i]), int(piece[i])) for i in own))
        index = [{s: i for i, s in enumerate(at)} for at in states]
        matrices, passes = [], []
        for m in range(len(cuts) - 1):
            c, d = cuts[m], cuts[m + 1]
            ahead = min(n, d + self.longest - 1)
            enter = [(i, end, p) for i, (end, p) in enumerate(states[m])]
            runs = [run[end:ahead] for _, end, _ in enter if end < ahead]
            matrix = np.full((len(states[m]), len(states[m + 1])), -np.inf)
            passed: dict[int, tuple[list[int], int]] = {}
            if runs:
                rows = [(i, end) for i, end, _ in enter if end < ahead]
                last, base, _ = self.forward(runs, np.array([p for _, end, p in enter if end < ahead], dtype=np.int64))
                flat = last.tolist()
                for (i, end), b in zip(rows, base.tolist()):
                    passed[i] = (flat[b : b + ahead - end], end)
                    for (stop, p), j in index[m + 1].items():
                        if stop > end and stop <= ahead and stop - self.width(p) >= end and passed[i][0][stop - end - 1] == p:
                            matrix[i, j] = 0.0
            for i, end, p in enter:  # a piece that covers the whole chunk stays as it is
                if p >= 0 and end >= d and (end, p) in index[m + 1]:
                    matrix[i, index[m + 1][(end, p)]] = 0.0
            matrices.append(matrix)
            passes.append(passed)
        reach = _prefix_scan(matrices)
        final = [j for j, (end, _) in enumerate(states[-1]) if end == n and reach[-1][0, j] == 0]
        taken = [final[0]]
        for m in range(len(matrices) - 1, 0, -1):
            into = np.flatnonzero((reach[m - 1][0] == 0) & (matrices[m][:, taken[0]] == 0))
            taken.insert(0, int(into[0]))
        taken.insert(0, 0)
        path: list[int] = []
        for m, passed in enumerate(passes):
            end, p = states[m][taken[m]]
            stop, q = states[m + 1][taken[m + 1]]
            if (end, p) != (stop, q):
                path += self._traced(passed[taken[m]][0], 0, stop - end)
        return path

    # ------------------------------------------------------------ chunks of giant texts

    def marked(self, text: str) -> str:
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def cut(self, text: str, part: int = PART) -> list[tuple[str, str, int]]:
        """(characters before a chunk that pieces may reach back to, the chunk and characters behind it that they may
        reach to, the chunk's length), in order."""
        whole = self.marked(text)
        cuts = [*range(0, len(whole), part), len(whole)]
        if len(cuts) > 2 and len(whole) - cuts[-2] < self.longest:
            del cuts[-2]
        far = self.longest
        return [(whole[max(0, c - far) : c], whole[c : d + far], d - c) for c, d in zip(cuts, cuts[1:])]

    def _told(self, piece: int) -> int:
        """A piece's number for other workers: of a character outside the vocabulary, by its code."""
        return piece if piece < self.size else self.size + self.odd_chars[piece - self.size]

    def _own(self, told: int) -> int:
        if told < self.size:
            return told
        c = told - self.size
        if c not in self.odd:
            self.odd[c] = self.size + len(self.odd_chars)
            self.odd_chars.append(c)
        return self.odd[c]

    def states(self, before: str, behind: str) -> list[tuple[int, int]]:
        """(how far behind the boundary it ends, piece) of all pieces that cover the character before the boundary."""
        if not before:
            return [(0, -1)]
        n = len(before) + len(behind)
        first, stop, piece = self.lattice(codes(before + behind), np.zeros(n, dtype=np.int64), np.full(n, n, dtype=np.int64))
        own = np.flatnonzero((first < len(before)) & (stop >= len(before)))
        return sorted((int(stop[i]) - len(before), self._told(int(piece[i]))) for i in own)

    def _breaks(self, text: str) -> list[int]:
        """The places in ``text`` that no piece straddles."""
        if self.straddles:
            return []
        return [m.end() for m in re.finditer(f"[^{MARK}](?={MARK})", text)]

    def transfer(self, before: str, body: str, size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray, tuple]:
        """(states before a chunk, states behind it, its max-plus matrix, and what a backtrace needs)."""
        far = self.longest
        into = self.states(before, body[:far])
        whole = before[-1:] + body  # a place at the chunk's start shows only with the character before it
        breaks = [p - len(before[-1:]) for p in self._breaks(whole)]
        outof = self.states((before + body[:size])[-far:], body[size:])
        open_start = not before or 0 in breaks
        inner = [p for p in breaks if 0 < p < size]
        ahead = min([p for p in breaks if p >= size], default=len(body))
        head = inner[0] if inner else ahead  # where the runs that depend on the state before end
        entering = [(end, -1 if open_start else self._own(p)) for end, p in into]
        rows = [i for i, (end, _) in enumerate(entering) if end < head]
        last = {}
        if rows:
            flat, base, _ = self.forward([body[entering[i][0] : head] for i in rows], np.array([entering[i][1] for i in rows], dtype=np.int64))
            flat = flat.tolist()
            last = {i: flat[b : b + head - entering[i][0]] for i, b in zip(rows, base.tolist())}
        matrix = np.full((len(into), len(outof)), -np.inf)
        places = {s: j for j, s in enumerate(outof)}
        tail: list[int] = []
        if inner:
            found, _, _ = self.forward([body[inner[-1] : ahead]], np.array([-1], dtype=np.int64))
            tail = found.tolist()
        for (stop, told), j in places.items():
            stop, p = size + stop, self._own(told) if told >= 0 else -1
            for i, (end, _) in enumerate(entering):
                if inner:  # into the first place, then on from the last
                    reached = end == head or end < head and last[i][-1] >= 0
                    fine = reached and stop <= ahead and stop - self.width(p) >= inner[-1] and tail[stop - inner[-1] - 1] == p
                elif end >= size:  # a piece that covers the whole chunk
                    fine = into[i] == (stop, told)
                else:
                    fine = stop <= ahead and stop - self.width(p) >= end and last[i][stop - end - 1] == p
                if fine:
                    matrix[i, j] = 0.0
        return into, outof, matrix, (entering, last, head, inner, tail)

    def backtrace(self, before: str, body: str, size: int, i: int, j: int) -> np.ndarray:
        """The ids of a chunk's pieces on the path from its state ``i`` to its state ``j``."""
        _, outof, _, (entering, last, head, inner, tail) = self.transfer(before, body, size)
        end, stop = entering[i][0], size + outof[j][0]
        if not inner:
            return self._ids_of(self._traced(last[i], 0, stop - end) if stop > end else [])
        first = self._traced(last[i], 0, head - end) if end < head else []
        words = [body[a:b] for a, b in zip(inner, inner[1:])]
        new = {w for w in words if w not in self.known}
        self._learn(list(new))
        middle = [np.frombuffer(self.known[w], dtype=np.int32) for w in words]
        return np.concatenate([self._ids_of(first), *middle, self._ids_of(self._traced(tail, 0, stop - inner[-1]))])

    def _ids_of(self, path: list[int]) -> np.ndarray:
        return self._ids(path) if path else np.zeros(0, dtype=np.int32)

    def words_of(self, text: str | None) -> list[str]:
        """The runs between places that no piece straddles."""
        if not text:
            return []
        whole = self.marked(text)
        if self.straddles:
            return [whole]
        if whole[0] == MARK and MARK + MARK not in whole and whole[-1] != MARK:
            return [MARK + w for w in whole[1:].split(MARK)]
        return re.split(f"(?<=[^{MARK}])(?={MARK})", whole)

    def encode(self, texts: list[str | None], kept: int = KEPT) -> list[np.ndarray]:
        split = [self.words_of(t) for t in texts]
        new = set().union(*split)
        if len(self.known) > kept:  # words that this block has, too, stay
            self.known = {w: ids for w, ids in self.known.items() if w in new}
        new.difference_update(self.known)
        self._learn(list(new))
        known = self.known.__getitem__
        empty = np.zeros(0, dtype=np.int32)
        return [np.frombuffer(b"".join(map(known, words)), dtype=np.int32) if words else empty for words in split]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        parts = list(map(self.as_text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if None in parts:
            data = bytearray()
            out = []
            for i, p in zip(ids, parts):
                if p is None:
                    data.append(int(self.pieces[int(i)][3:5], 16))
                    continue
                if data:
                    out.append(data.decode("utf-8", "replace"))
                    data = bytearray()
                out.append(p)
            out.append(data.decode("utf-8", "replace"))
            parts = out
        text = "".join(parts)
        return text[1:] if self.prefix and text.startswith(" ") else text


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), -np.inf)
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _prefix_scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products in the (max, +) semiring, by halves: pairs are combined, their prefixes scanned, and the
    places between filled in."""
    if len(matrices) == 1:
        return matrices
    pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
    inner = _prefix_scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(inner[i // 2] if i % 2 else max_plus(inner[i // 2 - 1], matrices[i]))
    return out


def path_states(matrices: list[np.ndarray]) -> list[int]:
    """The states, from the first boundary to the last, of the path of weight 0 through the chunks' matrices."""
    reach = _prefix_scan(matrices)
    taken = [int(np.flatnonzero(reach[-1][0] == 0)[0])]
    for m in range(len(matrices) - 1, 0, -1):
        taken.append(int(np.flatnonzero((reach[m - 1][0] == 0) & (matrices[m][:, taken[-1]] == 0))[0]))
    return [0, *taken[::-1]]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models.clear()
        _models[path] = PieceModel(path)
    return _models[path]


def _as_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)])
    values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = (), check: bool = False, limit: int = BLOCK_BYTES, kept_words: int = KEPT) -> DataFrame:
    """``df`` with ``ids`` of whole texts, ``limit`` bytes at once; with ``check``, also ``round_trip``: whether decoding them gives the text
    back. ``path``: the vocabulary file, on every node."""

    def compute(texts: list) -> list[pa.Array]:
        m = model(path)
        gc.disable()  # many short arrays, no cycles
        try:
            ids = m.encode(texts, kept_words)
        finally:
            gc.enable()
        out = [_as_lists(ids)]
        if check:
            out.append(pa.array([m.decode(i) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts)], pa.bool_()))
        return out

    fields = [IDS] + [T.StructField("round_trip", T.BooleanType())] * check
    giant = F.coalesce(F.length(text) > GIANT, F.lit(False))
    usual = append_columns(df.where(~giant), text, fields, compute, drop, limit)
    kept = [c for c in df.columns if c not in drop and c not in {f.name for f in fields}]
    held = df.where(giant).select(F.monotonically_increasing_id().alias("key"), F.struct(*kept).alias("row") if kept else F.lit(0).alias("row"), F.col(text).alias("text"))
    held = written(held, "piece-giants")
    if held.isEmpty():
        return usual
    coded = held.join(_scanned(held, path), "key")
    if check:
        coded = _checked(coded, path)
    return usual.union(coded.select("row.*" if kept else F.lit(0).alias("_none"), *[f.name for f in fields]).select(*usual.columns))


_CHUNK = [("key", T.LongType()), ("chunk", T.IntegerType()), ("before", T.StringType()), ("body", T.StringType()), ("size", T.IntegerType())]
_MATRIX = [("n_in", T.IntegerType()), ("n_out", T.IntegerType()), ("open", T.BinaryType())]
_ROUTE = [("key", T.LongType()), ("chunk", T.IntegerType()), ("i", T.IntegerType()), ("j", T.IntegerType())]


def _schema(fields: list) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _cutting(path: str):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                parts = model(path).cut(text)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    columns = [[key] * len(some), range(at, at + len(some)), *zip(*some)]
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[n for n, _ in _CHUNK])

    return run


def _transferring(path: str):
    names = [n for n, _ in _CHUNK + _MATRIX]

    def run(batches):
        for batch in batches:
            for block in blocks([batch], "body"):
                found = [model(path).transfer(*r)[2] for r in zip(*(block.column(c).to_pylist() for c in ("before", "body", "size")))]
                extra = [pa.array([m.shape[k] for m in found], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*block.columns, *extra, pa.array([(m == 0).tobytes() for m in found], pa.binary())], names=names)

    return run


def _folded(table: pa.Table) -> pa.Table:
    """Of a document's matrices: the states that its path takes before and behind each chunk."""
    table = table.sort_by("chunk")
    shapes = zip(table.column("n_in").to_pylist(), table.column("n_out").to_pylist(), table.column("open").to_pylist())
    matrices = [np.where(np.frombuffer(o, dtype=bool).reshape(a, b), 0.0, -np.inf) for a, b, o in shapes]
    taken = path_states(matrices)
    return pa.table([table.column("key"), table.column("chunk"), pa.array(taken[:-1], pa.int32()), pa.array(taken[1:], pa.int32())], names=[n for n, _ in _ROUTE])


def _backtracing(path: str):
    def run(batches):
        for batch in batches:
            for block in blocks([batch], "body"):
                ids = [model(path).backtrace(*r) for r in zip(*(block.column(c).to_pylist() for c in ("before", "body", "size", "i", "j")))]
                yield pa.RecordBatch.from_arrays([block.column("key"), block.column("chunk"), _as_lists(ids)], names=["key", "chunk", "ids"])

    return run


def _scanned(held: DataFrame, path: str) -> DataFrame:
    """(key, ids) of giant texts: chunks, matrices, the fold of each document's, and backtraces."""
    chunks = held.select("key", "text").mapInArrow(_cutting(path), _schema(_CHUNK)).repartition("key", "chunk")
    chunks = written(chunks.mapInArrow(_transferring(path), _schema(_CHUNK + _MATRIX)), "piece-chunks")
    route = chunks.select("key", "chunk", "n_in", "n_out", "open").groupBy("key").applyInArrow(_folded, _schema(_ROUTE))
    found = chunks.drop("n_in", "n_out", "open").join(route, ["key", "chunk"]).mapInArrow(_backtracing(path), _schema([_CHUNK[0], _CHUNK[1], ("ids", IDS.dataType)]))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return found.groupBy("key").agg(F.flatten(F.transform(ordered, lambda c: c["ids"])).alias("ids"))


def _checked(coded: DataFrame, path: str) -> DataFrame:
    schema = T.StructType([*coded.schema.fields, T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for block in blocks([batch], "text"):
                same = [model(path).decode(np.array(i, dtype=np.int64)) == t.replace(MARK, " ") for i, t in zip(block.column("ids").to_pylist(), block.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(same, pa.bool_())], names=schema.names)

    return coded.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the texts of ``ids``; null gives null."""
    kept = [f for f in df.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            found = [None if i is None else model(path).decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(found, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary(), drop=("text",), check=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"), "round_trip")
