"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

encode: a score-ordered agenda of adjacent symbol pairs. All neighbouring symbols that form
a piece wait on the agenda, best score first, leftmost first among equals; the top pair is
merged and its new neighbours join the agenda, until none is left. Pieces have their space
mark in front only (this is checked when a vocabulary is loaded), so no merge crosses into
the next run of space marks and the agenda runs once for each distinct unit of a batch.
Short units run side by side, one agenda in each row of a numpy matrix; long ones, and those
with characters that the vocabulary lacks, each on a heap.

Each batch's new units are then encoded once more by the sentencepiece library and compared;
where they differ, the library's ids count and `matches_library` is false.

Nulls and empty texts have no ids and decode to "". Repeated rows and ids are rows like any
other. Other columns are left out. Unknown characters fall back to byte pieces where the
vocabulary has them, else to the unknown id, one for each run as the library gives.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
KEPT = 300_000  # units in each of the two generations that a worker remembers
SHORT = 32  # characters of the longest unit that goes in a matrix
NEVER = 1 << 30  # rank of symbols that don't form a piece
SPREAD = 0x9E3779B97F4A7C15
BATCH = 1 << 20  # characters encoded and checked together


class Vocabulary:
    """Pieces and scores of a model file, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:  # the vocabulary file is installed on every machine
            self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(lib.vocab_size()):
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)):
                piece = lib.id_to_piece(i)
                self.ids[piece], self.scores[piece] = i, lib.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character; units can't be encoded alone")
        self.code = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.code[ord(p)] = i
        ranks = {x: k for k, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                if (x := self.ids.get(p[:cut])) is not None and (y := self.ids.get(p[cut:])) is not None:
                    pairs[x << 32 | y] = (i, ranks[self.scores[p]])
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k][0] for k in sorted(pairs)] + [0], np.int32)
        self.rank = np.array([pairs[k][1] for k in sorted(pairs)] + [NEVER], np.int32)
        self.slots, self.held = self.hashed(), np.append(self.pairs, -1)
        self.decimal = [str(i) for i in range(lib.vocab_size())]
        self.unknown = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(lib.is_byte(i) for i in self.bytes)
        lone_break = not any("\n" in p and len(p) > 1 for p in self.ids)
        self.break_ids = self.encode_unit("\n") if lone_break else None
        self.units = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if lone_break else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def encode_unit(self, unit: str) -> list[int]:
        """The agenda over one unit."""
        n, scores = len(unit), self.scores
        parts: list[str] = list(unit)
        if n > 1:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            agenda = [(-s, i, p) for i in range(n - 1) if (s := scores.get(p := unit[i : i + 2])) is not None]
            heapq.heapify(agenda)
            while agenda:
                _, i, p = heapq.heappop(agenda)
                left = parts[i]
                if not left or (j := after[i]) >= n or len(left) + len(parts[j]) != len(p) or left + parts[j] != p:
                    continue  # one of the two has been merged meanwhile
                parts[i], parts[j] = p, ""
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (s := scores.get(q := p + parts[k])) is not None:
                        heapq.heappush(agenda, (-s, i, q))
                if (b := before[i]) >= 0 and (s := scores.get(q := parts[b] + p)) is not None:
                    heapq.heappush(agenda, (-s, b, q))
        out: list[int] = []
        for p in parts:
            if p:
                if (i := self.ids.get(p)) is not None:
                    out.append(i)
                elif self.fallback:
                    out += [self.bytes[b] for b in p.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def hashed(self) -> np.ndarray:
        """Places of the pairs in an open hash table; len(pairs) marks a free slot."""
        size = 1 << (4 * len(self.pairs)).bit_length()
        self.shift, slots = np.uint64(64 - size.bit_length() + 1), np.full(size + 64, len(self.pairs), np.int32)
        for k, at in enumerate((self.pairs.astype(np.uint64) * np.uint64(SPREAD) >> self.shift).tolist()):
            while slots[at] != len(self.pairs):
                at += 1
            slots[at] = k
        return slots

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of symbols, len(pairs) where they form no piece."""
        none, keys = len(self.pairs), left.astype(np.int64) << 32 | right
        at = (keys.astype(np.uint64) * np.uint64(SPREAD) >> self.shift).astype(np.int64)
        out = self.slots[at]
        while len(open_ := np.flatnonzero((out != none) & (self.held[out] != keys))):
            at[open_] += 1
            out[open_] = self.slots[at[open_]]
        return out

    def encode_rows(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Runs one agenda in each row. symbols is padded with -1; length is changed to the number of ids."""
        n, width = symbols.shape
        waiting = np.full((n, width), NEVER, np.int32)  # rank of the pair that begins here
        both = (symbols[:, :-1] >= 0) & (symbols[:, 1:] >= 0)
        where = np.nonzero(both)
        waiting[where] = self.rank[self.find(symbols[:, :-1][where], symbols[:, 1:][where])]
        rows, column = np.arange(n), np.arange(width)
        s, w = symbols, waiting
        while len(rows):
            best = w.argmin(1)
            at = np.arange(len(rows))
            go = w[at, best] < NEVER
            if not go.all():
                symbols[rows[~go]] = s[~go]
                rows, s, w, best = rows[go], s[go], w[go], best[go]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            merged = self.made[self.find(s[at, best], s[at, best + 1])]
            source = np.minimum(column + (column > best[:, None]), width - 1)
            s, w = np.take_along_axis(s, source, 1), np.take_along_axis(w, source, 1)
            s[:, -1], w[:, -1] = -1, NEVER
            s[at, best] = merged
            length[rows] -= 1
            for to in (best - 1, best):
                ok = (to >= 0) & (to + 1 < length[rows])
                w[at[~ok & (to >= 0)], to[~ok & (to >= 0)]] = NEVER
                i, j = at[ok], to[ok]
                w[i, j] = self.rank[self.find(s[i, j], s[i, j + 1])]
        return symbols

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as the bytes of an int32 array."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = self.code[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        known = np.minimum.reduceat(codes, starts) >= 0 if len(units) else np.zeros(0, bool)
        out: list[bytes] = [b""] * len(units)
        low = 0
        for width in (6, 9, 12, 16, SHORT):
            own = np.flatnonzero(known & (lengths <= width) & (lengths > low))
            low = width
            for chosen in np.array_split(own, len(own) // 20_000 + 1):
                n = lengths[chosen]
                columns = np.arange(width)
                symbols = np.where(columns < n[:, None], codes[np.minimum(starts[chosen][:, None] + columns, len(codes) - 1)], -1)
                symbols = self.encode_rows(symbols.astype(np.int32), n) if len(chosen) else symbols
                raw, step = symbols.tobytes(), 4 * width
                for k, (u, m) in enumerate(zip(chosen.tolist(), n.tolist(), strict=True)):
                    out[u] = raw[k * step : k * step + 4 * m]
        for u in np.flatnonzero(~known | (lengths > SHORT)).tolist():
            out[u] = np.array(self.encode_unit(units[u]), np.int32).tobytes()
        return out

    def normalised(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def library_ids(self, units: list[str]) -> list[int]:
        """What the library gives for all units in one text, each apart from the next."""
        return self.library.encode("\n" + "".join([u if u[0] == MARK else "\n" + u for u in units]).replace(MARK, " "))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a bounded memory of units; one for each Python worker."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units by the agenda, checked against the library."""
        v = self.vocabulary
        ids = v.encode_units(units)
        if v.break_ids is None:
            return dict(zip(units, ids, strict=True))
        gap = np.array(v.break_ids, np.int32).tobytes()
        head = np.array(v.encode_unit(MARK), np.int32).tobytes() + gap
        expected = head + b"".join([x if u[0] == MARK else gap + x for u, x in zip(units, ids, strict=True)])
        if np.array(v.library_ids(units), np.int32).tobytes() != expected:
            for k, u in enumerate(units):
                got = np.array(v.library_ids([u]), np.int32).tobytes()[len(head) + (u[0] != MARK) * len(gap) :]
                if got != ids[k]:
                    ids[k] = got
                    self.differ.add(u)
        return dict(zip(units, ids, strict=True))

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """For each text: its ids, and whether the library gives the same."""
        v = self.vocabulary
        cut = [v.units(v.normalised(t)) for t in texts]
        new = set().union(*cut).difference(self.young)
        if len(self.young) + len(new) > KEPT:
            self.old, self.young = self.young, {}
            new = set().union(*cut)
        if self.old:
            again = new.intersection(self.old)
            self.young.update((u, self.old[u]) for u in again)
            new -= again
        self.young.update(self.learn(list(new)))
        table = self.young.__getitem__
        out = []
        for units in cut:
            same = not self.differ or self.differ.isdisjoint(units)
            out.append((np.frombuffer(b"".join(map(table, units)), np.int32).tolist(), same))
        for u in new:
            if len(u) > SHORT:
                del self.young[u]
        return out


_encoders: dict[str, Encoder] = {}


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.setdefault(path, Encoder(path))
    library, decimal = encoder.vocabulary.library, encoder.vocabulary.decimal.__getitem__
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH):
                size += len(texts[hi])
                hi += 1
            coded = encoder.encode(texts[lo:hi])
            decoded = library.decode([x for x, _ in coded], num_threads=1)
            cols = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x, _ in coded], pa.int64())]
            if full:
                cols += [pa.array([x for x, _ in coded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            cols += [
                pa.array([hashlib.sha256(",".join(map(decimal, x)).encode()).hexdigest() for x, _ in coded]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                pa.array([k for _, k in coded], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=NAMES if full else [n for n in NAMES if n not in ("ids", "decoded")])
            lo = hi


NAMES = ["_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256", "matches_library"]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Encodes and decodes every whole text of docs with the vocabulary file model.

    Returns the id, n_tokens, ids and decoded (only if full), ids_sha256, decoded_sha256 and
    matches_library. model is a path that holds on every machine, as installed packages' files do.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, " + "ids array<int>, decoded string, " * full + "ids_sha256 string, decoded_sha256 string, matches_library boolean"
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(partial(encode_batches, path=model, full=full), schema).withColumnRenamed("_id", id_col)
