"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as a benchmark item gets a SimHash of its
words (128 bits, each word weighted by its count). A multi-index finds all items whose
fingerprint lies within RADIUS bits: the fingerprint is cut in 8 blocks of 16 bits, and two
fingerprints at most 31 bits apart agree in some block but for 3 bits (pigeonhole), so a
window looks in each block under all 697 values at most 3 bits from its own. Items found
are then verified: weighted Jaccard of the word shingles of window and item, a shingle's
weight being its number of occurrences, of at least percent.

Windows that can't reach percent aren't hashed: weights shared with an item are at most the
window's shingles that some item of its size holds, counted by running sums over the whole text.
This drops no window that would pass the last step.

The work is one pass over the documents without a shuffle. The benchmark is read in blocks of
at most BLOCK characters, one after the other, and each block but the last has its result
written before the next is read; so the driver and each worker hold one block's index, about
4 bytes a character and 60 an item. Each block is one more pass.

Definitions: words are runs other than ASCII white space, A-Z lower-cased. A text of fewer
than k words has its whole sequence as one shingle. A document shorter than an item is one
window. Null and empty texts, and items without words, match nothing. Repeated rows and items
are rows like any other; rows without id are judged too. Extra columns are left out by
contaminated() and kept by drop_contaminated().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.llm.scratch import Scratch
from vidtables.llm.words import U, Words, mix, slices, utf8

RADIUS = 31  # of 128 bits
BLOCKS, WIDTH, NEAR = 8, 16, 3  # RADIUS < BLOCKS * (NEAR + 1)
BLOCK = 1 << 23  # characters of benchmark held at once
PROBES = 256  # windows looked up together
AT_ONCE = 1 << 15  # words of the windows hashed together


@cache
def flips() -> np.ndarray:
    """All 16-bit values with at most NEAR bits set."""
    return np.array([sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(WIDTH), n)], np.uint16)


def fingerprints(words: np.ndarray) -> np.ndarray:
    """SimHash of each row of word hashes, as BLOCKS values of WIDTH bits."""
    n, m = words.shape
    votes = np.zeros((n, 128), np.int32)
    for half in range(2):
        bits = np.unpackbits(mix(words + U(0x51ED27 * (half + 1))).reshape(n, m, 1).view(np.uint8), axis=2)
        votes[:, 64 * half : 64 * half + 64] = bits.sum(1, dtype=np.int32)
    return np.packbits(2 * votes > m, axis=1).view(np.uint16)


class Benchmark:
    """One block of items: shingles by size, and the multi-index of fingerprints."""

    def __init__(self, ids: list, texts: list[str], k: int, percent: int):
        self.k, self.percent = k, percent
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        w = Words(data, offsets)
        self.size = np.diff(w.first)
        self.ids = ids
        shingles, first = w.shingles(k)
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.lexsort((shingles, owner))
        shingles, new = shingles[order], np.ones(len(order), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        self.shingles, self.weights = shingles[starts], np.diff(np.append(starts, len(order))).astype(np.int32)  # of each item, in order
        self.first, self.total = np.searchsorted(owner[starts], np.arange(len(ids) + 1)), np.diff(first)
        own = np.flatnonzero(self.size)
        self.sizes = np.unique(self.size[own]).tolist()
        self.short = np.array([n for n in self.sizes if n < k], np.int32)
        of_size = np.unique(np.rec.fromarrays((self.shingles, self.size[owner[starts]].astype(np.int32)), names="shingle,size"))
        self.held, self.held_first = np.unique(of_size["shingle"], return_index=True)  # shingles of any item, and where their sizes of items begin
        self.held_first, self.held_size = np.append(self.held_first, len(of_size)), of_size["size"]
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.held >> U(48)).astype(np.int64)] = True
        prints = np.zeros((len(ids), BLOCKS), np.uint16)
        for i in own.tolist():
            prints[i] = fingerprints(w.hash[None, w.first[i] : w.first[i + 1]])[0]
        self.prints = prints
        value = (prints[own].astype(np.int64) + (np.arange(BLOCKS) << WIDTH)).ravel()
        order = np.argsort(value, kind="stable")
        self.items = np.repeat(own, BLOCKS)[order].astype(np.int32)
        self.starts = np.searchsorted(value[order], np.arange((BLOCKS << WIDTH) + 1)).astype(np.int32)
        self.used = self.starts[1:] > self.starts[:-1]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints at most RADIUS bits apart."""
        found = [np.zeros(0, np.int64)]
        for some in range(0, len(prints), PROBES):
            at = (prints[some : some + PROBES, :, None] ^ flips()).astype(np.int32) + (np.arange(BLOCKS, dtype=np.int32) << WIDTH)[:, None]
            at = at.reshape(len(at), -1)
            window, place = np.nonzero(self.used[at])
            value = at[window, place]
            lo, n = self.starts[value], self.starts[value + 1] - self.starts[value]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(np.unique((np.repeat(window, n) + some) << 32 | self.items[entry]))
        pair = np.concatenate(found)
        window, item = pair >> 32, pair & 0xFFFFFFFF
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1)
        return window[apart <= RADIUS], item[apart <= RADIUS]

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's."""
        token, n = np.unique(shingles, return_counts=True)
        own = slice(self.first[item], self.first[item + 1])
        at = np.searchsorted(self.shingles[own], token)
        at[at == own.stop - own.start] = 0
        common = int(np.minimum(n, self.weights[own][at])[self.shingles[own][at] == token].sum())
        return common / (len(shingles) + int(self.total[item]) - common)

    def search(self, hashes: np.ndarray, shingles: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Best window of one document for each item that it holds: similarity, first word, words."""
        best: dict[int, tuple[float, int, int]] = {}
        n, k = len(hashes), self.k
        places = np.flatnonzero(self.may[(shingles >> U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.held, shingles[places]), max(len(self.held) - 1, 0))
        known = self.held[at] == shingles[places]
        places, at = places[known], at[known]
        sizes = self.held_first[at + 1] - self.held_first[at]  # of items that hold the shingle at each place
        held_at = np.repeat(places, sizes)
        held_size = self.held_size[np.arange(len(held_at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.held_first[at], sizes)]
        for size in np.union1d(held_size, self.short).tolist():
            m = min(size, n)
            if m < k and m < n:  # the window is one shingle, with a hash of its own
                starts = np.arange(n - m + 1)
                starts = starts[np.isin(_short(hashes, starts, m), self.held)]
            elif m < k:
                starts = np.arange(1) if (held_size == size).any() else np.zeros(0, np.int64)
            else:
                hits = np.zeros(len(shingles) + 1, np.int32)
                hits[held_at[held_size == size] + 1] = 1
                hits = np.cumsum(hits, dtype=np.int32)
                shares = hits[m - k + 1 :] - hits[: len(hits) - (m - k + 1)]
                item_shingles = max(size - k + 1, 1)
                need = -(-self.percent * (item_shingles + m - k + 1) // (100 + self.percent))
                starts = np.flatnonzero(shares >= max(need, 1))
            step = max(1, AT_ONCE // m)
            for lo in range(0, len(starts), step):
                some = starts[lo : lo + step]
                window, item = self.within(fingerprints(hashes[some[:, None] + np.arange(m)]))
                fits = self.size[item] == size
                for w, i in zip(window[fits].tolist(), item[fits].tolist(), strict=True):
                    s = int(some[w])
                    held = shingles[s : s + m - k + 1] if m >= k else _short(hashes, np.array([s]), m)
                    found = self.similarity(held, i)
                    if found * 100 >= self.percent and (i not in best or found > best[i][0]):
                        best[i] = (found, s, m)
        return best


def _short(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Hashes of windows of m words as texts of m words, m < k, would have them."""
    out = np.full(len(starts), m, np.uint64)
    for j in range(m):
        out = mix(out + hashes[starts + j] * U(2 * j + 3))
    return out


def search_rows(column: pa.Array, bench: Benchmark) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """Rows of a text column that hold items."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        w = Words(data, offsets, lo, hi)
        shingles, first = w.shingles(bench.k)
        if min(bench.sizes, default=bench.k) >= bench.k:  # rows without any known shingle have no window
            seen = np.concatenate(([0], np.cumsum(bench.may[(shingles >> U(48)).astype(np.int64)])))
            rows = np.flatnonzero(seen[first[1:]] > seen[first[:-1]]).tolist()
        else:
            rows = range(hi - lo)
        for i in rows:
            if w.first[i + 1] > w.first[i]:
                found = bench.search(w.hash[w.first[i] : w.first[i + 1]], shingles[first[i] : first[i + 1]])
                if found:
                    yield lo + i, found


def hit_batches(batches: Iterator[pa.RecordBatch], bench: Benchmark, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of search_rows() with the id of each document (first column) and item."""
    for batch in batches:
        rows = [(r, bench.ids[i], *x) for r, found in search_rows(batch.column(1), bench) for i, x in sorted(found.items())]
        r, item, similarity, start, n = (list(z) for z in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(r, pa.int64())), pa.array(item, item_type), pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
            names=["id", "item", "similarity", "first_word", "n_words"],
        )


def clean_batches(batches: Iterator[pa.RecordBatch], bench: Benchmark, place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        keep[[r for r, _ in search_rows(batch.column(place), bench)]] = False
        yield batch.filter(pa.array(keep))


def blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[list, list[str], bool]]:
    """Ids and texts of the benchmark's items, in blocks of at most BLOCK characters or of one longer item, and whether a block is the last."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(item_col, item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
        if texts and size + len(text) > BLOCK:
            yield ids, texts, False
            ids, texts, size = [], [], 0
        ids.append(item), texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts, True


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 75
) -> DataFrame:
    """(id, item, similarity, first_word, n_words) of each document and item that it holds, with the best window."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    schema = f"id {kind}, item {item_kind}, similarity double, first_word long, n_words long"
    picked, scratch, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), Scratch(docs.sparkSession, "decontamination"), None
    for ids, texts, last in blocks(benchmark, item_col, item_text):
        found = picked.mapInArrow(partial(hit_batches, bench=Benchmark(ids, texts, k, percent), item_type=item_type), schema)
        found = found if last else scratch.save(found)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    names = [id_col, item_col if item_col != id_col else f"{item_col}_item"]
    return out.withColumnsRenamed(dict(zip(("id", "item"), names, strict=True)))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 75
) -> DataFrame:
    """Rows of docs, with all columns, that hold no item."""
    out, held, scratch = docs, None, Scratch(docs.sparkSession, "decontamination")
    for ids, texts, last in blocks(benchmark, item_col, item_text):
        out = out.mapInArrow(partial(clean_batches, bench=Benchmark(ids, texts, k, percent), place=docs.columns.index(text_col)), docs.schema)
        if not last:
            out = scratch.save(out)
            if held is not None:
                scratch.drop(held)
            held = out
    return out
