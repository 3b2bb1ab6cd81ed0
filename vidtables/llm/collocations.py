"""Phrases whose words occur together more often than apart, from vertical lists of positions.

Texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words, A-Z lower-cased. The words of about
BLOCK bytes of texts of one language are a block: each distinct word has its inverted list, the
ascending positions at which it occurs in the block. A position is skipped between pieces, so
words are neighbours if and only if their positions follow each other, and no list crosses a piece.

Level by level, a phrase that is frequent is extended by the words behind it: the block's positions of
phrases of k words are merge-joined with those of phrases of k words that begin one word later. The
length of the joined list is the longer phrase's exact number of occurrences in the block;
blocks are summed. A phrase that is frequent has only frequent parts, so lists of others aren't extended.

Which phrases are frequent is known to the blocks by a bitmap of CELLS bits (16 MB, whatever
the input), which has the hash of each frequent one. A bit that an infrequent phrase shares costs the
counting of phrases that don't become candidates, and never a result: all counts are exact, by
the phrases' own texts. Lists are written once and read again at each level, TOGETHER blocks by a task: Spark
holds a task's distinct phrases until it has counted them, so a task's memory goes with its blocks.

Definitions: null texts have no words; a null language is `und`. Repeated rows count each, ids aren't
used. An empty table, and one without frequent phrases, gives no rows. Extra columns are left out. A long
text may lie in several blocks, cut between pieces; a piece is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtables.llm.scratch import WHILE_WRITING, Scratch, settings
from vidtables.llm.words import LOWER, mix, powers

BLOCK = 2 << 20
TOGETHER = 4
A_FILE = "4m"  # as much as opening a file counts for, so that a task reads one
CELLS = 1 << 27
SLOTS = 64
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 9]] = True
U = np.uint64


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] if len(words) else 0 :]
    out, lo = np.empty(len(words), np.uint64), 0
    while lo < len(words):  # some words at once, so that powers stay few
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
        a, b = offsets[lo:hi] - offsets[lo], offsets[lo + 1 : hi + 1] - offsets[lo]
        piece = data[offsets[lo] - offsets[0] : offsets[hi] - offsets[0]]
        up, down = powers(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + U(1)) * up[: len(piece)], out=sums[1:])
        out[lo:hi] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


def cells_of(parts: list[np.ndarray], lang: int, cells: int) -> np.ndarray:
    """The bit of each phrase, given the hashes of its words in order, and that of the language."""
    out = np.full(len(parts[0]), U(lang))
    for h in parts:
        out = mix(out + h * U(3))
    return (out % U(cells)).astype(np.int64)


def lang_hash(lang: str) -> int:
    return int(hashed(pa.array([lang]))[0])


def squeezed(positions: np.ndarray, first: np.ndarray) -> bytes:
    """Ascending lists as their differences, byte planes apart, which compresses well."""
    gaps = np.diff(positions, prepend=0)
    gaps[first] = positions[first]
    return np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unsqueezed(data: bytes, lengths: np.ndarray) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    sums = np.cumsum(gaps)
    before = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return sums - np.repeat(sums[before] - gaps[before], lengths)


def indexed(text: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """Distinct words of a block, the lengths of their lists, and their positions, list by list."""
    text = LOWER[text]
    word = ~GAPS[text]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return None
    breaks = np.searchsorted(np.flatnonzero(BREAKS[text]), start)
    position = np.arange(len(start)) + np.concatenate(([0], np.cumsum(breaks[1:] != breaks[:-1])))
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    letters = pa.py_buffer(np.ascontiguousarray(text[word]))
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), letters).dictionary_encode()
    ids = found.indices.to_numpy()
    order = np.argsort(ids, kind="stable")
    return found.dictionary.cast(pa.string()), np.bincount(ids, minlength=len(found.dictionary)), position[order]


def pieces_of(text: pa.Scalar, size: int) -> Iterator[np.ndarray]:
    """A text's bytes, in parts of about size that end where a piece does."""
    data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
    lo = 0
    while len(data) - lo > size:
        at = lo + size
        while at < len(data):
            near = np.flatnonzero(BREAKS[data[at : at + (1 << 16)]])
            if len(near):
                at += int(near[0]) + 1
                break
            at += 1 << 16
        at = min(at, len(data))
        yield data[lo:at]
        lo = at
    if lo < len(data):
        yield data[lo:]


def list_batches(batches: Iterator[pa.RecordBatch], block_size: int) -> Iterator[pa.RecordBatch]:
    """Blocks (lang, words, lengths, positions) of (lang, text)."""
    held: dict[str, bytearray] = {}
    size = 0

    def block(lang: str) -> Iterator[pa.RecordBatch]:
        found = indexed(np.frombuffer(held.pop(lang), np.uint8))
        if found:
            words, lengths, positions = found
            first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            ends = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(lengths.astype(np.int32))), pa.array([squeezed(positions, first)], pa.binary())],
                names=["lang", "words", "lengths", "positions"],
            )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for piece in pieces_of(text, block_size):
                own = held.setdefault(lang, bytearray())
                own += piece.tobytes() + b"\n"
                size += len(piece) + 1
                if len(own) >= block_size or size >= 4 * block_size:
                    longest = max(held, key=lambda x: len(held[x]))
                    size -= len(held[longest])
                    yield from block(longest)
    for lang in list(held):
        yield from block(lang)


class Block:
    """One block's lists, read back; frequent[k] has a bit for each frequent phrase of k words."""

    def __init__(self, lang: str, words: pa.Array, lengths: np.ndarray, positions: bytes):
        self.lang, self.words = lang_hash(lang), words
        at = unsqueezed(positions, lengths)
        self.id = np.full(int(at.max()) + 2, -1, np.int64)  # the word at each position
        self.id[at] = np.repeat(np.arange(len(words)), lengths)
        self.hash = hashed(words)

    def extended(self, k: int, frequent: list[Broadcast]) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which phrases of k words begin, both of whose parts of k - 1 words are frequent, and their words, (n, k)."""
        at = np.flatnonzero(self.id >= 0)
        for n in range(1, k):
            bits = np.frombuffer(frequent[n - 1].value, np.uint8)
            words = [self.id[at + j] for j in range(n)]
            cell = cells_of([self.hash[w] for w in words], self.lang, 8 * len(bits))
            at = at[(bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
            at = np.intersect1d(at, at - 1, assume_unique=True)  # the lists of those that begin one word later
        return at, np.stack([self.id[at + j] for j in range(k)], axis=1) if len(at) else np.zeros((0, k), np.int64)

    def counted(self, k: int, frequent: list[Broadcast]) -> tuple[pa.Array, np.ndarray]:
        """Phrases of k words of the block and the lengths of their lists."""
        _, words = self.extended(k, frequent)
        key, n = words[:, 0].copy(), len(self.words)
        for j in range(1, k):  # numbers of distinct phrases so far, so that keys stay small
            key = np.unique(key, return_inverse=True)[1] * n + words[:, j] if j > 1 else key * n + words[:, j]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(words[first, j])) for j in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], counts


def count_batches(batches: Iterator[pa.RecordBatch], k: int, frequent: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of each block's phrases of k words."""
    for batch in batches:
        lists = batch.column("words"), batch.column("lengths")
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            words, lengths = (x[i].values for x in lists)
            if k == 1:
                phrases, counts = words, lengths
            else:
                phrases, counts = Block(lang, words, lengths.to_numpy(), batch.column("positions")[i].as_py()).counted(k, frequent)
            for lo in range(0, len(phrases), 1 << 16):
                some = phrases.slice(lo, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(some), np.int64))), some, pa.array(np.asarray(counts[lo : lo + (1 << 16)]), pa.int64())], names=["lang", "phrase", "f"])


def cell_batches(batches: Iterator[pa.RecordBatch], n_cells: int) -> Iterator[pa.RecordBatch]:
    """The bit of each (lang, phrase)."""
    for batch in batches:
        cells = np.zeros(len(batch), np.int64)
        words = pc.split_pattern(batch.column("phrase"), " ")
        langs = np.array(batch.column("lang").to_pylist(), object)
        if len(batch):
            k = len(words[0])
            flat = hashed(words.flatten()).reshape(-1, k)
            for lang in set(langs):
                own = langs == lang
                cells[own] = cells_of([flat[own, j] for j in range(k)], lang_hash(lang), n_cells)
        yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])


def bits_of(frequent: DataFrame, n_cells: int) -> bytes:
    """The bitmap of frequent phrases: n_cells bits, a multiple of 32768, whatever their number."""
    cells = frequent.mapInArrow(partial(cell_batches, n_cells=n_cells), "cell long")
    rows = cells.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    out = np.zeros(n_cells // 8, np.uint8)
    for r in rows.collect():  # at most n_cells / 32768 rows of 4 KB
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


class Collocations:
    """Frequent phrases of one table, level by level."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, words: int = 3, block: int = BLOCK, cells: int = CELLS):
        self.spark, self.least, self.most, self.cells = docs.sparkSession, least, words, cells
        self.scratch = Scratch(self.spark, "collocations")
        texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
        self.lists = self.scratch.save(texts.mapInArrow(partial(list_batches, block_size=block), "lang string, words array<string>, lengths array<int>, positions binary"), TOGETHER)
        self.totals = self.lists.groupBy("lang").agg(F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)")).alias("n"))

    def frequent(self) -> DataFrame:
        """(lang, phrase, words, f) of all phrases of 1 to `most` words with f >= least."""
        bits, levels = [], []
        for k in range(1, self.most + 1):
            if k > 1:
                with settings(self.spark, WHILE_WRITING):
                    bits.append(self.spark.sparkContext.broadcast(bits_of(levels[-1], self.cells)))
            counts = self.lists.mapInArrow(partial(count_batches, k=k, frequent=bits), "lang string, phrase string, f long")
            summed = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= self.least)
            levels.append(self.scratch.save(summed, reading=A_FILE))
        found = [level.withColumn("words", F.lit(k)) for k, level in enumerate(levels, 1)]
        out = found[0]
        for level in found[1:]:
            out = out.union(level)
        return out

    def scored(self, frequent: DataFrame) -> DataFrame:
        """(lang, phrase, words, a, l, r, score): each candidate with its lowest-scoring cut."""
        candidates = frequent.where("words > 1").withColumnRenamed("f", "a")
        cuts = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
        left, right = (frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(c)) for part, c in (("first", "l"), ("rest", "r")))
        known = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
        wide = [F.col(c).cast("decimal(38,0)").alias(c) for c in "alr"]
        score = known.select("lang", "phrase", "words", "k", *wide).withColumn("score", F.expr("(1000000 * a * a) div (l * r)"))
        best = score.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
        return best.select("lang", "phrase", "words", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("a", "l", "r", "score")])

    def apart(self, candidates: DataFrame, percent: int = 50) -> DataFrame:
        """Candidates that aren't inside a longer one with at least percent of their occurrences."""
        longer = candidates.where("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", F.col("a").alias("f"))
        # a phrase inside one that is longer by more lies in one that is longer by one, which is no rarer
        parts = longer.select("lang", "f", F.explode(F.array(F.slice("w", 1, F.col("words") - 1), F.slice("w", 2, F.col("words") - 1))).alias("part"))
        most = parts.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("f"))
        return candidates.join(most, ["lang", "phrase"], "left").where(f"f is null or 100 * f < {percent} * a").drop("f")

    def ranked(self, top: int = 2000) -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score): the first `top` of each language, chosen in SLOTS parts first."""
        kept = self.apart(self.scratch.save(self.scored(self.frequent())))
        order = [F.desc("score"), F.desc("a"), "phrase"]
        part = Window.partitionBy("lang", "_slot").orderBy(*order)
        first = kept.withColumn("_slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        final = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        return final.join(self.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, words: int = 3, top: int = 2000, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """The `top` phrases of 2 to `words` words of each language by score, with a = f(phrase) >= least, the parts'
    frequencies l and r of its lowest-scoring cut, and the language's words n."""
    return Collocations(docs, text_col, lang_col, least, words, block, cells).ranked(top)


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
c1 AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY 1, 2),
c2 AS (SELECT lang, a, b, count(*) AS f FROM (SELECT lang, ws[i] AS a, ws[i + 1] AS b FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
c3 AS (SELECT lang, a, b, d, count(*) AS f FROM (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS d FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c1 GROUP BY 1),
f AS (SELECT lang, phrase, f FROM c1 UNION ALL SELECT lang, a || ' ' || b, f FROM c2),
cuts AS (SELECT lang, a || ' ' || b AS phrase, f AS a, 1 AS k, a AS x, b AS y FROM c2
  UNION ALL SELECT lang, a || ' ' || b || ' ' || d, f, 1, a, b || ' ' || d FROM c3 UNION ALL SELECT lang, a || ' ' || b || ' ' || d, f, 2, a || ' ' || b, d FROM c3),
s AS (SELECT cuts.*, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, a || ' ' || b AS part, f FROM c3 UNION ALL SELECT lang, b || ' ' || d, f FROM c3) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
