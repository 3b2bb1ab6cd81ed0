"""Vectors as short codes: product quantisation with integer codebooks, by an RDD treeAggregate.

Each component x becomes floor(1024 * x); a vector is cut into `parts` equal consecutive parts. A part
position's codebook begins as that part of the `entries` smallest vector ids. In each round all parts
go to their codebook's nearest entry (squared Euclidean distance, ties to the lower index), and each entry
becomes the componentwise floor(sum / count) of its parts; an unused one stays.

Vectors lie in blocks of at most BLOCK rows, a column of a block being one component of all its
vectors. A task adds up the distances of a block to all entries dimension by dimension, and
np.add.at counts and sums into two int64 tensors (part, entry) and (part, entry, component).
treeAggregate merges the tensors of all blocks through a reduction tree, so the driver gets as much as
there are codebooks, whatever the table's size. Blocks are written to the shared folder: a lost
executor costs the tasks that ran there. Sums of integers don't depend on the order of merging.

All arithmetic is exact: 32-bit integers where the largest component allows it, else 64-bit,
else Python's own.

Definitions: rows whose vector is null or holds null or non-finite components are dropped, and so are
vectors without components, of a length that `parts` doesn't divide, or of another length than that of
the smallest id's vector. Rows without id are encoded, but begin no codebook. Repeated ids are
taken by id, then by vector, for the beginning. With fewer than `entries` vectors the codebooks are
smaller. A table without any such vector gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.llm.scratch import Scratch

SCALE = 1024
BLOCK = 4096
SLOTS = 64


def number_type(largest: int, dims: int) -> np.dtype:
    """The smallest type in which squared distances of `dims` components up to `largest` are exact."""
    most = dims * (2 * largest + 1) ** 2
    return np.dtype(np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object)


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 or Python's integers; multiplying by a power of two is exact."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(x) if np.isfinite(x) else int(y) * SCALE for x, y in zip(scaled.tolist(), flat.tolist(), strict=True)], object)


def stored_type(largest: int) -> np.dtype | None:
    """How components up to `largest` lie in a block; None: as text."""
    return next((np.dtype(t) for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max), None)


def blocked(batches: Iterator[pa.RecordBatch], dims: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v) as blocks: ids and labels as lists, components column by column as bytes, the
    largest absolute component. v has no nulls and `dims` finite components."""
    for batch in batches:
        for lo in range(0, len(batch), size):
            part = batch.slice(lo, size)
            flat = integers(part.column("v").flatten().to_numpy(zero_copy_only=False))
            columns = flat.reshape(len(part), dims).T
            largest = int(np.abs(columns).max())
            kind = stored_type(largest)
            data = columns.astype(kind).tobytes() if kind else " ".join(map(str, columns.ravel().tolist())).encode()
            ends = pa.array([0, len(part)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.ListArray.from_arrays(ends, part.column(c)) for c in ("id", "label")), pa.array([data], pa.binary()), pa.array([str(largest)])],
                names=["ids", "labels", "data", "largest"],
            )


def columns_of(data: bytes, largest: int, dims: int, kind: np.dtype) -> np.ndarray:
    """A block's components, (dims, rows)."""
    stored = stored_type(largest)
    if stored is None:
        return np.array([int(x) for x in data.split()], object).reshape(dims, -1)
    return np.frombuffer(data, stored).reshape(dims, -1).astype(kind)


@dataclass
class Codebooks:
    """entries[p][e]: integer components, an array (parts, entries, components) of `kind`."""

    entries: np.ndarray
    kind: np.dtype

    def nearest(self, part: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each vector, from the part's columns."""
        book = self.entries[part]
        total = np.zeros((columns.shape[1], len(book)), self.kind)
        off = np.empty_like(total)
        for j, column in enumerate(columns):
            np.subtract(column[:, None], book[None, :, j], out=off)
            np.multiply(off, off, out=off)
            total += off
        at = total.argmin(axis=1) if self.kind != object else np.array([row.tolist().index(min(row)) for row in total], np.int64)
        return at, total[np.arange(len(at)), at]

    def assigned(self, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its columns, nearest entries, distances) of each part."""
        parts, _, width = self.entries.shape
        for p in range(parts):
            own = columns[p * width : (p + 1) * width]
            yield p, own, *self.nearest(p, own)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


Tensors = tuple[np.ndarray, np.ndarray] | None


def add_block(total: Tensors, block: tuple[bytes, int], books: Codebooks) -> Tensors:
    """total (sums, counts) with a block's parts added to their nearest entries; it is changed in place."""
    parts, n, width = books.entries.shape
    if total is None:
        total = np.zeros((parts, n, width), object if books.kind == object else np.int64), np.zeros((parts, n), np.int64)
    sums, counts = total
    for p, own, at, _ in books.assigned(columns_of(*block, parts * width, books.kind)):
        np.add.at(counts[p], at, 1)
        np.add.at(sums[p], at, own.T)
    return total


def merge(x: Tensors, y: Tensors) -> Tensors:
    """The sum of two partial results. Sums that could pass 64 bits go on as Python's integers."""
    if x is None or y is None:
        return y if x is None else x
    sums = [t[0] for t in (x, y)]
    if any(s.dtype != object and s.size and int(np.abs(s).max()) >= 1 << 61 for s in sums):
        sums = [s.astype(object) for s in sums]
    return sums[0] + sums[1], x[1] + y[1]


def improved(books: Codebooks, total: Tensors) -> Codebooks:
    """Entries as the floored means of their parts; unused ones as they were."""
    sums, counts = total
    means = sums // np.maximum(counts, 1)[:, :, None]
    return Codebooks(np.where((counts > 0)[:, :, None], means, books.entries).astype(books.kind), books.kind)


def encoded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """(id, label, code, error) of each vector of the blocks."""
    parts, _, width = books.entries.shape
    for batch in batches:
        for i in range(len(batch)):
            columns = columns_of(batch.column("data")[i].as_py(), int(batch.column("largest")[i].as_py()), parts * width, books.kind)
            digits, error = [], np.zeros(columns.shape[1], object if books.kind == object else np.int64)
            for _, _, at, distance in books.assigned(columns):
                digits.append(at)
                error = error + distance
            code = np.ascontiguousarray(np.array(digits, np.uint8).T)
            codes = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes), pa.array([str(x) for x in error.tolist()])],
                names=["id", "label", "code", "error"],
            )


class VectorCodes:
    """Codes for the vectors of one table."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, block: int = BLOCK):
        if entries > 256:
            raise ValueError("a code's digit pair has 256 values")
        self.spark, self.parts, self.n, self.rounds, self.block = vectors.sparkSession, parts, entries, rounds, block
        self.scratch = Scratch(self.spark, "vector-codes")
        rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
        unusable = "v is null or size(v) = 0 or exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        self.rows = rows.where(f"not ({unusable}) and size(v) % {parts} = 0")
        self.types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def first(self) -> np.ndarray | None:
        """The vectors of the smallest ids as integers, (parts, entries, components); at most `entries` rows reach the driver."""
        order = F.col("id").asc_nulls_last(), F.col("v")
        least = self.rows.orderBy(*order).limit(1).collect()
        if not least:
            return None
        same = self.rows.where(f"size(v) = {len(least[0].v)}")
        found = [r.v for r in same.where("id is not null").orderBy(*order).limit(self.n).collect()] or [least[0].v]
        return integers(np.array(found, np.float64).ravel()).reshape(len(found), self.parts, -1).transpose(1, 0, 2)

    def blocks(self, dims: int) -> DataFrame:
        schema = f"ids array<{self.types['id']}>, labels array<{self.types['label']}>, data binary, largest string"
        return self.scratch.save(self.rows.where(f"size(v) = {dims}").mapInArrow(partial(blocked, dims=dims, size=self.block), schema))

    def trained(self, blocks: DataFrame, books: Codebooks) -> Codebooks:
        held: RDD = blocks.select("data", "largest").rdd.map(lambda r: (bytes(r.data), int(r.largest)))
        depth = 2 if held.getNumPartitions() < 256 else 3
        for _ in range(self.rounds):
            total = held.treeAggregate(None, partial(add_block, books=books), merge, depth)
            books = improved(books, total)
        return books

    def result(self) -> tuple[DataFrame, Codebooks | None]:
        """(id, label, code, error) with error as decimal(38, 0), and the final codebooks."""
        first = self.first()
        schema = f"id {self.types['id']}, label {self.types['label']}, code string, error string"
        if first is None:
            return self.spark.createDataFrame([], schema.replace("error string", "error decimal(38,0)")), None
        dims = first.shape[0] * first.shape[2]
        blocks = self.blocks(dims)
        largest = max(int(r[0]) for r in blocks.groupBy(F.length("largest").alias("n")).agg(F.max("largest").alias("x")).select("x").collect())  # a row for each length
        kind = number_type(largest, first.shape[2])
        books = self.trained(blocks, Codebooks(first.astype(kind), kind))
        return blocks.mapInArrow(partial(encoded, books=books), schema).withColumn("error", F.col("error").try_cast("decimal(38,0)")), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over equal labels, nulls together.

    Sums are made by label and slot, then by label; they go back by label and slot, so that a label that
    most rows have is spread over SLOTS keys.
    """
    placed = rows.withColumn("_slot", F.pmod(F.xxhash64("id", "code"), F.lit(SLOTS)))
    of_slot = placed.groupBy("label", "_slot").agg(F.try_sum("error").alias("e"))
    of_label = of_slot.groupBy(F.col("label").alias("l")).agg(F.try_sum("e").alias("label_error"))
    spread = of_slot.join(of_label, F.col("label").eqNullSafe(F.col("l"))).select(F.col("label").alias("l"), F.col("_slot").alias("s"), "label_error")
    return placed.join(spread, F.col("label").eqNullSafe(F.col("l")) & (F.col("_slot") == F.col("s"))).drop("l", "s", "_slot")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, block: int = BLOCK) -> DataFrame:
    """(id_col, label_col, code, error, label_error, codebooks_sha256) of each vector that is kept. Errors are
    decimal(38, 0), null where they have more digits."""
    run = VectorCodes(vectors, id_col, vector_col, label_col, parts, entries, rounds, block)
    found, books = run.result()
    rows = with_label_error(run.scratch.save(found))
    digest = F.lit(books.digest() if books else None).cast("string")
    return rows.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same in DuckDB SQL, a few tables a round."""
    usable = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    sql = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {usable}),
p AS (SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    for i in range(rounds + 1):
        sql += f""",
d{i} AS MATERIALIZED (SELECT vec_id, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM p JOIN b{i} USING (p)),
a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((d, e)) AS m FROM d{i} GROUP BY 1, 2)"""
        if i < rounds:
            sql += f""",
s{i} AS (SELECT p, m[2] AS e, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{i}),
m{i} AS (SELECT p, e, j, CAST(floor_div AS BIGINT) AS v FROM (SELECT p, e, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM s{i} GROUP BY 1, 2, 3)),
n{i} AS (SELECT p, e, list(v ORDER BY j) AS c FROM m{i} GROUP BY 1, 2),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n ON b.p = n.p AND b.e = n.e)"""
    return f"""{sql},
o AS (SELECT vec_id, string_agg(lower(printf('%02x', m[2])), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN o USING (vec_id), h"""
