"""Toxicity of whole texts, by a bidirectional gated recurrent network with attention pooling.

The network is trained in numpy, in one task, from a bounded sample of labelled rows: at most
`positives` and `negatives` documents of each label, in the order of a hash of their id, each
of at most `longest` characters. Scoring covers every text whole: all overlapping windows of
20 words, 10 words apart; a text's score is its highest window's. Scoring is one pass without
a shuffle; labels, language, source and id are no inputs of a score.

A task holds one text at least, whatever its size, with about 40 bytes a byte of it. Null and
empty texts, and texts without words, get the score of no window. Rows that repeat
are scored alike. Labels that are null, and labels of documents that don't exist, are left
out; if an id has several labels each counts, if it has several texts the least one is learnt from. Without labels of both kinds nothing is learnt,
and all scores are nearly 0. Extra columns are left out by score() and kept by drop_toxic().
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.llm.gated_network import Network
from vidtables.llm.words import PIECE, Words, slices, utf8


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 1500, negatives: int = 2000, longest: int = 12_000
) -> Network:
    """A network trained on a bounded sample: at most positives + negatives texts of at most longest characters."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    sample = None
    for y, most in ((1, positives), (0, negatives)):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= longest)
    found = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # one row for each id and label
    model = found.select("id", "text", "y").repartition(1).mapInArrow(fit_batches, "model binary").first()
    return pickle.loads(model[0]) if model else Network()


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled network learnt from all rows (id, text, y), which are few."""
    rows = list(batches)
    network = Network()
    if rows:
        table = pa.Table.from_batches(rows).sort_by("id")
        y = table.column("y").to_numpy()
        if len(set(y.tolist())) == 2:
            network.fit(Words(*utf8(table.column("text"))), y)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], names=["model"])


def scores(column: pa.Array, network: Network) -> Iterator[tuple[int, np.ndarray]]:
    """First row and scores of slices of a text column."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, PIECE):
        yield lo, network.score_texts(Words(data, offsets, lo, hi))


def score_batches(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, found in scores(batch.column(1), network):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(found)), pa.array(found, pa.float64())], names=["id", "score"])


def clean_batches(batches: Iterator[pa.RecordBatch], network: Network, place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, found in scores(batch.column(place), network):
            yield batch.slice(lo, len(found)).filter(pa.array(found < 0.5))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row; predicted is 1 from a score of 0.5."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = picked.mapInArrow(partial(score_batches, network=network), f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all columns, that aren't predicted toxic."""
    return docs.mapInArrow(partial(clean_batches, network=network, place=docs.columns.index(text_col)), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
