"""Grouped prefix join: near-duplicate documents by the Jaccard similarity of word shingles.

Each document's set of shingles is put in one order for the whole corpus: by how many documents hold
shingles of the same cell of a sketch, rare ones first, then by hash. Two sets that link must share a shingle
of their prefixes, the first n - ceil(percent * n / 100) + 1 shingles. The steps:

1. Documents with equal sets form a class; classes with identical prefixes and size a group.
2. Groups post their prefixes. Shingles that only one group posts go; classes of one group share
   all of them, so they meet by their group instead.
3. Each posting list has a pivot, one of its groups by hash. Every group is verified against
   the one of its lists' pivots that it may share most shingles with, and every class against
   its group's leader. Two more rounds try groups that aren't in a list's main component
   against up to TRIES pivots of it, and classes against one of their group's main component, so that
   large groups of near copies hang together by few pairs for each of them.
4. What is still apart is compared in full: groups of one list are expanded to their classes,
   and pairs in different components so far that pass the size, position, bitmap and count
   filters are verified. Of a list's main component only pairs with the others are made. The
   position filter takes the list's shingle for the first that a pair shares, so that a pair
   comes out of few of its lists; of two that link, the list of their first shared shingle
   makes the pair. The count filter: what the prefixes share and what lies behind them must be
   enough to link. Classes of one group that are apart are paired by the group, with the size
   and bitmap filters.

The bitmap filter bounds what two sets share: each set flips one of BITS bits for each of its
shingles, and two sets differ in at least as many shingles as their bitmaps do in bits.

Pairs inside a component that is already connected add nothing to components; all others are
compared, so no link between different texts is lost. Verification compares whole sets.

The order of shingles decides only how much work there is, never the result. Its counts come
from all documents: each task counts its shingles in CELLS cells, the tasks' counts are summed through a
tree of tables; the HOT most frequent shingles, as far as batches of them show them, come last in any case. The
cells' ranks (4 MB, whatever the input) and these shingles (2 MB) are held on every executor.

Posting lists, and the sets of pairs to verify, are shuffled in SLICES parts by hash, one after another, so that their
shuffle files take a part of the disk that they would take at once. Each row is in one part and meets all it would meet.
Tables of fewer than FEW rows go in one part: each further one costs the driver the plans and tasks of a whole table.

Definitions: words are runs other than ASCII white space, A-Z lower-cased. A document with
fewer than k words has its whole sequence as one shingle; one without words or text has an
empty set, links with nothing and is its own component. Rows that share an id count as
linked. Rows without id link with nothing and get no component. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.llm.components import components
from vidtables.llm.scratch import WHILE_WRITING, Scratch, settings
from vidtables.llm.words import Words, slices, utf8

CELLS = 1 << 20
HOT = 1 << 18
TOGETHER = 1 << 20  # shingles counted at once
BRANCHES = 16  # sketches that one task sums
ROUNDS = 3
TRIES = 8
SLICES, FEW = 4, 60_000  # parts of a large table that are shuffled one after another, and rows of one that isn't large
BITS = 512
LANES = [f"b{i}" for i in range(BITS // 64)]


def set_rows(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingles of each row of the second column."""
    data, offsets = utf8(batch.column(1))
    for lo, hi in slices(offsets):
        hashes, first = Words(data, offsets, lo, hi).shingles(k)
        for i in range(hi - lo):
            x = np.sort(hashes[first[i] : first[i + 1]])
            yield lo + i, x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x


def frequent_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles of at least 3 documents of about TOGETHER shingles, with their counts."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

    sets, held = [], 0
    for batch in batches:
        for _, x in set_rows(batch, k):
            sets.append(x)
            held += len(x)
            if held >= TOGETHER:
                yield counted(sets)
                sets, held = [], 0
    if sets:
        yield counted(sets)


def cell_of(x: np.ndarray, cells: int) -> np.ndarray:
    """The sketch's cell of each shingle; other bits than those that order by hash looks at first."""
    return (x & np.uint64(cells - 1)).astype(np.int64)


def sketch_batches(batches: Iterator[pa.RecordBatch], k: int, cells: int) -> Iterator[pa.RecordBatch]:
    """One row: how many documents' shingles a task has in each cell."""
    counts = np.zeros(cells, np.int64)
    for batch in batches:
        for _, x in set_rows(batch, k):
            np.add.at(counts, cell_of(x, cells), 1)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def added_batches(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """One row: the sum of a partition's sketches."""
    counts = np.zeros(cells, np.int64)
    for batch in batches:
        for row in batch.column(0):
            counts += np.frombuffer(row.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def signature_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int, ranks: Broadcast, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Size, digest of the set, digest of prefix and size, prefix, bitmap. ranks: the place of each cell, rarest first;
    hot: the frequent shingles, rarest first, which come behind all others."""
    by_hash = np.argsort(hot)
    sorted_hot = hot[by_hash]
    rank = np.frombuffer(ranks.value, np.int32)
    for batch in batches:
        size, digest, key, prefix, bits = [], [], [], [], np.zeros((len(batch), BITS), bool)
        for row, x in set_rows(batch, k):
            n = len(x)
            size.append(n)
            bits[row] = np.bincount((x % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
            if not n:
                digest.append(None), key.append(None), prefix.append(np.zeros(0, np.int64))
                continue
            p = n - -(-percent * n // 100) + 1
            place = rank[cell_of(x, len(rank))]
            if len(hot):
                at = np.minimum(np.searchsorted(sorted_hot, x), len(hot) - 1)
                place = np.where(sorted_hot[at] == x, len(rank) + by_hash[at], place)
            least = np.flatnonzero(place <= np.partition(place, p - 1)[p - 1])  # cells that the prefix may take shingles of
            first = x[least[np.lexsort((x[least], place[least]))[:p]]]
            digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            key.append(hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
            prefix.append(first.view(np.int64))
        ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
        lanes = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(size, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(key, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(len(LANES))),
            ],
            names=["id", "n", "digest", "key", "prefix", *LANES],
        )


def set_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Whole sets, as the bytes of sorted hashes, with the columns behind the text."""
    for batch in batches:
        rows, size = [], 0
        lo = 0
        for i, x in set_rows(batch, k):
            rows.append(x.tobytes())
            size += len(rows[-1])
            if size > 1 << 22 or i == len(batch) - 1:
                more = [c.slice(lo, len(rows)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), pa.array(rows, pa.binary()), *more], names=["id", "hashes", *batch.schema.names[2:]])
                lo, rows, size = i + 1, [], 0


def common_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles the two sets of each row share, and how many they have together, shared ones twice."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            both.sort(kind="stable")
            out.append((int(np.count_nonzero(both[1:] == both[:-1])), len(both)))
        common, total = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(z, pa.int64()) for z in (common, total))], names=["a", "b", "common", "total"])


class GroupedPrefixJoin:
    """One run over one table; result() gives a row for each row of it."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, cells: int = CELLS):
        self.spark, self.id_col, self.k, self.percent, self.cells = docs.sparkSession, id_col, k, percent, cells
        self.id_type = docs.schema[id_col].dataType.simpleString()
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.scratch = Scratch(self.spark, "ngram-join")

    def ranks(self) -> bytes:
        """The place of each cell in the order of counts, rarest first."""
        rows = self.scratch.save(self.docs.mapInArrow(partial(sketch_batches, k=self.k, cells=self.cells), "counts binary"))
        left = rows.count()
        while left > 1:
            # a tree of tables: an RDD's functions would need a second Python worker beside each task's
            left, sketches = -(-left // BRANCHES), rows
            rows = self.scratch.save(sketches.repartition(left).mapInArrow(partial(added_batches, cells=self.cells), "counts binary"))
            self.scratch.drop(sketches)
        found = rows.toArrow().column("counts")
        counts = np.frombuffer(found[0].as_buffer(), np.int64) if len(found) else np.zeros(self.cells, np.int64)
        self.scratch.drop(rows)
        out = np.empty(self.cells, np.int32)
        out[np.argsort(counts, kind="stable")] = np.arange(self.cells, dtype=np.int32)
        return out.tobytes()

    def frequent(self) -> np.ndarray:
        """The HOT most frequent shingles, rarest first; a bounded table."""
        found = self.docs.mapInArrow(partial(frequent_batches, k=self.k), "token long, n long")
        with settings(self.spark, WHILE_WRITING):
            top = found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT).toArrow()
        return top.column("token").to_numpy().view(np.uint64)[::-1].copy()

    @staticmethod
    def slices(table: DataFrame) -> int:
        return SLICES if table.count() >= FEW else 1

    def need(self, n: str, m: str) -> str:
        """The least number of shared shingles with which sets of n and m link."""
        return f"({self.percent} * ({n} + {m}) + {99 + self.percent}) div {100 + self.percent}"

    def behind(self, n: str) -> str:
        """The shingles of a set of n that lie behind its prefix."""
        return f"(({self.percent} * {n} + 99) div 100 - 1)"

    @staticmethod
    def shared_at_most(x: str, y: str) -> str:
        """What the bitmaps of x and y allow them to share."""
        apart = " + ".join(f"bit_count({x}{b} ^ {y}{b})" for b in LANES)
        return f"({x}n + {y}n - ({apart})) div 2"

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Shared shingles of each pair, as (a, b) with a < b, from the whole texts; written.

        Many pairs may have the same second one, a pivot. Their rows carry the set of the first when
        they meet it, so that their size shows how many they are and Spark splits them.
        """
        first, second = pairs.columns
        pairs = pairs.select(F.col(first).alias("tried"), F.col(second).alias("pivot"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
        pairs = self.scratch.save(pairs.dropDuplicates(["a", "b"]).select("tried", "pivot"))
        n = self.slices(pairs)
        of = f"cast(pmod(xxhash64({{}}), {n}) as int)".format  # pairs are dealt by their pivots
        roles = f"explode(array(struct(tried as id, shiftleft(1, {of('pivot')}) as tried_in, false as is_pivot), struct(pivot as id, 0 as tried_in, true as is_pivot))) as r"
        needed = pairs.select(F.expr(roles)).select("r.*").groupBy("id").agg(F.bit_or("tried_in").alias("tried_in"), F.bool_or("is_pivot").alias("is_pivot"))
        texts = self.docs.join(needed, "id").select("id", "text", "tried_in", "is_pivot")
        sets = self.scratch.save(texts.mapInArrow(partial(set_batches, k=self.k), f"id {self.id_type}, hashes binary, tried_in int, is_pivot boolean"))
        schema = f"a {self.id_type}, b {self.id_type}, common long, total long"
        slices = []
        for i in range(n):
            x = sets.where(f"tried_in & {1 << i} <> 0").select(F.col("id").alias("tried"), F.col("hashes").alias("x"))
            y = sets.where(f"is_pivot and {of('id')} = {i}").select(F.col("id").alias("pivot"), F.col("hashes").alias("y"))
            joined = pairs.where(f"{of('pivot')} = {i}").join(x, "tried").join(y, "pivot")
            joined = joined.select(F.least("tried", "pivot").alias("a"), F.greatest("tried", "pivot").alias("b"), "x", "y")
            slices.append(joined.mapInArrow(common_batches, schema))
        out = self.scratch.save_slices(slices)
        self.scratch.drop(sets), self.scratch.drop(pairs)
        return out

    def linked(self, verified: DataFrame) -> DataFrame:
        return verified.where(f"100 * common >= {self.percent} * (total - common)").select("a", "b")

    def classes(self) -> DataFrame:
        """(rep, gid, n, bitmap) of each class of equal sets."""
        first = [F.first(c).alias(c) for c in ("key", "n", *LANES)]
        found = self.sigs.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), *first)
        groups = found.groupBy("key").agg(F.min("rep").alias("gid"))
        return self.scratch.save(found.join(groups, "key"))

    def lists(self) -> DataFrame:
        """(token, gid, n, pos) of shingles that prefixes of at least two groups hold."""
        leaders = self.classes_.where("rep = gid").select("gid", "key")
        n = self.slices(self.sigs)
        slices = []
        for i in range(n):
            own, first = (x.where(f"pmod(xxhash64({c}), {n}) = {i}") for x, c in ((self.sigs, "id"), (leaders, "gid")))
            posts = own.join(first, (own.id == first.gid) & (own.key == first.key), "left_semi")
            slices.append(posts.select(F.col("id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token")))
        posts = self.scratch.save_slices(slices)
        # the shared tokens are written, so that a common one's posts meet their one row in a plain join, which Spark splits
        parts = [posts.where(f"pmod(token, {n}) = {i}") for i in range(n)]
        shared = [x.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token") for x in parts]  # a group posts a token once
        shared = self.scratch.save_slices(shared)
        out = self.scratch.save_slices([x.join(shared.where(f"pmod(token, {n}) = {i}"), "token") for i, x in enumerate(parts)])
        self.scratch.drop(posts), self.scratch.drop(shared)
        return out

    def split_groups(self, found: DataFrame) -> DataFrame:
        """Classes of groups that are in several components of found, with the main one of their group and a pivot of it."""
        comp = self.classes_.join(found, F.col("rep") == F.col("v"), "left").select("rep", "gid", "n", *LANES, F.coalesce("component", "rep").alias("comp"))
        of_comp = comp.groupBy("gid", "comp").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("rep"), "rep")).alias("p"))
        main = of_comp.groupBy("gid").agg(F.max(F.struct("c", "comp", "p")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
        return comp.join(main.select("gid", F.col("m.comp").alias("main"), F.col("m.p.rep").alias("pivot")), "gid")

    def near_pivots(self, found: DataFrame | None, done: DataFrame | None) -> DataFrame:
        """(tried, pivot): each group with the pivot that it may share most with. At first pivots are any groups, and
        classes come with their leaders; later pivots are of their list's main component, TRIES for each group, and
        only groups of other components are tried, without the pairs in done."""
        sets = self.classes_.where("rep = gid").select("gid", "n", *LANES)
        own, by_hash = F.struct("gid", "n", "comp"), F.xxhash64("token", "gid")
        if found is None:
            listed = self.lists_.withColumn("comp", F.col("gid"))
            pivots = listed.groupBy("token").agg(F.array(F.min_by(own, by_hash)).alias("ps"))
        else:
            listed = self.lists_.join(found, F.col("gid") == F.col("v"), "left").withColumn("comp", F.coalesce("component", "gid")).drop("v", "component")
            bucket = F.pmod(F.xxhash64("gid"), F.lit(TRIES)).alias("bucket")
            of_bucket = listed.groupBy("token", "comp", bucket).agg(F.count("*").alias("c"), F.min_by(own, by_hash).alias("p"))
            of_comp = of_bucket.groupBy("token", "comp").agg(F.sum("c").alias("c"), F.array_sort(F.collect_list("p")).alias("ps"))  # TRIES at most
            pivots = of_comp.groupBy("token").agg(F.max(F.struct("c", "comp", "ps")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("token", "m.ps")
        pivots = pivots.select("token", F.explode("ps").alias("p"))
        tried = listed.join(pivots, "token").where(f"comp <> p.comp and 100 * least(n, p.n) >= {self.percent} * greatest(n, p.n)")
        pairs = tried.select("gid", F.col("p.gid").alias("pivot")).distinct()
        other = sets.withColumnsRenamed({c: f"p_{c}" for c in sets.columns}).withColumnRenamed("p_gid", "pivot")
        bound = pairs.join(sets, "gid").join(other, "pivot").withColumn("most", F.expr(self.shared_at_most("", "p_"))).where(f"most >= {self.need('n', 'p_n')}")
        bound = bound.select("gid", "pivot", F.least("gid", "pivot").alias("a"), F.greatest("gid", "pivot").alias("b"), (F.col("n") + F.col("p_n") - 2 * F.col("most")).alias("apart"))
        if done is not None:
            bound = bound.join(done, ["a", "b"], "left_anti")
            inside = self.split_groups(found).where("comp <> main").select("rep", "pivot", F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).join(done, ["a", "b"], "left_anti")
        nearest = F.array_sort(F.collect_set(F.struct("apart", "a", "b", "pivot")))  # of a group's shingles and their pivots
        best = bound.groupBy("gid").agg(F.slice(nearest, 1, 1 if found is None else TRIES).alias("best")).select(F.col("gid").alias("tried"), F.explode("best.pivot").alias("pivot"))
        if found is None:
            return best.union(self.classes_.where("rep <> gid").select("rep", "gid"))
        return best.union(inside.select("rep", "pivot"))

    def left_apart(self, found: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs of classes that may link, in different components of found, without those of done."""
        comp = self.classes_.join(found, F.col("rep") == F.col("v"), "left").select("rep", "gid", *LANES, F.coalesce("component", "rep").alias("comp"))
        listed = self.lists_.join(comp, "gid")
        main = listed.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"))
        main = main.where("comps > 1").select("token", F.col("m.comp").alias("main"))
        mixed = self.scratch.save(listed.join(main, "token"))
        x, y = mixed.alias("x"), mixed.where("comp <> main").alias("y")
        need = self.need("x.n", "y.n")
        may = [
            "x.token = y.token and x.gid <> y.gid and x.comp <> y.comp and (x.comp = x.main or x.rep < y.rep)",
            f"100 * least(x.n, y.n) >= {self.percent} * greatest(x.n, y.n)",
            f"least(x.n - x.pos, y.n - y.pos) >= {need}",
            f"{self.shared_at_most('x.', 'y.')} >= {need}",
        ]
        pairs = x.join(y, F.expr(" and ".join(may))).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        split = self.scratch.save(self.split_groups(found))
        x, y = split.alias("x"), split.where("comp <> main").alias("y")
        may[0], may[2] = "x.gid = y.gid and x.comp <> y.comp and (x.comp = x.main or x.rep < y.rep)", "true"
        inside = x.join(y, F.expr(" and ".join(may))).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        out = self.scratch.save(pairs.union(inside).distinct().join(done, ["a", "b"], "left_anti"))
        self.scratch.drop(mixed), self.scratch.drop(split)
        return self.enough(out)

    def enough(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes share so much that, with what lies behind them, the sets may link."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        reps = self.classes_.select(F.col("rep").alias("id"), "key").join(needed, "id", "left_semi")
        held = self.scratch.save(self.sigs.join(reps, ["id", "key"], "left_semi").select("id", "n", "prefix"))
        x, y = (held.select(F.col("id").alias(a), F.col("n").alias(f"n{a}"), F.col("prefix").alias(f"p{a}")) for a in "ab")
        shared = "size(array_intersect(pa, pb))"
        out = self.scratch.save(pairs.join(x, "a").join(y, "b").where(f"{shared} + greatest({self.behind('na')}, {self.behind('nb')}) >= {self.need('na', 'nb')}").select("a", "b").distinct())
        self.scratch.drop(held), self.scratch.drop(pairs)
        return out

    def result(self) -> DataFrame:
        """(id, n_shingles, component_id) of each row."""
        signed = partial(signature_batches, k=self.k, percent=self.percent, ranks=self.spark.sparkContext.broadcast(self.ranks()), hot=self.frequent())
        self.sigs = self.scratch.save(self.docs.mapInArrow(signed, f"id {self.id_type}, n long, digest binary, key binary, prefix array<long>, " + ", ".join(f"{b} long" for b in LANES)))
        self.classes_ = self.classes()
        self.lists_ = self.lists()
        repeated = self.sigs.where("n > 0").groupBy("id").agg(F.count("*").alias("c")).where("c > 1 and id is not null")
        same_id = self.sigs.join(repeated, "id", "left_semi").join(self.classes_, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        found = done = None
        links = self.scratch.save(same_id)
        for _ in range(ROUNDS):
            near = self.verify(self.near_pivots(found, done))
            done = near.select("a", "b") if done is None else done.union(near.select("a", "b"))
            links = self.linked(near).union(links)
            found = components(links, self.scratch)
            links = found.select("v", "component")
        rest = self.linked(self.verify(self.left_apart(found, done)))
        found = components(rest.union(links), self.scratch)
        rows = self.sigs.select("id", "n", "digest").join(self.classes_.select("digest", "rep"), "digest", "left").join(found, F.col("rep") == F.col("v"), "left")
        own = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
        return rows.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Component of each row: the least id reachable by links, which are pairs of documents
    with 100 * shared shingles >= percent * shingles of either. Columns: id, n_shingles, component_id."""
    return GroupedPrefixJoin(docs, id_col, text_col, k, percent).result()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Rows of docs without near duplicates: the row with the least id of each component, once.
    Rows without id stay. All columns are kept."""
    found = near_duplicates(docs, id_col, text_col, k, percent)
    keep = found.where(f"component_id = `{id_col}`").select(id_col)
    held = docs.join(keep, id_col, "left_semi").dropDuplicates([id_col])
    return held.select(docs.columns).union(docs.where(F.col(id_col).isNull()))
