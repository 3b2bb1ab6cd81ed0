"""Lines that many documents share, with built-in functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least `length` code points found in at least `documents` documents lose all their lines except
those in the largest document id that holds the key.

1. Each long enough line becomes a posting: 128-bit digest of the key, document, position. Texts
   stay where they are. Postings are written, as sampling their ranges reads them once more.
2. Postings are range-partitioned by digest, with a secondary sort by document, largest first, and
   position. In each digest's stream the first document keeps its lines; the number of documents is
   that of changes of document.
3. A digest that holds a large share of all postings would fill one range. So the digests' hashes
   are counted in CELLS cells; those of a cell with more than 1 / HOT_CELLS of all postings (so
   at most HOT_CELLS cells, which is what the driver gets) are cut into SLOTS slots by document.
   Their streams give a first document and a count for each slot, which are put together
   afterwards. This changes the work, not the result; all postings are counted.
4. The positions that are dropped go to their document as runs of kept lines, a compressed
   bitmap: a row for each document, no text.

Definitions: null and empty texts have one empty line. Rows without id count as no document and
keep all their lines. Rows that share an id are one document; each loses its own lines. Lines
of other white space or of upper-case letters outside A-Z are different keys. Extra columns
are left out by keep_bitmaps() and kept by deduplicated(). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtables.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELLS = 1 << 20
HOT_CELLS = 4096
SLOTS = 256


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def bare_of(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def key_of(bare: Column) -> Column:
    """Lower-cases A-Z only; where all characters are ASCII the built-in lower() does the same and is faster."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_key(text: Column) -> Column:
    """Tells rows that share an id apart by their text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def postings(docs: DataFrame, length: int) -> DataFrame:
    """(h, cell, id, row, pos) of each line whose key has `length` code points at least; docs has id and text."""
    lines = docs.where("id is not null").select("id", row_key(F.col("text")).alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.where((F.length("line") >= length) & (F.length(bare_of(F.col("line"))) >= length))
    return lines.select(F.unhex(F.md5(key_of(bare_of(F.col("line"))))).alias("h"), "id", "row", "pos").withColumn("cell", F.pmod(F.xxhash64("h"), F.lit(CELLS)).cast("int"))


def hot_cells(posted: DataFrame) -> list[int]:
    """Cells that hold more than 1 / HOT_CELLS of all postings: at most HOT_CELLS."""
    counts, total = posted.groupBy("cell").agg(F.count("*").alias("n")), posted.count()
    return [row.cell for row in counts.where(F.col("n") * HOT_CELLS > total).select("cell").collect()]


def streams(posted: DataFrame, hot: list[int]) -> DataFrame:
    """Postings in ranges of (h, slot), by document from the largest and position, with the
    stream's first document `top` and its number of documents `n_docs`."""
    is_hot = F.col("cell").isin(hot) if hot else F.lit(False)
    placed = posted.withColumn("hot", is_hot).withColumn("slot", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")).otherwise(0))
    order = [F.col("id").desc(), "row", "pos"]
    ranged = placed.drop("cell").repartitionByRange("h", "slot").sortWithinPartitions("h", "slot", *order)
    stream = Window.partitionBy("h", "slot")
    seen = ranged.withColumn("top", F.first("id").over(stream.orderBy(F.col("id").desc()))).withColumn("nth", F.dense_rank().over(stream.orderBy(F.col("id").desc())))
    return seen.withColumn("n_docs", F.max("nth").over(stream)).drop("nth")


def dropped_lines(docs: DataFrame, length: int = 40, documents: int = 5) -> DataFrame:
    """(id, row, dropped): the sorted positions that documents lose, of documents that lose any."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    posted = scratch.save(postings(docs, length))
    found = streams(posted, hot_cells(posted)).where(F.col("hot") | ((F.col("n_docs") >= documents) & (F.col("id") < F.col("top"))))
    found = scratch.save(found)
    scratch.drop(posted)
    slots = scratch.save(found.where("hot").groupBy("h", "slot").agg(F.max("top").alias("top"), F.max("n_docs").alias("n_docs")))
    whole = slots.groupBy("h").agg(F.max("top").alias("keeper"), F.sum("n_docs").alias("total")).where(F.col("total") >= documents)
    of_slot = slots.select("h", "slot").join(whole, "h")
    shared = found.where("hot").join(of_slot, ["h", "slot"]).where("id < keeper")
    lost = found.where("not hot").select("id", "row", "pos").union(shared.select("id", "row", "pos"))
    return lost.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs (start, n) of kept lines, given the sorted dropped positions."""

    def between(places: Column) -> Column:
        starts = F.transform(F.slice(places, 1, F.size(places) - 1), lambda before, i: F.struct((before + 1).alias("start"), (F.get(places, i + 1) - before - 1).alias("n")))
        return F.filter(starts, lambda r: r["n"] > 0)

    return _let(F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int"))), between)


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines that stay, joined."""

    def left(lines: Column) -> Column:
        return F.array_join(F.flatten(F.transform(kept_runs(dropped, F.size(lines)), lambda r: F.slice(lines, r["start"] + 1, r["n"]))), "\n")

    return F.when(F.size(dropped) == 0, F.coalesce(text, F.lit(""))).otherwise(_let(lines_of(text), left))


def _with_dropped(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """docs (id_col, _key, ...) with the positions that each row loses."""
    named = lost.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "dropped")
    joined = docs.join(named, (docs[id_col] == F.col("_id")) & (docs["_key"] == F.col("_row")), "left")
    return joined.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 40, documents: int = 5) -> DataFrame:
    """(id_col, text_md5, n_lines, n_dropped, keep) of each row: keep has the runs (start, n) of lines that
    stay. text_md5 tells rows that share an id apart. No text is shuffled."""
    named = _named(docs, id_col, text_col)
    small = named.select("id", row_key(F.col("text")).alias("_key"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"))
    out = _with_dropped(small, dropped_lines(named, length, documents), "id")
    return out.select(F.col("id").alias(id_col), F.hex("_key").alias("text_md5"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), kept_runs(F.col("dropped"), F.col("n_lines")).alias("keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 40, documents: int = 5) -> DataFrame:
    """Rows of docs with the struct `_lines` (n_lines, n_dropped, kept): kept is the text of the lines that stay."""
    named = _named(docs, id_col, text_col)
    lost = dropped_lines(named, length, documents)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("id"), row_key(F.col(f"`{text_col}`")).alias("_key"))
    text, dropped = F.col("_doc").getField(text_col), F.col("dropped")
    lines = F.struct(F.size(lines_of(text)).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), kept_text(text, dropped).alias("kept"))
    return _with_dropped(whole, lost, "id").select("_doc", lines.alias("_lines")).select("_doc.*", "_lines")


ORACLE = """
WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS lost FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
