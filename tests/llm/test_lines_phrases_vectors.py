"""Line dedup, collocations and vector codes: brute force, SQL on small tables, odd rows, hot keys, any number of blocks."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracles import differences
from pyspark.sql import functions as F

from vidtables.llm import collocations, line_dedup, queries, vector_codes
from vidtables.llm.scratch import settings

SF = "/root/testdata/sf0.001"
CLASH = "line string, key string, h int, slot int, row string, pos int, id string, _key int, dropped int, lang string, phrase string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_collocations", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ([], [], 0)


# lines


def line_rows():
    rng = random.Random(3)
    shared = [f"This line number {k} is long enough to be shared — by many documents" for k in range(6)]
    rows = []
    for i in range(60):
        lines = [f"own line {i} {rng.random()}" for _ in range(rng.randrange(4))]
        for k, s in enumerate(shared):
            if i % (k + 1) == 0:
                lines += [rng.choice([s, s.upper().replace("Ü", "ü"), f" \t{s}\r", s + "\x0b"])] * rng.choice([1, 1, 2])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, shared[0]), (103, shared[0]), (103, shared[0] + "\nand more of the same id"), (None, shared[0]), (104, "É" * 40), (105, "é" * 40), (106, " ".join(shared) * 2000)]
    rows += [(110 + i, "x" * 39 + "\n" + "y" * 40 + "\n" + " " + "z" * 39) for i in range(5)]
    rows += [(120 + i, "w" * 40) for i in range(4)] + [(123, "W" * 40)]
    return rows


def brute_lines(rows, length=40, documents=5):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= length:
                held[key(line)].add(i)
    keeper = {k: max(ids) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("hot_cells", [4096, 3, 1 << 30])
def test_lines_equal_brute_force(spark, monkeypatch, hot_cells):
    """With all, some or none of the digests cut into slots."""
    monkeypatch.setattr(line_dedup, "HOT_CELLS", hot_cells if hot_cells < 1 << 30 else 0)
    rows = line_rows()
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"doc_id long, text string, {CLASH}").repartition(5)
    got = line_dedup.deduplicated(docs)
    assert got.columns == [*docs.columns, "_lines"]
    assert in_order((r.doc_id, r._lines.n_lines, r._lines.n_dropped, r._lines.kept) for r in got.collect()) == in_order(brute_lines(rows))


def test_keep_bitmaps(spark):
    rows = line_rows()
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {(i, hashlib.md5((t or "").encode()).hexdigest().upper()): (t or "").split("\n") for i, t in rows}
    kept = [(r.doc_id, r.n_lines, r.n_dropped, "\n".join(x for run in r.keep for x in texts[r.doc_id, r.text_md5][run.start : run.start + run.n])) for r in got.collect()]
    assert in_order(kept) == in_order(brute_lines(rows))
    assert all(run.n > 0 for r in got.collect() for run in r.keep)


def test_lines_of_empty_tables_and_other_ids(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "a line of more than forty characters, really long"
    rows = [(c, line) for c in "abcdef"]
    got = {r.name: r._lines.kept for r in line_dedup.deduplicated(spark.createDataFrame(rows, "name string, body string"), "name", "body").collect()}
    assert got == {c: line if c == "f" else "" for c in "abcdef"}


# phrases


def phrase_rows():
    rng = random.Random(4)
    words = ["New", "york", "city", "of", "the", "état", "x#1", "日本", "a"]
    rows = [(" ".join(rng.choices(words, [9, 9, 5, 3, 3, 1, 1, 1, 2], k=rng.randrange(40))).replace(" a ", rng.choice([", ", "\n", "  ", " \t", ". "])), rng.choice(["en", "de", None, "und"])) for _ in range(300)]
    rows += [("new york city " * 3000, "en"), ("one,two;three:four!five?six\x0bseven\x0ceight\rnine" * 5, "en"), (None, "en"), ("", None), ("  \t ", "de"), ("word", "fr")]
    return rows + rows[:20]


def brute_phrases(rows, least=10, most=3, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in candidates.items():
        if 100 * inside.get((lang, w), -1) >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("block", "cells", "words", "top"), [(4 << 20, 1 << 27, 3, 2000), (1 << 10, 1 << 15, 3, 7), (1 << 13, 1 << 15, 4, 2000)])
def test_phrases_equal_brute_force(spark, block, cells, words, top):
    """Blocks of any size, and bitmaps in which many phrases share bits, give the same."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, f int, phrase string").repartition(4)
    got = collocations.collocations(docs, words=words, top=top, block=block, cells=cells).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, most=words, top=top)


def test_long_texts_are_cut_between_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "wort, ", "é.", "x" * 50 + " "]) for _ in range(3000))
    parts = list(collocations.pieces_of(pa.scalar(text), 1 << 10))
    assert b"".join(p.tobytes() for p in parts) == text.encode() and len(parts) > 10
    assert all(chr(p[-1]) in ".,;:!?\n" for p in parts[:-1])
    assert len(list(collocations.pieces_of(pa.scalar("word " * 90000), 1 << 10))) == 1


def test_lists_come_back_as_they_were():
    lists = [[0, 5, 9], [3], [1, 70000, 1 << 20]]
    lengths = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    assert collocations.unsqueezed(collocations.squeezed(flat, np.array([0, 3, 4])), lengths).tolist() == flat.tolist()


def test_a_task_counts_few_blocks(spark):
    docs = spark.createDataFrame([(t, lang) for t, lang in phrase_rows()], "text string, lang string").coalesce(1)
    lists = collocations.Collocations(docs, block=1 << 9).lists
    held = [r["count"] for r in lists.groupBy(F.input_file_name()).count().collect()]
    assert max(held) <= collocations.TOGETHER and len(held) > 4
    with settings(spark, {"spark.sql.files.maxPartitionBytes": collocations.A_FILE}):
        assert lists.groupBy(F.spark_partition_id()).count().count() == len(held)


def test_phrases_of_empty_tables(spark):
    for rows in ([], [(None, None)], [("a b c", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


# vectors


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Plain Python over (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p, nearest(p, x)[1]].append(x)
        for (p, e), found in groups.items():
            books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, sums = [], Counter()
    for i, v, label in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        sums[label] += sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return sorted((i, code, error, sums[label], digest) for i, code, error, label in out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 2.0**45, 1e25])
def test_vectors_equal_brute_force(spark, scale):
    """32-bit, 64-bit and unbounded integers; small blocks; negative means; repeated vectors and labels without value."""
    rng = random.Random(2)
    base = [[rng.gauss(-0.2, 1) * scale for _ in range(8)] for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else [rng.gauss(0, 1) * scale for _ in range(8)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [1.0] * 7 + [math.nan], 1), (203, [math.inf] * 8, 1), (204, [], 1), (205, [0.0] * 8, None), (206, [0.0] * 8, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, error int, v string").repartition(3)
    got = vector_codes.compressed(df, entries=12, block=16).collect()
    expected = brute_codes(rows, entries=12)
    if scale < 1e20:
        assert sorted((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in got) == expected
    else:  # errors beyond 38 digits
        assert sorted((r.vec_id, r.code, r.codebooks_sha256) for r in got) == [(i, code, digest) for i, code, _, _, digest in expected] and any(r.error is None for r in got)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, None, "a"), (2, [1.0, 2.0], None)], schema)).count() == 0
    rows = [(None, [1.0, 2.0, 3.0, 4.0], "a"), (7, [1.0, 2.0, 3.0, 5.0], None), (8, [1.0] * 8, "b"), (9, [2.0] * 3, "b"), (10, [1.0, 2.0, 3.0, 5.0], None)]
    got = vector_codes.compressed(spark.createDataFrame(rows, schema), rounds=0).collect()
    assert {(r.vec_id, r.code, int(r.error), int(r.label_error)) for r in got} == {(None, "00000000", 1 << 20, 1 << 20), (7, "00000000", 0, 0), (10, "00000000", 0, 0)}
    only = vector_codes.compressed(spark.createDataFrame([(None, [1.0] * 4, None)] * 3, schema)).collect()
    assert [(r.vec_id, r.code, int(r.error)) for r in only] == [(None, "00000000", 0)] * 3


def test_a_label_of_most_rows_is_summed_by_slots(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 2, 1).alias("label"), F.lit("00").alias("code"), F.col("id").cast("decimal(38,0)").alias("error"))
    got = vector_codes.with_label_error(rows)
    sums = {r.label: (r["n"], r["s"]) for r in got.groupBy("label").agg(F.count("*").alias("n"), F.max("label_error").cast("long").alias("s")).collect()}
    assert sums == {1: (2100, sum(i for i in range(3000) if i % 10 > 2)), None: (900, sum(i for i in range(3000) if i % 10 <= 2))}
