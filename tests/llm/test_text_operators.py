"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P

from vidtables.llm import decontamination, gated_network, licences, ngram_join, quality_rules, sentencepiece_bpe, token_counts, toxicity
from vidtables.llm.words import Words, utf8

SCHEMA = "doc_id long, text string, id string, n int, score string, digest int, _text string, item_id int, rep int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def odd_texts():
    rng = random.Random(11)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "e", "F,", "g\n", "hh"]) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    near = []
    for t in base[:3]:
        for k in range(5):
            w = t.split(" ")
            w[(7 * k) % 60] = "changed"
            near.append(" ".join(w))
    return [None, "", "   \n\t ", "one", "One", "two words", base[0], base[0], base[0].upper(), *base, *near, "x " * 300, "y\n" * 100, "long " * 5 + base[1] * 40, "\x00 nul", "日本語 テキスト"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, "z", 1, "s", 2, "t", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[6], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(rows, k=5):
    out = {}
    for i, t in rows:
        w = words_of(t)
        out.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, percent=75):
    sets = [(i, s) for i, found in shingle_sets(rows).items() for s in found]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}, {i: {len(s) for s in found} for i, found in shingle_sets(rows).items()}


def test_words_and_hashes_do_not_depend_on_batches():
    texts = [t for t in odd_texts() if t is not None]
    whole = Words(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = Words(*utf8(pa.array([t])))
        assert len(alone.hash) == len(words_of(t))
        assert (alone.hash == whole.hash[whole.first[i] : whole.first[i + 1]]).all()
        assert (alone.shingles()[0] == whole.shingles()[0][slice(*whole.shingles()[1][i : i + 2])]).all()


def test_near_duplicates(spark, docs):
    got = ngram_join.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    comp, sizes = brute_components(rows)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == comp[r.doc_id] and r.n_shingles in sizes[r.doc_id], r


def test_large_tables_are_shuffled_in_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 1)
    held, save = [], ngram_join.Scratch.save_slices
    monkeypatch.setattr(ngram_join.Scratch, "save_slices", lambda self, slices: held.append(len(slices)) or save(self, slices))
    test_near_duplicates(spark, docs)
    assert held[:4] == [ngram_join.SLICES] * 4  # postings, shared shingles, lists, sets of the first pairs


def test_tables_that_are_not_large_go_in_one_part(spark):
    assert ngram_join.GroupedPrefixJoin.slices(spark.range(50_000)) == 1
    assert ngram_join.GroupedPrefixJoin.slices(spark.range(60_000)) == ngram_join.SLICES


def test_near_duplicates_with_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    shared = " ".join(base[:30])
    rows += [(1000 + i, shared + " " + " ".join(f"u{i}x{j}" for j in range(20 + i % 7))) for i in range(60)]
    rows += [(2000 + i, " ".join(base)) for i in range(100)]
    comp, _ = brute_components(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in got.collect()} == comp


def test_pairs_are_verified_once_in_any_order(spark):
    rows = [("a", "one two three four five six"), ("b", "one two three four five six seven"), ("c", "other words here in this text")]
    run = ngram_join.GroupedPrefixJoin(spark.createDataFrame(rows, "doc_id string, text string"))
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "a"), ("b", "a")], "rep string, gid string")
    assert sorted(map(tuple, run.verify(pairs).collect())) == [("a", "b", 2, 5), ("a", "c", 0, 4)]


def test_near_duplicates_inside_a_group(spark):
    """Two of a group link with each other and not with its leader; their prefix is the head's 3 of 11 shingles,
    once private and once with one shingle that another document has. In one cell of counts shingles are ordered by hash."""
    rng = random.Random(7)

    def some(n):
        return [f"g{rng.randrange(10**6)}" for _ in range(n)]

    def first(w):
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([" ".join(w)])], names=["id", "text"])
        return next(ngram_join.set_rows(batch, 5))[1]

    rows = []
    for at in (0, 10):
        head = next(w for w in iter(lambda: some(7), None) if int(first(w).max()) < 2**64 // 5)
        leads = lambda w: (first(w)[:3] == first(head)).all()  # noqa: E731,B023
        leader, a = (next(w for w in iter(lambda: head + some(8), None) if leads(w)) for _ in range(2))  # noqa: B023
        b = next(w for w in iter(lambda: a[:-1] + some(1), None) if leads(w))  # noqa: B023
        rows += [(at + i, " ".join(w)) for i, w in enumerate((leader, a, b), 1)]
    rows.append((19, " ".join(head[:5])))
    comp, _ = brute_components(rows)
    assert comp == {1: 1, 2: 2, 3: 2, 11: 11, 12: 12, 13: 12, 19: 19}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    for cells in (1, ngram_join.CELLS):  # by hash alone, and by counts
        assert {r.doc_id: r.component_id for r in ngram_join.GroupedPrefixJoin(docs, cells=cells).result().collect()} == comp


def test_one_of_each_keeps_columns(docs, none):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    comp, _ = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert sorted(i for i in ids if i is not None) == sorted(set(comp.values())) and ids.count(None) == 1
    assert ngram_join.near_duplicates(none).count() == 0


def weighted_jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def bag(w, k=5):
    return [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)]


def test_decontamination_finds_what_brute_force_finds(spark, docs, none):
    rng = random.Random(2)
    items = [" ".join(f"i{rng.randrange(300)}" for _ in range(n)) for n in (12, 18, 30, 30, 45)] + ["tiny item", "", None]
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    rows = []
    for d in range(40):
        w = [f"d{rng.randrange(5000)}" for _ in range(rng.randrange(5, 120))]
        if d % 2:
            leak = (items[d % 5]).split()
            if d % 3 == 0:
                leak[rng.randrange(len(leak))] = "edit"
            if d % 7 == 0:
                leak = leak[: len(leak) // 2]
            at = rng.randrange(len(w))
            w[at:at] = leak
        rows.append((d, " ".join(w).upper() if d % 5 == 0 else " \n".join(w)))
    rows += [(100, "a tiny item here"), (101, items[0]), (102, None), (103, ""), (101, items[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {}
    for d, t in rows:
        w = words_of(t)
        for i, it in enumerate(items):
            v = words_of(it)
            if w and v:
                m = min(len(v), len(w))
                best = max(weighted_jaccard(bag(w[s : s + m]), bag(v)) for s in range(len(w) - m + 1))
                if best >= 0.75:
                    expected[d, i] = best
    got = decontamination.contaminated(table, bench).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    clean = decontamination.drop_contaminated(table, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in {k[0] for k in expected})
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(4)
    bench = decontamination.Benchmark(list(range(300)), [" ".join(f"a{rng.integers(50)}" for _ in range(20)) for _ in range(300)], 5, 75)
    prints = np.concatenate((bench.prints[:100] ^ (rng.random((100, 8, 16)) < 0.12).astype(np.uint16).dot(1 << np.arange(16)).astype(np.uint16), rng.integers(0, 65536, (50, 8)).astype(np.uint16)))
    apart = np.bitwise_count(prints[:, None, :] ^ bench.prints[None]).sum(2)
    assert set(zip(*(x.tolist() for x in bench.within(prints)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontamination.RADIUS)), strict=True))


def test_fingerprints_find_windows_of_all_sizes():
    """Windows with scattered changes, or changes in one place, that still link with their item."""
    rng = random.Random(6)
    for n in (5, 8, 20, 50, 150, 400):
        items = [[f"v{int(rng.paretovariate(0.7)) % 4000}" for _ in range(n)] for _ in range(40)]
        bench = decontamination.Benchmark(list(range(len(items))), [" ".join(v) for v in items], 5, 75)
        found = tried = 0
        for i, v in enumerate(items):
            for together in (False, True):
                for changes in range(max(n // 7, 1) + 1):
                    w, at = list(v), rng.randrange(n)
                    for j in range(changes):
                        w[(at + j) % n if together else rng.randrange(n)] = f"new{rng.randrange(10**6)}"
                    if weighted_jaccard(bag(w), bag(v)) >= 0.75:
                        tried += 1
                        window = Words(*utf8(pa.array([" ".join(w)]))).hash[None]
                        found += i in bench.within(decontamination.fingerprints(window))[1].tolist()
        print("words:", n, "windows found:", found, "of", tried)
        assert tried >= 40 and found >= 0.98 * tried


def test_few_windows_reach_the_index(monkeypatch):
    rng = random.Random(3)
    items = [" ".join(f"i{rng.randrange(300)}" for _ in range(n)) for n in range(15, 55)]
    bench = decontamination.Benchmark(list(range(40)), items, 5, 75)
    texts = [" ".join(f"d{rng.randrange(500)}" for _ in range(300)) for _ in range(50)]
    texts[7] += " " + items[20] + " " + " ".join(items[3].split()[:9])
    hashed = []
    own = decontamination.fingerprints
    monkeypatch.setattr(decontamination, "fingerprints", lambda words: hashed.append(len(words)) or own(words))
    found = dict(decontamination.search_rows(pa.array(texts), bench))
    assert list(found) == [7] and list(found[7]) == [20] and sum(hashed) < 40


def test_a_large_benchmark_goes_block_by_block(spark, monkeypatch):
    rng = random.Random(4)
    items = [" ".join(f"i{rng.randrange(900)}" for _ in range(20)) for _ in range(9)]
    docs = spark.createDataFrame([(i, f"some words before {t} and after") for i, t in enumerate(items)] + [(100, "clean " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"b{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    monkeypatch.setattr(decontamination, "BLOCK", 250)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(i, f"b{i}") for i in range(9)]
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [100]


def test_sentencepiece_equals_the_library(docs, none):
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece_bpe.vocabulary(path).library
    got = sentencepiece_bpe.encode_decode(docs, path).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert len(got) == docs.count() and all(r.matches_library for r in got)
    for r in got:
        ids = lib.encode(texts[r.doc_id][0])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_decode(none, path, full=False).count() == 0


def test_agenda_on_random_texts():
    encoder = sentencepiece_bpe.Encoder(P.path("piece_bpe_32k.model"))
    lib, rng = encoder.vocabulary.library, random.Random(9)
    texts = ["".join(rng.choice("ab  \n▁é日thequ,.\t\x00😀") for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 5000, "the" * 900, " " * 70]
    for lo in range(0, len(texts), 200):
        for t, (ids, same) in zip(texts[lo : lo + 200], encoder.encode(texts[lo : lo + 200]), strict=True):
            assert ids == lib.encode(t) and same
    v = encoder.vocabulary
    units = ["▁the", "▁quick", "brown", "▁▁▁▁x", "▁" * 20]
    assert [list(np.frombuffer(x, np.int32)) for x in v.encode_units(units)] == [v.encode_unit(u) for u in units]


def test_a_wrong_agenda_is_noticed():
    encoder = sentencepiece_bpe.Encoder(P.path("piece_bpe_32k.model"))
    v = encoder.vocabulary
    own = v.encode_units
    encoder.vocabulary = type("Wrong", (), {"__getattr__": lambda s, k: getattr(v, k), "encode_units": lambda s, u: [x + x for x in own(u)]})()
    [(ids, same)] = encoder.encode(["hello world"])
    assert ids == v.library.encode("hello world") and not same


def test_quality_measures(docs, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id][0]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(r.doc_id) for r in got if r.kept)


def test_the_cascade_takes_what_rejects_most_for_its_cost():
    rejects = {"a": [True] * 6 + [False] * 4, "b": [True] * 5 + [False] * 5, "c": [False] * 8 + [True, False], "d": [False] * 10}
    assert quality_rules.cascade(rejects, {"a": 1, "b": 10, "c": 1, "d": 0.1}) == ["a", "c", "d", "b"]  # what b rejects is gone after a
    assert quality_rules.cascade(rejects, {"a": 10, "b": 1, "c": 1, "d": 1}) == ["b", "c", "a", "d"]
    assert quality_rules.cascade({"a": [], "b": []}, {"a": 2, "b": 1}) == ["b", "a"]


def test_rules_are_ordered_by_rejection_per_cost(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(60)) + (" !" if i % 2 else "")) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    dear = "length(sha2(concat(sha2(repeat(_text, 5), 512), _text), 512)) > 0"
    rules = [quality_rules.Rule("dear", f"{dear} and contains(_text, '!')"), quality_rules.Rule("never", "contains(_text, '@')"), quality_rules.Rule("cheap", "contains(_text, '!')"), quality_rules.Rule("dear_never", f"{dear} and contains(_text, '@')")]
    order = [r.name for r in quality_rules.order_rules(table, rules)]
    assert order[0] == "cheap" and set(order) == {r.name for r in rules}
    some = quality_rules.measures(table)
    cost = quality_rules.costs(some.cache(), rules)
    assert cost["dear"] > 3 * cost["cheap"] and cost["dear_never"] > 3 * cost["never"]


def test_licences(spark, none):
    mit = licences.KNOWN["MIT"]
    rows = [(1, f"Copyright (c) 2020 Someone\n\n{mit}"), (2, mit.upper().replace(",", " ,")), (3, "some text\nlicenced under the apache licence, version 2.0\nmore"), (4, None), (5, ""), (6, "Copyright 2020 A\n"), (7, mit[:-10]), (1, mit)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, license string, text_digest string")
    got = licences.scan(df).collect()
    assert sorted((r.doc_id, r.license or "", r.notices) for r in got) == sorted([(1, "MIT", ""), (1, "MIT", ""), (2, "MIT", ""), (3, "", "Apache-2.0-notice"), (4, "", ""), (5, "", ""), (6, "", ""), (7, "", "")])
    assert len({r.text_digest for r in got if r.doc_id in (1, 2)}) == 1
    assert licences.scan(none).count() == 0


def test_licences_from_a_table_of_any_size(spark, docs):
    """Every known text is found whole and as lines, by the plan's table and by joins alike."""
    rows = [(i, f"Copyright {i} x\n" + text.upper()) for i, text in enumerate(licences.KNOWN.values())]
    rows += [(100 + i, f"code\n{text}\nmore code") for i, text in enumerate(licences.KNOWN.values())] + [(200, None), (201, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(list(licences.KNOWN.items()), "license string, known_text string")
    many = licences.KNOWN | {f"own {i}": f"licence number {i} of many" for i in range(licences.MANY + 1)}
    plain = sorted(map(str, licences.scan(df).collect()))
    assert sorted(map(str, licences.scan(df, table).collect())) == sorted(map(str, licences.scan(df, many).collect())) == plain
    found = {r.doc_id: (r.license, r.notices) for r in licences.scan(df).collect()}
    for i, name in enumerate(licences.KNOWN):
        assert found[i][0] == name and (found[100 + i][1] == name or "\n" in licences.KNOWN[name])
    assert licences.scan(docs, table).count() == docs.count()


def test_token_counts(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    n = sorted(r.n_tokens for r in token_counts.lengths(docs, path, P.PATTERN).collect())
    encoding = token_counts.encoding(path, P.PATTERN)
    assert n == sorted(len(encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    hist = token_counts.histogram(token_counts.lengths(docs, path, P.PATTERN))
    table = token_counts.limits(hist)
    for r in table.collect():
        assert (r.n_docs, r.docs_longer, r.docs_upto) == (n.count(r.n_tokens), sum(x > r.n_tokens for x in n), sum(x <= r.n_tokens for x in n))
        assert (r.tokens, r.tokens_longer, r.tokens_kept) == (n.count(r.n_tokens) * r.n_tokens, sum(x for x in n if x > r.n_tokens), sum(min(x, r.n_tokens) for x in n))
    assert table.count() == len(set(n))
    assert token_counts.truncated_total(hist, 77).first().tokens_kept == sum(min(x, 77) for x in n)
    assert token_counts.quantile_length(table, 0.5).first().n_tokens == n[(len(n) + 1) // 2 - 1]
    empty = token_counts.histogram(token_counts.lengths(none, path, P.PATTERN))
    assert token_counts.limits(empty).count() == 0


def test_gradient_of_the_network():
    net = gated_network.Network()
    w = Words(*utf8(pa.array(["some words of a text " * 3, "other words, fewer"])))
    lex = gated_network.Lexicon(w)
    at, n, y = np.array([0, 2, 15]), np.array([13, 5, 3]), np.array([1.0, 0.0, 1.0])
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}

    def loss():
        z = net.logits(lex, at, n).astype(np.float64)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for k, g in net.gradient(lex, at, n, y).items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        held, step = net.p[k][i], 1e-2
        net.p[k][i] = held + step
        up = loss()
        net.p[k][i] = held - step
        down = loss()
        net.p[k][i] = held
        assert abs(g[i] - (up - down) / (2 * step)) < 0.05 * abs(g[i]) + 1e-4, k


def toxic_table(spark):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        w = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(5, 70))]
        y = i % 4 == 0
        if y:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), "vile" + rng.choice(["a", "os", "ung", "x"]))
        rows.append((i, " ".join(w), int(y)))
    docs = spark.createDataFrame([(i, t, "z", 1.0) for i, t, _ in rows], "doc_id long, text string, id string, score double")
    return rows, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_toxicity_learns_and_generalises(spark, docs, none):
    rows, table, labels = toxic_table(spark)
    network = toxicity.train(table, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(table, network).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    odd = toxicity.score(docs, network).collect()
    assert len(odd) == docs.count() and all(r.score is not None for r in odd)
    assert toxicity.score(none, network).count() == 0
    clean = toxicity.drop_toxic(table, network)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}
    assert [r.predicted for r in toxicity.score(table, toxicity.train(table, labels.limit(0))).collect()] == [0] * len(rows)


def test_scores_equal_a_plain_loop_over_windows():
    """Each window alone, word by word and unit by unit, with the network's parameters."""
    net = gated_network.Network()
    net.p = {k: x * 3 for k, x in net.p.items()}
    net.shift = 0.2
    texts = ["", "one", "some few words", " ".join(f"w{i % 17}" for i in range(47)), "x " * 20]
    got = net.score_texts(Words(*utf8(pa.array(texts))))
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = gated_network.HIDDEN
    for t, score in zip(texts, got, strict=True):
        best = -np.inf if t else float(net.p["b"][0])
        for at in gated_network.windows(len(t.split())) if t else ():
            vectors = []
            for word in t.split()[at : at + gated_network.WINDOW]:
                lex = gated_network.Lexicon(Words(*utf8(pa.array([word]))))
                vectors.append(np.concatenate((net.p["word"][lex.word[0]], net.p["gram"][lex.gram].mean(0))))
            states = [np.zeros(2 * h) for _ in vectors]
            for d, order, own in (("f", range(len(vectors)), slice(0, h)), ("b", range(len(vectors) - 1, -1, -1), slice(h, None))):
                s = np.zeros(h)
                for i in order:
                    x, u = vectors[i] @ net.p[f"x{d}"] + net.p[f"c{d}"], s @ net.p[f"u{d}"]
                    z, r = sig(x[:h] + u[:h]), sig(x[h : 2 * h] + u[h : 2 * h])
                    s = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * s
                    states[i][own] = s
            weight = np.exp([s @ net.p["v"] for s in states])
            best = max(best, float((weight / weight.sum()) @ np.array(states) @ net.p["w"] + net.p["b"][0]))
        assert abs(sig(best - net.shift) - score) < 1e-4


def test_windows_cover_every_word():
    for n in (0, 1, 19, 20, 21, 30, 31, 200, 205):
        starts = gated_network.windows(n)
        assert {i for s in starts for i in range(s, min(s + gated_network.WINDOW, n))} == set(range(n))
