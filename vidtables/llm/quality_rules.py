"""Quality rules as a short-circuit cascade, with built-in functions only.

measures() computes, for each whole text, the counts that rules need. A text fails at once
with fewer than 50 words, or if more than half of its words stand in 3-word windows that the
text holds twice or more. Texts that pass go through the cascade: each rule's cost (CPU seconds
of executors) and selectivity (share rejected of the rows that earlier rules let pass) are estimated on
a bounded sample, and rules are tried in the order of rejection per cost; a row that one rule
rejects isn't tried by the next.
The order decides only how much work there is: a row is kept if no rule rejects it.

Definitions: words are runs other than ASCII white space. Null and empty texts have no words
and fail. Repeated rows are judged alike; ids may be null. n_repeat_words counts each word
once, however many repeated windows hold it; windows are told apart by a 64-bit hash within
their text. Extra columns are left out by judge() and kept by keep_good().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rejects rows for which `rejects` is true; it reads the measures and `_text`."""

    name: str
    rejects: str


RULES = [
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 15 * n_words or word_chars < 2 * n_words"),
    Rule("exclamations", "5 * (length(_text) - length(replace(_text, '!', ''))) > n_words"),
    Rule("capitals", "4 * length(regexp_replace(_text, '[^A-Z]+', '')) > word_chars"),
]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(windows: Column) -> Column:
    """Words in windows that are found twice or more, given the hashes of all 3-word windows in order."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull())
        return F.array_sort(again)

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate(_let(placed, places), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(F.col("_text"), F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))
    kept_lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        first = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
        windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(first, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _let(windows, _repeated).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    out = docs.select(F.col(id_col), text.alias("_text"))
    out = out.select(id_col, "_text", _let(words, of_words).alias("_w"), _let(kept_lines, of_lines).alias("_l"), F.length(F.regexp_replace("_text", f"[^{SYMBOLS[1:-1]}]+", "")).cast("long").alias("n_symbols"))
    out = out.select(id_col, "_text", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def cascade(rejects: dict[str, list[bool]], cost: dict[str, float]) -> list[str]:
    """Names of rules by rejection per cost: each is the best one for the sample rows that those before it let pass."""
    left, order = set(range(len(next(iter(rejects.values()), [])))), []
    while len(order) < len(rejects):
        share = {name: sum(said[i] for i in left) / max(len(left), 1) for name, said in rejects.items() if name not in order}
        best = min(share, key=lambda name: (-share[name] / max(cost[name], 1e-12), cost[name], name))
        order.append(best)
        left = {i for i in left if not rejects[best][i]}
    return order


def cpu_seconds(spark: SparkSession, job: Callable[[], object]) -> float:
    """CPU seconds of all tasks of a job, whatever else the machine does meanwhile."""
    group = f"quality-rules-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "costs of quality rules")
    try:
        job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9


def costs(some: DataFrame, rules: list[Rule], least: float = 0.2, times: int = 20) -> dict[str, float]:
    """CPU seconds of executors that each rule takes for all rows of some, less those of a rule which does nothing.
    All rules are evaluated equally often on each row: so often that the dearest one takes `least` seconds at least."""
    spark = some.sparkSession

    def seconds(rejects: str, times: int) -> float:
        again = some.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        asked = again.agg(F.count_if(F.expr(rejects) & (F.col("_again") > 0)))
        return cpu_seconds(spark, asked.first)

    for _ in range(4):
        nothing = seconds("n_words < 0", times)
        found = {rule.name: max(seconds(rule.rejects, times) - nothing, 0.0) for rule in rules}
        dearest = max(found.values(), default=least)
        if dearest >= least:
            break
        times *= min(50, max(2, round(1.5 * least / max(dearest, 1e-3))))
    return {name: max(x, 1e-3 * least) / times for name, x in found.items()}


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", sample: int = 500, one_in: int = 20) -> list[Rule]:
    """Rules in the cascade's order, estimated on at most sample rows that pass the base test: the first of one in `one_in` at random,
    filled up with the table's first rows where that gives too few."""
    picked = docs.select(F.lit(0).alias("_id"), F.col(text_col))
    picked = picked.sample(1 / one_in, seed=7).limit(sample).union(picked.limit(sample)).limit(sample)
    some = measures(picked, "_id", text_col).where("not base_failed").repartition(1).cache()
    try:
        said = some.select(*[F.coalesce(F.expr(rule.rejects), F.lit(False)).alias(rule.name) for rule in rules]).collect()  # at most sample rows
        order = cascade({rule.name: [row[rule.name] for row in said] for rule in rules}, costs(some, rules))
    finally:
        some.unpersist()
    return sorted(rules, key=lambda rule: order.index(rule.name))


def kept(rules: list[Rule]) -> Column:
    """The cascade: later conditions are evaluated only for rows that earlier ones let pass."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        out = out.when(F.expr(rule.rejects), False)
    return out.otherwise(True)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row."""
    ordered = order_rules(docs, rules, text_col)
    out = measures(docs, id_col, text_col).withColumn("kept", kept(ordered))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Rows of docs, with all columns, that the rules keep."""
    ordered = order_rules(docs, rules, text_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_body"))
    return measures(whole, "_row", "_body").where(kept(ordered)).select("_row.*")


ORACLE = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
m AS (SELECT *, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM w),
x AS (SELECT doc_id, unnest(range(0, len(words) - 2)) AS i, words FROM m WHERE len(words) > 2),
y AS (SELECT doc_id, i, words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] AS g FROM x),
z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM y),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM z WHERE c > 1) GROUP BY 1),
b AS (SELECT m.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words
  OR 5 * (length(t) - length(replace(t, '!', ''))) > n_words OR 4 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > word_chars) AS kept FROM f
"""
