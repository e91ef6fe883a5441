"""Filter interaction audit: what every order of five filters removes, step by step.

Each document gets five failure flags once. They are counted by part and flags
(at most 32 rows a part), and SQL CUBE over part and flags gives, in the
grouping-set rows whose selected flags are all false, the survivors of every
subset of filters. A step of an order takes a subset to the same one with its
filter added, so each step is a join of two subsets; nothing is recounted for
an order.

Copies (filter E) are found without gathering a group: the smallest id of each
text is a partial aggregate, and a row is the first of its text if (text, id)
is in that table, a join key that spreads a large group of copies over its ids.

Defined results: a null text is empty, a null part is the empty string; a row
with a null id has no smaller id than its own, is no copy and has no labels;
rows that share the smallest id of a text are all no copies; repeated rows count
each; repeated labels count as one that has the value if any has it; parts
without any failure get rows of zeros; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words_of

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failure_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest of the text and the flags of filters A to D of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    counted = rows.select("id", "part", "text", words_of(F.col("text")).alias("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return counted.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *(flag.alias(k) for k, flag in flags.items()))


def flag_counts(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, A to E, n, good, toxic: how many rows fail exactly those filters."""
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.save(failure_flags(docs, **columns), "flags")
    with_id = rows.where("id is not null")
    first = with_id.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = with_id.join(first, ["digest", "id"], "left").join(known, "id", "left").withColumn("E", F.col("first").isNull())
    nameless = rows.where("id is null").withColumns({"E": F.lit(False), "good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    columns = ["part", *FILTERS, "good", "toxic"]
    every = marked.select(*columns).union(nameless.select(*columns))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS[1:]]
    return every.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), *sums)


def subset_survivors(counts: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows that pass every filter of the subset, for all 32 subsets of every part."""
    counts = counts.select("part", *FILTERS, *COUNTS)
    cube = counts.cube("part", *FILTERS).agg(F.grouping("part").alias("all_parts"), *(F.grouping(k).alias(f"not_{k}") for k in FILTERS), *(F.sum(c).alias(c) for c in COUNTS))
    chosen = reduce(lambda a, b: a & b, ((F.col(f"not_{k}") == 1) | ~F.col(k) for k in FILTERS))
    mask = reduce(lambda a, b: a + b, ((1 - F.col(f"not_{k}")) * (1 << i) for i, k in enumerate(FILTERS))).cast("int")
    passed = cube.where((F.col("all_parts") == 0) & chosen).select("part", mask.alias("mask"), *COUNTS)
    every = counts.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    return every.join(passed, ["part", "mask"], "left").select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))


def subset_pairs(survivors: DataFrame) -> DataFrame:
    """part, letter, mask: what the filter removes from the survivors of a subset without it."""
    before = survivors.select("part", "mask", *(F.col(c).alias(f"{c}_before") for c in COUNTS), F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("place"))
    before = before.withColumn("bit", F.expr("shiftleft(1, place)")).where(F.col("mask").bitwiseAND(F.col("bit")) == 0)
    after = survivors.select("part", F.col("mask").alias("with_it"), *COUNTS)
    pairs = before.withColumn("with_it", F.col("mask") + F.col("bit")).join(after, ["part", "with_it"])
    return pairs.select("part", F.substring(F.lit(FILTERS), F.col("place") + 1, F.lit(1)).alias("letter"), "mask", F.col("n").alias("kept"), *((F.col(f"{c}_before") - F.col(c)).alias(f"{c}_gone") for c in COUNTS))


def order_steps() -> list[tuple[str, int, str, int]]:
    """(order, step, letter, mask of the filters before) of all orders."""
    orders = ["".join(order) for order in permutations(FILTERS)]
    return [(order, i + 1, letter, sum(1 << FILTERS.index(x) for x in order[:i])) for order in orders for i, letter in enumerate(order)]


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order and step, with counts of rows; see the module.

    ``removed`` by this step of ``kept`` + removed; ``redundant``: failing its filter, but
    removed before; ``unique_fails``: failing its filter only; ``good_lost`` and
    ``toxic_lost``: of the removed, by label; ``shapley``: removed by its filter,
    summed over all orders.
    """
    spark, last = docs.sparkSession, (1 << len(FILTERS)) - 1
    scratch = Scratch(spark, "audit-counts")
    pairs = scratch.save(subset_pairs(subset_survivors(scratch.save(flag_counts(docs, labels, **columns), "counts"))), "pairs")
    # A subset stands before its filter in |subset|! * |others|! orders.
    weights = F.array(*(F.lit(factorial(n) * factorial(len(FILTERS) - 1 - n)) for n in range(len(FILTERS))))
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', letter) - 1)")
    totals = pairs.groupBy("part", "letter").agg(
        F.sum(F.when(F.col("mask") == 0, F.col("n_gone"))).alias("fails"),
        F.sum(F.when(F.col("mask") + bit == last, F.col("n_gone"))).alias("unique_fails"),
        F.sum(F.col("n_gone") * F.get(weights, F.bit_count("mask"))).alias("shapley"),
    )
    steps = spark.createDataFrame(order_steps(), "filter_order string, step int, letter string, mask int")
    rows = pairs.join(F.broadcast(steps), ["letter", "mask"]).join(totals, ["part", "letter"])
    return rows.select("part", "filter_order", "step", "kept", F.col("n_gone").alias("removed"), (F.col("fails") - F.col("n_gone")).alias("redundant"), "unique_fails", F.col("good_gone").alias("good_lost"), F.col("toxic_gone").alias("toxic_lost"), "shapley")
