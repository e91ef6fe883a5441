"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets integer percentages (``RULES``) such as the share of
symbol characters. A rule rejects a document whose percentage reaches the
rule's cutoff in the document's stratum. Cutoffs come from labelled rows:

* per stratum and rule, the good labelled rows at or above each possible
  cutoff are counted, from one small histogram;
* a cutoff is certified if the exact binomial test rejects "the rule removes a
  share of at least ``alpha / rules`` of good rows" at level
  ``delta / (strata * rules)`` (Bonferroni over strata and rules). Cutoffs are
  tested from the most lenient on and testing stops at the first failure, so
  the sequence costs no further correction;
* of the certified cutoffs the one that removes most low-quality labelled rows
  is used, the most lenient of equals; a rule that removes none stays off.

With probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents to the rules. A stratum with too few labels certifies nothing, and
its documents are kept.

Defined results: a null text has no words and fails the base rule; a null
stratum is a stratum of its own; null labels are left out; a document labelled
more than once counts as good if any label says so; repeated rows are
measured row by row, but a labelled id is one trial however often it occurs
(of different rows, the one last by stratum and percentages counts); texts of
any length are measured whole; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, OWN, Scratch, words_of

#: Percentage of each rule, as (numerator, denominator) of measured counts.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?:;=~^_\\{}\[\]]"
WINDOW = 8
#: Strata up to this number are broadcast with their cutoffs (5 ints a row).
BROADCAST_STRATA = 10_000


def _pairs(hashes: str, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places on."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + apart)))


def _repeat_words(df: DataFrame, words: str, out: str, window: int) -> DataFrame:
    """Adds the number of words inside windows that occur more than once.

    Window hashes are built by doubling (1, 2, 4, 8 words); documents without
    an equal pair stop there. For the rest, hashes sorted with their positions
    put equal windows side by side, so the work is n log n for any text.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    h, step = f"{OWN}h", 1
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    while step < window:
        prev, h, s = h, f"{OWN}h{2 * step}", step
        df = df.withColumn(h, _pairs(prev, s)).drop(prev)
        step *= 2
    ranked, places = f"{OWN}ranked", f"{OWN}places"
    df = df.withColumn(ranked, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = lambda k: F.get(ranked, k)["h"]
    twice = F.filter(ranked, lambda x, k: (F.when(k > 0, near(k - 1)) == x["h"]) | (near(k + 1) == x["h"]))
    df = df.withColumn(places, F.array_sort(F.transform(twice, lambda x: x["i"]))).drop(ranked, h)
    gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
    return df.withColumn(out, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop(places)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", window: int = WINDOW, carry: str | None = None) -> DataFrame:
    """One row per input row: id, stratum and the counts that the rules use.

    Other input columns are dropped, so their names cannot clash; with
    ``carry`` they stay in a struct of that name.
    """
    text, words, lines = f"{OWN}text", f"{OWN}words", f"{OWN}lines"
    extra = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(carry)] if carry else []
    df = docs.select(*extra, F.col(id_col).alias(f"{OWN}id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias(f"{OWN}stratum"), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    df = df.withColumns({words: words_of(F.col(text)), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))})
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    df = df.select(
        *([carry] if carry else []), f"{OWN}id", f"{OWN}stratum", words,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), count(MARKS).alias("n_marks"), count("[A-Z]").alias("n_capitals"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    return _repeat_words(df, words, "n_repeat_words", window).drop(words)


def _percent(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.least(F.lit(100), F.floor(F.lit(100) * F.col(part) / F.col(whole)))).otherwise(0).cast("int")


def _at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed in logarithms; 1 from the mean on."""
    log0 = n * F.ln(F.lit(1 - p))
    start = F.struct(log0.alias("t"), log0.alias("s"))

    def add(a, j):
        t = a["t"] + F.ln((n - j + 1) / j) + F.ln(F.lit(p / (1 - p)))
        high, low = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(summed["s"]))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs: one row per stratum, one nullable int column per rule.

    ``measured`` comes from ``measure``. All labelled rows are used.
    """
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias(f"{OWN}id")).agg(F.max(F.col(label_col).cast("int")).alias("good"))
    # One trial a labelled id: rows that repeat it are not independent.
    once = measured.join(label, f"{OWN}id").groupBy(f"{OWN}id").agg(F.max(F.struct(f"{OWN}stratum", "good", *(_percent(r).alias(r) for r in RULES))).alias("row")).select("row.*")
    bins = once.select(f"{OWN}stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES))).alias("x"))
    hist = bins.groupBy(f"{OWN}stratum", "x.rule", "x.bin").agg(F.sum((F.col("good") > 0).cast("long")).alias("good"), F.sum((F.col("good") <= 0).cast("long")).alias("bad"))
    # From here on there are at most 101 rows per stratum and rule.
    key = Window.partitionBy(f"{OWN}stratum", "rule")
    lenient_first = key.orderBy(F.desc("bin"))
    n_strata = hist.agg(F.countDistinct(f"{OWN}stratum").alias("strata"))
    tried = hist.withColumns({"n": F.sum("good").over(key), "k": F.sum("good").over(lenient_first), "caught": F.sum("bad").over(lenient_first)}).where("bin > 0")
    tried = tried.withColumn("p", _at_most(F.col("k"), F.col("n"), alpha / len(RULES)))
    tried = tried.withColumn("worst", F.max("p").over(lenient_first)).crossJoin(F.broadcast(n_strata))
    passed = tried.where((F.col("worst") <= F.lit(delta / len(RULES)) / F.col("strata")) & (F.col("caught") > 0))
    best = passed.groupBy(f"{OWN}stratum", "rule").agg(F.max_by("bin", F.struct("caught", "bin")).alias("cutoff"))
    return best.groupBy(f"{OWN}stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def _judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    small = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    named = cutoffs.select(F.col(f"{OWN}stratum"), *(F.col(r).alias(f"{OWN}{r}") for r in RULES))
    df = measured.join(F.broadcast(named) if small else named, f"{OWN}stratum", "left")
    failed = F.array_compact(F.array(*(F.when(_percent(r) >= F.col(f"{OWN}{r}"), F.lit(r)) for r in RULES)))
    df = df.withColumns({"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")), "rules_failed": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("rules_failed") == 0))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, label_col: str, alpha: float, delta: float) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(measure(docs, id_col, text_col, stratum_col), "measured")
    return measured, scratch.save(fit_cutoffs(measured, labels, id_col, label_col, alpha, delta), "cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``rules_failed``, ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of words in repeated
    windows. ``kept`` is false for those and for documents that reach a
    certified cutoff.
    """
    df = _judged(*_fitted(docs, labels, id_col, text_col, stratum_col, label_col, alpha, delta))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(F.col(f"{OWN}id").alias(id_col), *counts, "base_failed", "kept", "rules_failed")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns.

    Rows are measured a second time instead of joining verdicts to texts, so
    no text is shuffled and repeated or null ids need no care.
    """
    _, cutoffs = _fitted(docs, labels, id_col, text_col, stratum_col, label_col, alpha, delta)
    row = f"{OWN}row"
    measured = measure(docs, id_col, text_col, stratum_col, carry=row)
    counts = [c for c in measured.columns if not c.startswith(OWN)]
    # The generator keeps the filter on the verdict above the counts; pushed
    # below, it would evaluate their nested expressions again for each use.
    measured = measured.select(row, f"{OWN}stratum", F.inline(F.array(F.struct(*counts))))
    return _judged(measured, cutoffs).where("kept").select(*(F.col(row)[c].alias(c) for c in docs.columns))
