"""Measure tables and quality reports: histograms and cell-by-cell comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures


def histogram(df: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """Counts of a measure per image and bin; NaN goes to the first bin, as comparisons with it are false."""
    v = F.col(value)
    above = [F.when(~F.isnan(v) & (v >= b), 1).otherwise(0) for b in bounds]
    bin_ = sum(above[1:], above[0])
    return df.where(v.isNotNull()).groupBy(F.col(key).alias("image_id"), bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _keyed(report: DataFrame, name: str) -> DataFrame:
    """A report with its file names without folders as ``key``; two rows of one name are an error."""
    base = F.element_at(F.split(F.col(name), r"[/\\\\]"), -1)
    keyed = report.withColumn("key", base)
    many = F.count("*").over(Window.partitionBy("key"))
    return keyed.withColumn("key", F.when(many > 1, F.raise_error(F.concat(F.lit("duplicate file name in a report: "), F.col("key")))).otherwise(F.col("key")))


def compare(expected: DataFrame, actual: DataFrame, columns: list[str], name: str = "Filename") -> DataFrame:
    """filename, column, expected, actual: every difference of two reports.

    Rows are matched by file name without folder; a name that occurs twice in
    a report fails the job. Cells are compared as text, those of ``name`` as
    written. A row of one report only is one difference in ``name``; differing
    row counts are one in ``*`` / ``__metadata__``.
    """
    side = lambda df, s: _keyed(df, name).select("key", F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias(s))
    both = side(expected, "e").join(side(actual, "a"), "key", "full_outer")
    cell = lambda column, e, a: F.struct(F.lit(column).alias("column"), e.cast("string").alias("expected"), a.cast("string").alias("actual"))
    none = F.lit(None)
    alone = F.when(F.col("a").isNull(), F.array(cell(name, F.col("key"), none))).when(F.col("e").isNull(), F.array(cell(name, none, F.col("key"))))
    cells = F.array_compact(F.array(*(F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), cell(c, F.col(f"e.{c}"), F.col(f"a.{c}"))) for c in columns)))
    found = both.select(F.col("key").alias("filename"), F.inline(F.coalesce(alone, cells)))
    counts = both.agg(F.count("e").alias("n_e"), F.count("a").alias("n_a")).where("n_e <> n_a")
    return found.union(counts.select(F.lit("*"), F.lit("__metadata__"), F.col("n_e").cast("string"), F.col("n_a").cast("string")))


def compared_columns(expected: list[str], actual: list[str], standard: list[str], mapped: str = "QB_") -> list[str]:
    """Columns to compare: all expected ones if any is mapped, else the standard ones in expected order; missing ones are an error."""
    wanted = expected if any(c.startswith(mapped) for c in expected) else [c for c in expected if c in set(standard)]
    missing = [c for c in (wanted if wanted is expected else standard) if c not in actual or c not in expected]
    if missing:
        raise ValueError(f"the reports lack columns: {', '.join(missing)}")
    return list(wanted)


def summary(differences: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """One row: conformant, n_rows, n_columns, n_differences."""
    n = differences.agg(F.count("*").alias("n_differences"))
    return expected.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(n)).select((F.col("n_differences") == 0).alias("conformant"), "n_rows", F.lit(len(columns)).cast("long").alias("n_columns"), "n_differences")


def classes(flags: DataFrame) -> DataFrame:
    """Counts of files that match both references, one or none, per rate and (null rate) overall.

    ``flags``: rate, first, second (booleans).
    """
    a, b = F.col("first"), F.col("second")
    return flags.rollup("rate").agg(F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_first"), F.count_if(~a & b).alias("n_second"), F.count_if(~a & ~b).alias("n_neither"))


def beyond_tolerance(expected: DataFrame, actual: DataFrame, slack: float = 1e-9) -> DataFrame:
    """image_id, name, ``apart``: long measures that differ by more than the measure's tolerance."""
    other = actual.select("image_id", "name", F.col("value").alias("other"))
    both = expected.join(other.hint("merge"), ["image_id", "name"]).select("image_id", "name", F.abs(F.col("value") - F.col("other")).alias("apart"))
    return both.where(F.col("apart") > measures.tolerance(F.col("name")) + slack)


def size_tolerance(expected: DataFrame, actual: DataFrame, share: float = 0.004) -> DataFrame:
    """file, ``within``: sizes without comments differ by at most ``share`` and headers are equal.

    Both sides: file, size, header.
    """
    other = actual.select("file", F.col("size").alias("own"), F.col("header").alias("own_header"))
    return expected.join(other, "file").select("file", ((F.abs(F.col("own") - F.col("size")) <= share * F.col("size")) & F.col("header").eqNullSafe(F.col("own_header"))).alias("within"))


def histogram_features(df: DataFrame, value: str, bounds: tuple[float, ...], prefix: str, key: str = "image_id") -> DataFrame:
    """One row per image: counts of the bins, mean and population deviation; null values are left out.

    A value on a bound goes to the bin above; infinite ones keep to the first bin.
    """
    v = F.col(value)
    place = sum((F.when((v >= b) & (v < float("inf")), 1).otherwise(0) for b in bounds[1:]), F.when((v >= bounds[0]) & (v < float("inf")), 1).otherwise(0))
    counts = [F.count_if(F.col("place") == i).alias(f"{prefix}{i}") for i in range(len(bounds) + 1)]
    return df.where(v.isNotNull()).withColumn("place", place).groupBy(key).agg(*counts, F.avg(v).alias(f"{prefix}Mean"), F.stddev_pop(v).alias(f"{prefix}StdDev"))


def feature_vectors(measured: DataFrame, names: list[str]) -> DataFrame:
    """image_id, a column per name (the value of the last module that gives it) and ``missing``, the number of absent ones.

    ``measured``: image_id, name, value, module (a number).
    """
    last = lambda c: F.max_by("value", F.when(F.col("name") == c, F.col("module")))
    wide = measured.groupBy("image_id").agg(*(last(c).alias(c) for c in names))
    missing = sum((F.col(c).isNull().cast("int") for c in names[1:]), F.col(names[0]).isNull().cast("int"))
    return wide.withColumn("missing", missing)


def long_measures(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide measures as (image_id, name, value) rows; nulls stay."""
    return df.select(F.col(key).alias("image_id"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))))


def wide_measures(df: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of ``long_measures`` for a fixed list of names: one shuffle, no discovery pass."""
    return df.groupBy("image_id").agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns))


def _nodes(trees: list[dict]) -> tuple[list[int], list[tuple]]:
    """Roots and nodes (feature, threshold, left, right, class) of all trees as one table; leaves have no feature."""
    roots, nodes = [], []
    for tree in trees:
        roots.append(len(nodes))
        waiting = [(tree, None, None)]
        while waiting:
            node, parent, side = waiting.pop()
            if parent is not None:
                nodes[parent][side] = len(nodes)
            at = len(nodes)
            if "class" in node:
                nodes.append([None, 0.0, at, at, int(node["class"])])
            else:
                nodes.append([node["feature"], float(node["threshold"]), None, None, 0])
                waiting += [(node["left"], at, 2), (node["right"], at, 3)]
    return roots, [tuple(n) for n in nodes]


def forest_scores(measures: DataFrame, trees: list[dict], key: str = "image_id") -> DataFrame:
    """Like ``forest_votes`` for forests of any size: the node table goes to every task once, rows are scored in batches.

    A null feature fails the job, as a missing measure is an error. All trees
    of a batch step down together until every one is at a leaf.
    """
    roots, nodes = _nodes(trees)
    names = sorted({n[0] for n in nodes if n[0] is not None})
    held = measures.sparkSession.sparkContext.broadcast((roots, nodes))
    checked = [F.coalesce(F.col(c).cast("float"), F.raise_error(F.lit(f"missing measure {c}")).cast("float")).alias(c) for c in names]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        roots, nodes = held.value
        feature = np.array([names.index(n[0]) if n[0] is not None else -1 for n in nodes])
        threshold = np.array([n[1] for n in nodes], np.float32)
        left, right, label = (np.array([n[i] for n in nodes]) for i in (2, 3, 4))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float32)
            at = np.tile(np.array(roots), (batch.num_rows, 1))
            while (feature[at] >= 0).any():
                value = np.take_along_axis(x, feature[at].clip(0), axis=1)
                at = np.where(feature[at] < 0, at, np.where(value <= threshold[at], left[at], right[at]))
            votes = label[at].sum(1).astype(np.int64)
            score = np.floor(votes / len(roots) * 100 + 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(votes), pa.array(score)], names=[key, "votes", "score"])

    kind = measures.schema[key].dataType.simpleString()
    return measures.select(key, *checked).mapInArrow(run, f"{key} {kind}, votes bigint, score bigint")


def forest_votes(measures: DataFrame, trees: list[dict], key: str = "image_id") -> DataFrame:
    """Share of trees that vote for class 1, and the rounded score, for small forests.

    A tree is a leaf ``{"class": c}`` or ``{"feature", "threshold", "left",
    "right"}``; values up to the threshold go left. Each tree becomes one
    nested conditional, so a row is scored without a join.
    """

    def vote(node: dict):
        if "class" in node:
            return F.lit(int(node["class"]))
        return F.when(F.col(node["feature"]).cast("float") <= F.lit(node["threshold"]).cast("float"), vote(node["left"])).otherwise(vote(node["right"]))

    votes = sum((vote(t) for t in trees[1:]), vote(trees[0]))
    share = votes / F.lit(float(len(trees)))
    return measures.select(key, votes.cast("long").alias("votes"), F.floor(share * 100 + 0.5).cast("long").alias("score"))


def assessments(rows: DataFrame, fixed: list[str], actionable: list[str], mapped: str = "QB_") -> DataFrame:
    """Report rows as ``Filename``, ``quality_score`` and maps of numbers: actionable, mapped (prefix cut off) and native.

    Columns that are none of the first three kinds are native; nulls stay in the maps.
    """
    blocks = [c for c in rows.columns if c.startswith(mapped)]
    native = [c for c in rows.columns if c not in fixed and c not in actionable and c not in blocks]
    held = lambda names, cut=0: F.create_map(*(x for c in names for x in (F.lit(c[cut:]), F.col(f"`{c}`").try_cast("double")))) if names else F.create_map().cast("map<string,double>")
    return rows.select("Filename", F.col("UnifiedQualityScore").try_cast("int").alias("quality_score"), held(actionable).alias("actionable"), held(blocks, len(mapped)).alias("mapped"), held(native).alias("native"))


def batch_paths(paths: DataFrame, folder: str, path_col: str = "path") -> DataFrame:
    """Trimmed paths without blank ones; relative ones are taken from ``folder``. A batch without any path is an error."""
    path = F.trim(F.col(path_col))
    if paths.where(path != "").isEmpty():
        raise ValueError("a batch needs at least one path")
    return paths.where(path != "").select(F.when(F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path)).alias(path_col))
