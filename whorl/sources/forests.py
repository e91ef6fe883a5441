"""Forests from their model text: an indent-sensitive listing of nodes, as windows over its lines.

A line opens a tree or a node by its dash and indent; all others belong to the
last open one. Nodes stand in preorder with their depth, so the left child
of a split is the next node and the right one the next of the same depth as the left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The lines that open the model, its trees and a node list, and the indents of the dashes of trees and nodes.
ROOT, TREES, TREE_INDENT, NODE_INDENT = "my_random_trees:", "trees:", 6, 12


def forest_lines(files: DataFrame) -> DataFrame:
    """path, line, indent, text of the lines inside the tree list that are not blank; ``declared``: the stated number of trees.

    ``files``: path and ``content`` (text).
    """
    each = files.select("path", F.posexplode(F.split("content", r"[\r\n]+")).alias("line", "raw")).withColumn("text", F.trim("raw")).where("text <> ''")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda condition: F.coalesce(F.max(condition).over(before), F.lit(False))
    each = each.withColumn("model", seen(F.col("text") == ROOT))
    each = each.withColumn("inside", seen(F.col("model") & (F.col("text") == TREES)))
    declared = F.when(F.col("model") & F.startswith("text", F.lit("ntrees:")), F.regexp_extract("text", r":\s*(-?[0-9]+)", 1).try_cast("int"))
    each = each.withColumn("declared", F.max(declared).over(Window.partitionBy("path")))
    return each.where("inside").select("path", "line", (F.length("raw") - F.length(F.ltrim("raw"))).alias("indent"), "text", "declared")


def forest_nodes(files: DataFrame) -> DataFrame:
    """path, tree, node (both from 0), depth, class, feature (null at leaves), threshold, left, right and ``error``.

    ``error``: ``count`` (the stated number of trees is missing or another), ``split`` (one without
    feature or threshold), ``depth`` (a node without one) or ``structure`` (nodes that are no binary trees in preorder).
    Every node of a file has its file's error. A file without nodes has no rows.
    """
    rows = forest_lines(files)
    of_file = Window.partitionBy("path").orderBy("line")
    dash = lambda indent: (F.col("text") == "-") & (F.col("indent") == indent)
    rows = rows.withColumn("tree", F.count_if(dash(TREE_INDENT)).over(of_file) - 1)
    rows = rows.withColumn("node", F.count_if(dash(NODE_INDENT)).over(Window.partitionBy("path", "tree").orderBy("line")) - 1)
    texts = rows.where("tree >= 0 and node >= 0").groupBy("path", "tree", "node").agg(F.max("declared").alias("declared"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r.text), " ").alias("text"))
    splits = F.regexp_extract_all("text", F.lit(r"- \{([^}]*)\}"), F.lit(1))
    outside = F.regexp_replace("text", r"- \{[^}]*\}", "")
    last = lambda key: F.element_at(F.regexp_extract_all(outside, F.lit(rf"(?:^| ){key}:\s*(-?[0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("int")
    some = lambda key: F.when(F.size(F.regexp_extract_all(outside, F.lit(rf"(?:^| ){key}:\s*(-?[0-9]+)"), F.lit(1))) > 0, last(key))
    split = F.when(F.size(splits) > 0, F.element_at(splits, F.lit(-1)))
    part = lambda key, kind: F.regexp_extract(split, rf"(?:^|,)\s*{key}:\s*([^,\s]+)", 1).try_cast(kind)
    nodes = texts.select("path", "declared", "tree", "node", some("depth").alias("depth"), F.coalesce(some("norm_class_idx"), F.lit(0)).alias("class"), split.alias("split"), part("var", "int").alias("feature"), part("le", "double").alias("threshold"))
    in_tree, level = Window.partitionBy("path", "tree").orderBy("node"), Window.partitionBy("path", "tree", "depth").orderBy("node")
    nodes = nodes.withColumn("next", F.lead("node").over(level)).withColumns({"below": F.lead("depth").over(in_tree), "after": F.lead("next").over(in_tree)})
    is_split = F.col("split").isNotNull()
    nodes = nodes.withColumns({"left": F.when(is_split & (F.col("below") == F.col("depth") + 1), F.col("node") + 1), "right": F.when(is_split & (F.col("below") == F.col("depth") + 1), F.col("after"))})
    whole = Window.partitionBy("path", "tree")
    # A binary tree in preorder: every node but the first is the child of one split, and leaves have none below.
    broken = F.coalesce(F.count_if(is_split & (F.col("left").isNull() | F.col("right").isNull())).over(whole) > 0, F.lit(False))
    loose = F.count_if(~is_split & (F.col("below") > F.col("depth"))).over(whole) > 0
    sized = F.count("*").over(whole) != 2 * F.count_if(is_split).over(whole) + 1
    first = F.count_if((F.col("node") == 0) != (F.col("depth") == 0)).over(whole) > 0
    bad_split = is_split & (F.col("feature").isNull() | (F.col("feature") < 0) | F.col("threshold").isNull())
    own = F.when(bad_split, "split").when(F.col("depth").isNull(), "depth").when(broken | loose | sized | first, "structure")
    nodes = nodes.withColumn("own", own)
    of_path = Window.partitionBy("path")
    trees = F.size(F.collect_set("tree").over(of_path))
    count = F.when(F.coalesce(F.col("declared") != trees, F.lit(True)) | (F.col("declared") <= 0), "count")
    return nodes.select("path", F.col("tree").cast("int"), F.col("node").cast("int"), "depth", "class", "feature", "threshold", F.col("left").cast("int"), F.col("right").cast("int"), F.coalesce(*(F.max(F.when(F.col("own") == k, k)).over(of_path) for k in ("split", "depth", "structure")), count).alias("error"))


def load_forest(nodes: DataFrame, names: list[str]) -> list[dict]:
    """The trees of one file for ``forest_scores``; ``names`` are the measures in the order of the model's feature numbers.

    A model is one file of a few megabytes; its nodes come to the driver, as they go to every task.
    """
    rows = nodes.orderBy("tree", "node").collect()
    if not rows or rows[0]["error"]:
        raise ValueError(f"no forest: {rows[0]['error'] if rows else 'no nodes'}")
    made: dict = {}
    for r in reversed(rows):
        key = (r["tree"], r["node"])
        made[key] = {"class": r["class"]} if r["feature"] is None else {"feature": names[r["feature"]], "threshold": r["threshold"], "left": made[r["tree"], r["left"]], "right": made[r["tree"], r["right"]]}
    return [made[tree, 0] for tree in range(rows[-1]["tree"] + 1)]
