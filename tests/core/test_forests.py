"""Model texts of forests against a plain reader, and their faults."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from whorl.operators import reports  # noqa: E402
from whorl.sources import forests  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def grown(rng, depth=0):
    if depth > 5 or rng.random() < 0.3:
        return {"class": rng.randint(0, 1)}
    return {"feature": f"f{rng.randrange(5)}", "threshold": rng.choice([0.5, -1.25, 3.0, 1e-3]), "left": grown(rng, depth + 1), "right": grown(rng, depth + 1)}


def text_of(trees, stated=None):
    out = ["%YAML:1.0", "my_random_trees:", f"   ntrees:{len(trees) if stated is None else stated}", "", "   trees:"]

    def write(node, depth):
        out.extend(["            -", f"              depth:{depth}", f"              norm_class_idx:{node.get('class', 0)}"])
        if "feature" in node:
            out.extend(["              splits:", f"                 - {{ var:{node['feature'][1:]}, quality:0.1,", f"                    le:{node['threshold']} }}"] if depth % 2 else ["              splits:", f"                 - {{ var:{node['feature'][1:]}, quality:0.1, le:{node['threshold']} }}"])
            write(node["left"], depth + 1)
            write(node["right"], depth + 1)

    for tree in trees:
        out.extend(["      -", "         nodes:"])
        write(tree, 0)
    return "\r\n".join(out) + "\n"


def test_trees_come_back_and_score(spark):
    rng = random.Random(3)
    trees = [grown(rng) for _ in range(20)]
    nodes = forests.forest_nodes(spark.createDataFrame([("m", text_of(trees))], "path string, content string"))
    names = [f"f{i}" for i in range(5)]
    assert forests.load_forest(nodes, names) == trees
    rows = spark.createDataFrame([(i, *(rng.uniform(-2, 4) for _ in names)) for i in range(30)], "image_id int, " + ", ".join(f"{n} double" for n in names))
    assert sorted(map(tuple, reports.forest_scores(rows, forests.load_forest(nodes, names)).collect())) == sorted(map(tuple, reports.forest_scores(rows, trees).collect()))


def test_faults_are_named(spark):
    leaf, split = {"class": 1}, {"feature": "f1", "threshold": 1.0, "left": {"class": 0}, "right": {"class": 1}}
    good = text_of([split])
    texts = {"good": good, "count": text_of([split], 2), "none": text_of([split]).replace("ntrees:1", "trees_of:1"), "split": good.replace("var:1", "var:x"), "depth": good.replace("depth:1\r\n              norm_class_idx:1", "norm_class_idx:1"), "cut": good[: good.rindex("            -")], "deep": good.replace("depth:1", "depth:2"), "more": good + "            -\n              depth:1\n", "leaf": text_of([leaf]), "blank": " \n"}
    found = forests.forest_nodes(spark.createDataFrame(list(texts.items()), "path string, content string")).groupBy("path").agg({"error": "max"}).collect()
    assert {r[0]: r[1] for r in found} == {"good": None, "count": "count", "none": "count", "split": "split", "depth": "depth", "cut": "structure", "deep": "structure", "more": "structure", "leaf": None}
    with pytest.raises(ValueError):
        forests.load_forest(forests.forest_nodes(spark.createDataFrame([("x", texts["cut"])], "path string, content string")), ["f0", "f1"])
