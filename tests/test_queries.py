"""Every registered query returns what its SQL returns, and every query has SQL."""

import pytest

from loomline.plans import registry

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["navigation", "reveal_for_descriptor", "block_map", "deep_search"])
def test_every_dialogue_line_is_a_target(spark, name):
    from pyspark.sql import functions as F

    target = {"reveal_for_descriptor": "line_no", "deep_search": "around"}.get(name, "target")
    lines = registry.QUERIES["line_scan"](spark, SMALL).where("contains(line, ',')")
    if name == "deep_search":
        lines = lines.where("contains(line, 'the')")
    got = registry.QUERIES[name](spark, SMALL).select("doc_id", F.col(target).alias("line_no")).distinct()
    assert lines.select("doc_id", "line_no").exceptAll(got).count() == 0


def test_deep_search_reaches_as_far_as_the_operator(spark):
    rows = registry.QUERIES["deep_search"](spark, SMALL)
    assert rows.where("line_no >= around + 8").count() and rows.where("line_no < around - 5").count()
    assert rows.where("kind = 'name'").groupBy("doc_id", "around").count().where("count > 4").count()


def test_leaks_of_whole_passages_over_whole_texts(spark, tmp_path):
    passage = [f"w{i}" for i in range(20)]
    spark.createDataFrame([(1, " ".join(passage)), (2, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(passage[9:]), "w10 w11 w12\nw13 w14 w15", "none", "x one\ntwo", "w3 w4 w5 w6 w7"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["leak_windows"](spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {0: 6, 1: 1, 3: 1}


def test_risks_of_every_line(spark):
    lines = registry.QUERIES["line_scan"](spark, SMALL).select("doc_id", "line_no")
    got = registry.QUERIES["risk_flags"](spark, SMALL)
    assert got.select("doc_id", "line_no").exceptAll(lines).count() == 0 and got.count() == lines.count()
    assert got.where("line_no > 1 and contains(reasons, 'short or fragmentary')").count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from loomline import session

    spark = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, environment={"LOOMLINE_SHARED": "/x"}, getConf=lambda: conf))
    with pytest.raises(ValueError):
        session.shared_dir(spark("local-cluster[2,1,1024]"))
    assert session.shared_dir(spark("yarn", **{"spark.checkpoint.dir": "hdfs://n/a/"})) == "hdfs://n/a"
    assert session.shared_dir(spark("local[4]")) == "file:///x"


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loomline", tmp_path / "loomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert int(run.stdout) == len(registry.QUERIES), run.stderr
