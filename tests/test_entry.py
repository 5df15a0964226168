import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
import bench


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "route_risk" in queries
    assert {"route_risk", "import_cycles", "architecture_score"} <= set(bench.HEADLINE)


def test_imports_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'route_risk' in e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_workers_find_the_package_from_any_folder(tmp_path):
    """Scans and sources run in Python workers, which look for the package by name."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from loomgraph.sources import code, readers
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
files = spark.createDataFrame([("lib/a.dart", "class A extends StatelessWidget {{}}")], "path string, content string")
assert code.facts(files).count() > 0
readers.register(spark)
files.coalesce(1).write.format("source_tree").mode("append").save({str(tmp_path / "tree")!r})
assert spark.read.format("source_tree").load({str(tmp_path / "tree")!r}).count() == 1
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and {"route", "risk"} <= set(rows[0].asDict())
