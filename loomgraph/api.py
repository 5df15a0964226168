"""One object that indexes, stores and answers, and a command line over it."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import analytics, features, ledger, labels, lookup, temporal
from loomgraph.plans import report
from loomgraph.schema import USAGE, Graph
from loomgraph.sources import code, store


def _counted(tool: str) -> Callable:
    """Appends what an answer took to the usage ledger; one that fails is not counted. [API-18]"""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def run(self, *args, **options):
            start = time.time()
            answer = f(self, *args, **options)
            files = ledger.BASELINE_FILES.get(tool, 0)
            row = (datetime.now(timezone.utc).replace(tzinfo=None), tool, -(-len(answer) // 4), files * ledger.TOKENS_PER_FILE, int(1000 * (time.time() - start)))
            store.append_usage(self.spark.createDataFrame([row], USAGE), f"{self.folder}/usage")
            return answer

        return run

    return around


class Engine:
    """Answers about the project under root from snapshots under folder."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root, folder

    def graph(self, snapshot: str | None = None) -> Graph:
        known = store.snapshots(self.spark, self.folder)
        row = None if known is None else known.first()
        if row is None:
            raise LookupError("nothing is indexed yet")
        return store.load_snapshot(self.spark, self.folder, snapshot or row["snapshot_id"])

    def stale(self) -> DataFrame:
        """Files that differ from those of the newest snapshot. [SET-09]"""
        current = code.discover(self.spark, self.root).select("path", "hash")
        return temporal.stale_files(self.spark.read.parquet(f"{self.folder}/files"), current)

    @_counted("index")
    def index(self) -> str:
        """[API-02]"""
        files = code.discover(self.spark, self.root)
        at = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        name = store.save_graph(code.index_project(files), self.folder, self.root, at, providers=code.ORDER)
        files.select("path", "hash").write.mode("overwrite").parquet(f"{self.folder}/files")
        return f"Indexed as {name}." if name else "Nothing changed."

    @_counted("map")
    def project_map(self) -> str:
        """[API-03]"""
        return report.project_map(self.graph())

    @_counted("impact")
    def impact(self, target: str) -> str:
        """[API-04]"""
        return report.impact(self.graph(), target)

    @_counted("match")
    def match_ui(self, element: str) -> str:
        """[API-05]"""
        return report.table(labels.match_labels(self.graph(), self.spark.createDataFrame([(element,)], "label string")).orderBy("place").select("id", "type", "score"))

    @_counted("blueprint")
    def blueprint(self, markdown: str) -> str:
        """[API-06, FLT-09]"""
        rows = lookup.component_names(self.spark.createDataFrame([(0, markdown)], "doc_id int, text string"))
        return report.blueprint(self.graph(), [r["name"] for r in rows.orderBy("place").collect()])

    @_counted("trace")
    def trace(self, start: str, goal: str) -> str:
        """[API-07]"""
        return report.trace(self.graph(), start, goal)

    @_counted("explain")
    def explain(self, target: str) -> str:
        """[API-08]"""
        return report.explain(self.graph(), target)

    @_counted("what_if")
    def what_if(self, action: str, target: str) -> str:
        """remove, split or lazy_load. [API-09, AGG-15]"""
        graph = self.graph()
        node = lookup.resolve(graph, target).orderBy(F.desc("rank"), "id").limit(1).select("id")
        if node.isEmpty():
            raise LookupError(f"no node matches {target}")
        return report.table(analytics.what_if(graph, action, node))

    @_counted("feature")
    def feature(self, name: str | None = None) -> str:
        """[API-10, FEA-05]"""
        graph = self.graph()
        found = features.load_features(self.spark, f"{self.folder}/features.json", graph)
        found = features.derive_features(graph) if found is None else found
        if name is None:
            return report.table(features.feature_list(graph, found).orderBy("feature"))
        own = features.find_feature(found, name)
        if own.isEmpty():
            raise LookupError("features: " + ", ".join(r["feature"] for r in found.select("feature").distinct().orderBy("feature").collect()))
        return report.table(features.members(graph, own).orderBy("id")) + "\n\n" + report.table(features.entry_points(graph, own).orderBy("src", "dst"))

    @_counted("timeline")
    def timeline(self) -> str:
        """[API-11]"""
        nodes = self.spark.read.parquet(f"{self.folder}/nodes")
        return report.table(temporal.timeline(nodes, store.snapshots(self.spark, self.folder)).orderBy("snapshot_id", "change", "type"))

    @_counted("search")
    def search(self, query: str) -> str:
        """[API-12]"""
        return report.table(lookup.search(self.graph(), query))

    @_counted("analyze")
    def analyze(self) -> str:
        """[API-13]"""
        return report.analysis(self.graph())

    @_counted("diff")
    def diff(self, snapshot: str | None = None) -> str:
        """Against the snapshot before the newest, or a named one. [API-14]"""
        names = [r["snapshot_id"] for r in store.snapshots(self.spark, self.folder).limit(2).collect()]
        if snapshot is None and len(names) < 2:
            return "Only one snapshot exists."
        return report.difference(self.graph(snapshot or names[1]), self.graph(names[0]))

    def savings(self) -> str:
        """[API-15]"""
        return report.savings(store.read_usage(self.spark, f"{self.folder}/usage"))


def main(words: list[str] | None = None) -> int:
    """[API-17]"""
    parser = argparse.ArgumentParser(prog="loomgraph")
    parser.add_argument("--root", default=".")
    parser.add_argument("--folder", default=".loomgraph")
    parser.add_argument("command", choices=["index", "map", "analyze", "impact", "search", "trace", "explain", "what-if", "diff", "timeline", "feature", "savings"])
    parser.add_argument("words", nargs="*")
    args = parser.parse_args(words)
    engine = Engine(SparkSession.builder.appName("loomgraph").getOrCreate(), args.root, args.folder)
    name = {"map": "project_map", "what-if": "what_if"}.get(args.command, args.command)
    try:
        print(getattr(engine, name)(*args.words))
    except LookupError as error:
        print(f"error: {error}")
        return 1
    return 0
