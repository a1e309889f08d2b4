"""A stored graph of revisions of one table: each node is a step on its parent, history is a path, undo a new branch point.

The graph is append-only: a node is a row in its own small file, named by its revision, which is the hash of parent and
step. So a commit that is repeated (or retried after a crash) finds its node and adds nothing, and two branches never
touch each other. Rows of a revision aren't stored but replayed from the root's table; the digest that the node keeps,
a count and a sum of row hashes, tells whether a replay gives what the commit gave.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import queue, recipe
from tallyspark.operators.recipe import Step, StepError

NODE = "revision string, parent string, source string, step string, n_rows long, digest string"


def digest(df: DataFrame) -> tuple[int, str]:
    """How many rows there are, and a hash of them that doesn't depend on their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row.n, hashlib.sha256(f"{row.n}:{row.h}:{','.join(df.columns)}".encode()).hexdigest()


class Graph:
    """The revisions below one folder. `source` is the root's table; its own digest is in the root node."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def nodes(self) -> DataFrame:
        """All nodes, a row each."""
        fs, p = self._file("")
        if not fs.exists(p):
            return self.spark.createDataFrame([], NODE)
        return self.spark.read.schema(NODE).option("recursiveFileLookup", True).parquet(self.path)

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def get(self, revision: str):
        fs, p = self._file(f"{revision}/_SUCCESS")
        if not fs.exists(p):
            raise StepError(f"unknown revision {revision}")
        return self.spark.read.schema(NODE).parquet(f"{self.path}/{revision}").first()

    def _add(self, revision: str, parent: str | None, source: str, step: Step | None, rows: DataFrame) -> str:
        fs, p = self._file(f"{revision}/_SUCCESS")
        if not fs.exists(p):
            n, h = digest(rows)
            text = json.dumps({"operator": step.operator, "parameters": step.parameters}, sort_keys=True, ensure_ascii=False) if step else None
            self.spark.createDataFrame([(revision, parent, source, text, n, h)], NODE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{revision}")
        return revision

    def root(self, source: str, df: DataFrame) -> str:
        """The node of the table itself; its revision is the hash of the source's name and the table's digest."""
        n, h = digest(df)
        return self._add(hashlib.sha256(f"{source}:{n}:{h}".encode()).hexdigest(), None, source, None, df)

    def commit(self, parent: str, step: Step, root: DataFrame) -> str:
        """The node that step makes of parent."""
        node = self.get(parent)
        rows, _ = recipe.apply(self.replay(parent, root), step)
        return self._add(step.revision(parent), parent, node.source, step, rows)

    def history(self, revision: str) -> list[str]:
        """The path from the root to a revision: one small file a node."""
        path, at = [], revision
        while at is not None:
            if at in path:
                raise StepError("the graph has a cycle")
            path.append(at)
            at = self.get(at).parent
        return path[::-1]

    def undo(self, revision: str) -> str:
        """The parent, from which a commit makes a new branch; nothing is changed or lost."""
        parent = self.get(revision).parent
        if parent is None:
            raise StepError("the root has no parent")
        return parent

    def replay(self, revision: str, root: DataFrame) -> DataFrame:
        """The rows of a revision, from the root's table."""
        steps = [json.loads(n.step) for n in map(self.get, self.history(revision)) if n.step]
        return recipe.replay(root, [Step(s["operator"], s["parameters"]) for s in steps])[0]

    def verified(self, revision: str, root: DataFrame) -> DataFrame:
        """The rows of a revision, or an error if they aren't those that it was committed with."""
        df = self.replay(revision, root)
        if digest(df) != (self.get(revision).n_rows, self.get(revision).digest):
            raise StepError(f"the replay of {revision} gives other rows")
        return df

    def paths(self) -> DataFrame:
        """revision, n_rows, depth, operators from the root on, for all nodes at once."""
        nodes = self.nodes()
        edges = nodes.filter("parent is not null").select(F.col("revision").alias("node"), "parent")
        up = queue.ancestors(edges).select(F.col("node").alias("revision"), F.col("anc").alias("other"), "depth")
        up = up.unionByName(nodes.select("revision", F.col("revision").alias("other"), F.lit(0).alias("depth")))
        named = up.join(nodes.select(F.col("revision").alias("other"), F.get_json_object("step", "$.operator").alias("operator")), "other").filter("operator is not null")
        chain = named.groupBy("revision").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), "operator"))), lambda x: x["operator"]), ">").alias("operators"), F.count(F.lit(1)).alias("depth"))
        return nodes.select("revision", "n_rows").join(chain, "revision", "left").select("revision", "n_rows", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("operators", F.lit("")).alias("operators"))
