"""Components of a graph that grows batch by batch, kept in a ledger's tables.

``members`` has each node once, with the root that its component had when it came. ``roots`` says under which
root each root's component goes now, and ``tops`` its least node and size. A batch looks up its own nodes,
finds components among their present roots only, and where some merge moves the roots of all but the largest
one. So it adds a row for each new node, and changes those of the roots and tops that it merges: both tables
are logs of which the latest row counts. A batch that is repeated changes nothing.

Defined cases: edges of null nodes are left out, edges of a node with itself make it a node, repeated edges
and nodes count once; the component is the least node, as in ``graph.components``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, tables
from .ledger import Ledger


def _latest(log: DataFrame, key: str) -> DataFrame:
    """The row of the last batch of each key."""
    others = [c for c in log.columns if c not in (key, "batch", "commit")]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, "r.*")


class Components:
    """Components in the folder of a ledger, of nodes of one type."""

    def __init__(self, book: Ledger, node_type: str = "bigint"):
        self.book, self.type = book, node_type

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self.book.read(name)
        return self.book.spark.createDataFrame([], schema) if found is None else found

    def _members(self) -> DataFrame:
        return self._read("members", f"node {self.type}, root {self.type}").select("node", "root")

    def _roots(self) -> DataFrame:
        return _latest(self._read("roots", f"root {self.type}, current {self.type}, batch bigint"), "root")

    def _tops(self) -> DataFrame:
        return _latest(self._read("tops", f"current {self.type}, least {self.type}, size bigint, batch bigint"), "current")

    def add(self, nodes: DataFrame, edges: DataFrame, stream: str, batch: int) -> bool:
        """Take in ``nodes`` (node) and ``edges`` (a, b), whose nodes are taken in as well; False if the batch is known."""
        if self.book.has(stream, batch):
            return False
        tied = tables.store(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        named = nodes.select("node").where("node IS NOT NULL").unionAll(tied.select("a")).unionAll(tied.select("b")).distinct()
        roots, tops = self._roots(), self._tops()
        placed = named.join(self._members(), "node", "left").join(roots, "root", "left")
        placed = tables.store(placed.select("node", F.col("root").isNull().alias("new"), F.coalesce("current", "node").alias("current")), "placed")
        now = placed.select("node", "current")
        across = tied.join(now.withColumnsRenamed({"node": "a", "current": "ca"}), "a").join(now.withColumnsRenamed({"node": "b", "current": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        involved = placed.groupBy("current").agg(F.max("new").alias("new"))  # an old root has no new node yet
        united = graph.components(involved.select(F.col("current").alias("node")), across).withColumnRenamed("node", "current")
        sized = united.join(involved, "current").join(tops, "current", "left").select("component", "current", "new", F.coalesce("least", "current").alias("least"), F.coalesce("size", F.lit(1)).alias("size"))
        sized = tables.store(sized, "sized")
        kept = F.max_by("current", F.struct(~F.col("new"), "size", "current")).alias("survivor")
        groups = sized.groupBy("component").agg(kept, F.min("least").alias("least"), F.sum("size").alias("size"), F.count("*").alias("n"), F.min("new").alias("all_new"))
        groups = tables.store(groups, "groups")
        into = sized.join(groups.select("component", "survivor", "n"), "component").select("current", "new", "survivor", "n")
        mark = F.lit(batch).cast("long").alias("batch")
        moved = roots.join(into.where("NOT new AND current <> survivor").select("current", "survivor"), "current").select("root", F.col("survivor").alias("current"), mark)
        begun = groups.where("all_new").select(F.col("survivor").alias("root"), F.col("survivor").alias("current"), mark)
        parts = {
            "members": placed.where("new").join(into.where("new").select("current", "survivor"), "current").select("node", F.col("survivor").alias("root")),
            "roots": moved.unionAll(begun),
            "tops": groups.where("n > 1 OR all_new").select(F.col("survivor").alias("current"), "least", "size", mark),
        }
        done = self.book.commit(stream, batch, parts)
        tables.discard(tied, placed, sized, groups)
        return done

    def labels(self) -> DataFrame:
        """(node, component) of all nodes so far."""
        return self._members().join(self._roots(), "root").join(self._tops(), "current").select("node", F.col("least").alias("component"))

    def rewritten(self, stream: str, batch: int) -> int:
        """How many rows of all tables a batch wrote."""
        return sum(t["rows"] for e in self.book.entries() if e["stream"] == stream and e["batch"] == batch for t in e["tables"])
