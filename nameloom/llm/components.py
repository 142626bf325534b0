"""Groups of linked records by Boruvka hooking (problem 3).

Vertices are numbered once; the numbers, not the names, travel. In each round
every component selects its smallest outgoing edge in the order (smaller end,
larger end) - which is the edge to its smallest neighbour -, the trees that these
edges form collapse by pointer doubling, and the edges are relabelled to component
numbers and deduplicated, until none is left. At least half of the components
with edges vanish in a round, and a tree of depth d collapses in log2 d
doublings, whatever the shape of the graph. A round touches only components that
still have edges; what it found is kept as one table, and these are composed from
the last to the first, each at most half as long as the one before. Every state is a
table in the shared folder; nothing that grows with the data reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.operators import scratch
from nameloom.operators.skew import salted_join


def component_ids(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of `edges` (a bigint, b bigint); root is one vertex of the component.

    Loops and repeated or reversed edges are allowed; rows with a null end are
    left out. A vertex that has only a loop gets itself. No edges: no rows.
    """
    both = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = scratch.write(both.distinct(), "edges", loops=F.expr("a = b"))
    current, m, rounds = first.df.where("a <> b"), first.stats["rows"] - first.stats["loops"], []
    while m:
        # the smallest outgoing edge of each component, combined before the shuffle
        ends = current.select(F.col("a").alias("id"), F.col("b").alias("to")).union(current.select("b", "a"))
        parents = _collapse(scratch.write(ends.groupBy("id").agg(F.min("to").alias("up")), "hook"))
        rounds.append(parents)
        up = parents.df.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        half = salted_join(current, up, "a", m, F.col("b")).select("b", F.col("ra").alias("a"))
        half = salted_join(half, up.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", m, F.col("a"))
        relabelled = half.where("a <> rb").select(F.least("a", "rb").alias("a"), F.greatest("a", "rb").alias("b")).distinct()
        rest = scratch.write(relabelled, "edges")
        current, m = rest.df, rest.stats["rows"]
    labels = first.df.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    if rounds:
        last = rounds.pop()
        while rounds:
            before = rounds.pop()
            moved = salted_join(before.df, last.df.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", before.stats["rows"], F.col("id"), "left")
            composed = scratch.write(moved.select("id", F.coalesce("top", "up").alias("up")), "labels")
            for t in (before, last):
                t.drop()
            last = composed
        labels = last.df.select("id", F.col("up").alias("root"))
    if first.stats["loops"]:
        alone = first.df.where("a = b").select(F.col("a").alias("id")).join(labels.hint("merge"), "id", "left_anti")
        labels = labels.union(alone.select("id", F.col("id").alias("root")))
    return labels


def _collapse(hook: scratch.Table) -> scratch.Table:
    """From (id, up), where two smallest neighbours of each other form the only cycles, to (id, up) with up the root."""
    table, cycles = hook, True
    while True:
        jump = table.df.select(F.col("id").alias("up"), F.col("up").alias("top"))
        joined = salted_join(table.df.select("id", "up"), jump, "up", table.stats["rows"], F.col("id"), "left")
        # the smaller end of a cycle is a root, the larger one hangs on it already
        top = F.when(F.col("top") != F.col("id"), F.col("top")).otherwise(F.least("id", "up")) if cycles else F.col("top")
        doubled = joined.select("id", top.alias("up"), (F.lit(cycles) | (top != F.col("up"))).alias("moved"))
        after = scratch.write(doubled, "parents", moving=F.col("moved"))
        table.drop()
        table, cycles = after, False
        if not table.stats["moving"]:
            table.df = table.df.select("id", "up")
            return table


def name_groups(pairs: DataFrame) -> DataFrame:
    """(name, group_name) for every name of `pairs` (name1, name2) whose group has at least two names.

    Names are compared exactly as written, the empty name included; group_name is
    the smallest name of the group in code point order. Rows with a null name, and
    rows that link a name with itself, link nothing.
    """
    links = pairs.where("name1 is not null and name2 is not null and name1 <> name2").select(F.least("name1", "name2").alias("n1"), F.greatest("name1", "name2").alias("n2")).distinct()
    with scratch.scope():
        linked = scratch.write(links, "links")
        links, m = linked.df, linked.stats["rows"]
        names = links.select(F.col("n1").alias("name")).union(links.select("n2")).distinct().select("name", F.monotonically_increasing_id().alias("id"))
        named = scratch.write(names, "names")  # the numbers are fixed by writing them
        ids = named.df.withColumnRenamed("name", "n1")
        edges = salted_join(links, ids, "n1", m, F.col("n2")).select("n2", F.col("id").alias("a"))
        edges = salted_join(edges, ids.withColumnRenamed("n1", "n2"), "n2", m, F.col("a")).select("a", F.col("id").alias("b"))
        roots = named.df.join(component_ids(edges).hint("merge"), "id")
        table = scratch.write(roots.select("name", "root"), "roots").keep()
    smallest = table.df.groupBy("root").agg(F.min("name").alias("group_name"))
    return salted_join(table.df, smallest, "root", table.stats["rows"], F.col("name")).select("name", "group_name")
