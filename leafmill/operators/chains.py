"""Following chains in which every node has one successor at most, by doubling the length of a step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize


def _written(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """A table of ``df`` with some counts of its rows, in one job."""
    seen = Observation()
    return materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name), seen.get


@dataclass(frozen=True)
class Chains:
    """``ends`` has, for each node with a successor: ``last``, the last node of its chain that is new, and
    ``hops``, the steps to it; where the chain runs into a loop also ``entry``, the node that comes again,
    and ``entry_at``, the steps to its first visit. ``jumps[k]`` has (node, ptr), 2**k steps apart."""

    ends: DataFrame
    jumps: list[DataFrame]

    def further(self, k: int) -> DataFrame:
        """(node, ptr) 2**k steps apart, for any k."""
        while len(self.jumps) <= k:
            top = self.jumps[-1]
            twice = top.join(top.select(F.col("node").alias("ptr"), F.col("ptr").alias("far")), "ptr").select("node", F.col("far").alias("ptr"))
            self.jumps.append(materialize(twice, "jumps"))
        return self.jumps[k]

    def at(self, rows: DataFrame, steps: int) -> DataFrame:
        """``rows`` with their ``node`` replaced by the one ``steps`` on; rows whose chain is shorter go."""
        for k in range(steps.bit_length()):
            if steps >> k & 1:
                rows = rows.join(self.further(k), "node").drop("node").withColumnRenamed("ptr", "node")
        return rows

    def walk(self, rows: DataFrame, longest: int) -> DataFrame:
        """Every node on the way of each row: ``rows`` has ``node`` and ``length``, the nodes wanted (at most
        ``longest``). The result has one row per node, with its ``place``. Each join doubles what is known."""
        rows = rows.withColumn("place", F.lit(0).cast("long"))
        for k in reversed(range(max(longest - 1, 0).bit_length())):
            rest = [c for c in rows.columns if c not in ("node", "place")]
            here = F.struct("node", "place")
            there = F.when((F.col("place") + (1 << k) < F.col("length")) & F.col("ptr").isNotNull(), F.struct(F.col("ptr").alias("node"), (F.col("place") + (1 << k)).alias("place")))
            both = F.filter(F.array(here, there), lambda x: x.isNotNull())
            rows = rows.join(self.further(k), "node", "left").select(*rest, F.inline(both))
        return rows


def _halted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, ptr, dist, open) once only chains into loops are open; and the tables of all rounds.

    Every round joins the open rows with the table, so that a step is twice as long as before. A chain of
    n steps is done after log2(n) rounds, and a round that closes none shows that only loops are left.
    """
    state = edges.select("node", F.col("target").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("open"))
    table, counts = _written(state, "chains", open=F.count_if(F.col("open")))
    rounds, before = [table], None
    while counts["open"] and counts["open"] != before:
        before = counts["open"]
        table, counts = _round(table)
        rounds.append(table)
    return table, rounds


def _round(table: DataFrame) -> tuple[DataFrame, dict]:
    right = table.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("more"), F.col("open").alias("on"))
    joined = table.where("open").join(right, "ptr", "left")
    stepped = joined.select("node", F.coalesce("far", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("on", F.lit(False)).alias("open"))
    return _written(table.where("not open").unionByName(stepped), "chains", open=F.count_if(F.col("open")))


def follow_chains(edges: DataFrame) -> Chains:
    """Follows (node, target), one row per node that goes on; a target without a row of its own is an end.

    Rounds grow with the logarithm of the longest chain. Loops are looked at only if there are any.
    """
    table, rounds = _halted(edges)
    jumps = [t.where((F.col("dist") == 1 << k)).select("node", "ptr") for k, t in enumerate(rounds)]
    no_entry = F.lit(None).cast(edges.schema["target"].dataType).alias("entry"), F.lit(None).cast("long").alias("entry_at")
    ended = table.where("not open").select("node", F.col("ptr").alias("last"), F.col("dist").alias("hops"), *no_entry)
    if not table.where("open").isEmpty():
        ended = ended.unionByName(_looping(edges, table.where("open")))
    return Chains(ended, jumps)


def _looping(edges: DataFrame, open_: DataFrame) -> DataFrame:
    """The ``ends`` of nodes whose chains run into a loop."""
    # images of longer and longer steps shrink until only the loops are left
    size = None
    while True:
        on_loop, counts = _written(open_.select(F.col("ptr").alias("node")).distinct(), "loop-nodes", n=F.count(F.lit(1)))
        if counts["n"] == size:
            break
        size = counts["n"]
        open_, _ = _round(open_)
    inside = edges.join(on_loop, "node", "left_semi").select("node", F.col("target").alias("ptr"))
    # a loop is known by its smallest node, the least that longer and longer stretches hold
    state = materialize(inside.withColumn("low", F.col("node")), "loops")
    changed = 1
    while changed:
        right = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("lower"))
        grown = state.join(right, "ptr").select("node", F.col("far").alias("ptr"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("changed"))
        state, counts = _written(grown, "loops", changed=F.count_if(F.col("changed")))
        changed = counts["changed"]
    lows = state.select("node", "low")
    sizes = lows.groupBy("low").agg(F.count("*").alias("size"))
    before = inside.select(F.col("ptr").alias("entry"), F.col("node").alias("last"))
    loops = materialize(lows.join(sizes, "low").select(F.col("node").alias("entry"), "size").join(before, "entry"), "loop-entries")
    tails = edges.join(open_.select("node"), "node", "left_semi").join(on_loop, "node", "left_anti")
    ways, _ = _halted(tails)
    starts = ways.select("node", F.col("ptr").alias("entry"), F.col("dist").alias("entry_at"))
    starts = starts.unionByName(on_loop.select("node", F.col("node").alias("entry"), F.lit(0).cast("long").alias("entry_at")))
    return starts.join(loops, "entry").select("node", "last", (F.col("entry_at") + F.col("size") - 1).alias("hops"), "entry", "entry_at")
