"""Graph patterns as joins: a typed builder over node and edge tables.

    Match(nodes, edges).node("c", "Company").edge("r", "OPERATES_IN").node("g", "Geography").where(...).frame

Every name is a struct column: a node's has entity_id, entity_type, name and more; an edge's src, type and tgt. No
edge is used twice in a pattern. Catalyst orders the joins and prunes what is not asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.iteration import checkpoint, free
from ..operators.retrieval import incident


class Match:
    """partitions: into how many edges are dealt by each of their ends, where many meet but no end has very many of them
    (None: as Spark does by itself, which splits such ends)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, frame: DataFrame | None = None, last: str | None = None, taken: tuple[str, ...] = (), pending: tuple | None = None, partitions: int | None = None):
        self.nodes, self.edges, self.frame, self._last, self._taken, self._pending, self._partitions = nodes, edges, frame, last, taken, pending, partitions

    def _with(self, **changes) -> Match:
        state = {"frame": self.frame, "last": self._last, "taken": self._taken, "pending": self._pending} | changes
        return Match(self.nodes, self.edges, **state, partitions=self._partitions)

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(self._partitions, key) if self._partitions else rows

    def node(self, name: str, label: str | None = None, optional: bool = False, **properties) -> Match:
        """A node, joined through the edge before it. Properties are equal to values. optional: a left join."""
        kept = self.nodes
        if label is not None:
            kept = kept.filter(F.array_contains("labels", label) if "labels" in kept.columns else F.col("entity_type") == label)
        for key, value in properties.items():
            kept = kept.filter(F.col(key) == value)
        own = kept.select(F.struct("*").alias(name))
        if label is None and not properties:
            own = own.hint("merge")  # a whole table in memory is many times its files, by whose size Spark sends it to all tasks
        if self.frame is None:
            return self._with(frame=own, last=name)
        hops, edge, optional_edge = self._pending
        near = self._dealt(self._dealt(hops, "_there").join(own, F.col("_there") == F.col(f"{name}.entity_id")), "_here")
        how = "left" if optional or optional_edge else "inner"
        on = F.col(f"{self._last}.entity_id") == F.col("_here")
        for used in self._taken:  # no edge twice
            on = on & (F.size(F.array_intersect(F.col(used), F.col(edge))) == 0)
        joined = self.frame.join(near, on, how).drop("_here", "_there")
        return self._with(frame=joined, last=name, taken=(*self._taken, edge), pending=None)

    def edge(self, name: str, *types: str, direction: str = "out", hops: tuple[int, int] = (1, 1), optional: bool = False) -> Match:
        """Edges from the last node: out, in or both; hops: a chain of so many of them, no edge twice.

        The column holds the chain as an array of (src, type, tgt)."""
        kept = self.edges.filter(F.col("type").isin(*types)) if types else self.edges
        one = F.array(F.struct("src", "type", "tgt"))
        if direction == "out":
            step = kept.select(F.col("src").alias("_here"), F.col("tgt").alias("_there"), one.alias(name))
        elif direction == "in":
            step = kept.select(F.col("tgt").alias("_here"), F.col("src").alias("_there"), one.alias(name))
        elif direction == "both":
            step = incident(kept).select(F.col("here").alias("_here"), F.col("there").alias("_there"), one.alias(name))
        else:
            raise ValueError("direction must be out, in or both")
        low, high = hops
        if not 1 <= low <= high:
            raise ValueError("hops must be from 1 on")
        chains, chain = [step], step
        for _ in range(high - 1):
            more = step.select(F.col("_here").alias("_on"), F.col("_there").alias("_end"), F.col(name).alias("_more"))
            chain = chain.join(more, F.col("_there") == F.col("_on")).filter(~F.array_contains(F.col(name), F.col("_more")[0]))
            chain = chain.select("_here", F.col("_end").alias("_there"), F.concat(name, "_more").alias(name))
            chains.append(chain)
        return self._with(pending=(reduce(DataFrame.unionByName, chains[low - 1 :]), name, optional))

    def where(self, condition: Column) -> Match:
        return self._with(frame=self.frame.filter(condition))

    def exists(self, *types: str, direction: str = "out", label: str | None = None, negated: bool = False) -> Match:
        """Rows whose last node has, or with `negated` has not, such an edge (to a node of that label)."""
        kept = self.edges.filter(F.col("type").isin(*types)) if types else self.edges
        here, there = {"out": ("src", "tgt"), "in": ("tgt", "src")}[direction]
        if label is not None:
            kept = kept.join(self.nodes.filter(F.col("entity_type") == label).select("entity_id"), F.col(there) == F.col("entity_id"), "left_semi")
        ends = kept.select(F.col(here).alias("_end"))
        return self._with(frame=self.frame.join(ends, F.col(f"{self._last}.entity_id") == F.col("_end"), "left_anti" if negated else "left_semi"))

    def returns(self, *columns, **named: Column) -> DataFrame:
        """The projection; group and order it like any DataFrame."""
        return self.frame.select(*columns, *[c.alias(n) for n, c in named.items()])


#: Rows of a frontier that are sent to all tasks, so that edges are not moved; more of them are joined by a shuffle.
SENT = 1 << 12


def _numbered(front: DataFrame) -> DataFrame:
    """A frontier(root, id, path) with a number for each row, which stays as it is."""
    return checkpoint(front.withColumn("n", F.monotonically_increasing_id()))


def _grown(front: DataFrame, before: DataFrame, each: DataFrame) -> DataFrame:
    """The next frontier(root, id, path): the neighbours of a frontier, each by one of the paths to it. Those seen earlier
    from a root are in this frontier or the one before it, as edges go both ways. Of the many ways to a hub a number
    decides, which tasks add up before the shuffle; paths are not moved for it."""
    own = front.select("root", "id", "n")
    own = F.broadcast(own) if own.limit(SENT + 1).count() <= SENT else own
    met = own.join(each, F.col("id") == F.col("here")).groupBy("root", F.col("there").alias("id")).agg(F.min("n").alias("n"))
    seen = front.select("root", "id").unionByName(before.select("root", "id"))
    return met.join(seen, ["root", "id"], "left_anti").join(front.select("n", "path"), "n").select("root", "id", F.concat("path", F.array("id")).alias("path"))


def _met(open_: DataFrame, front: dict[str, DataFrame]) -> DataFrame:
    """(start_id, end_id, path) of the open pairs whose two searches have a node of both frontiers in common."""
    a = front["start_id"].select(F.col("root").alias("start_id"), "id", "n", F.col("path").alias("head"))
    b = front["end_id"].select(F.col("root").alias("end_id"), "id", F.reverse("path").alias("tail"))
    hit = open_.join(a.select("start_id", "id", "n"), "start_id").join(b.select("end_id", "id"), ["end_id", "id"]).groupBy("start_id", "end_id").agg(F.min("n").alias("n"))
    whole = F.concat("head", F.slice("tail", F.lit(2), F.size("tail")))
    return checkpoint(hit.join(a.drop("start_id"), "n").join(b, ["end_id", "id"]).select("start_id", "end_id", whole.alias("path")))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """(start_id, end_id, length, path) for those of pairs(start_id, end_id) that an undirected path of up to `most` edges
    joins: the number of edges of a shortest one, and the ids of its nodes.

    A search grows from all starts and one from all ends, each node once for each root; in each round the one grows whose
    next frontier can have fewer rows: no more than the edges before it, nor than all nodes for each of its open roots. A
    pair is done where its two searches meet, and roots without open pairs stop. So many starts with few ends are found
    from the ends, and hubs are not opened from each of many roots. Both sides of a round are joined by keys; nothing but
    numbers of edges, nodes, roots and open pairs reaches the driver. The files of a round's shuffles go when it is over.
    Pairs with a null have no path; a node is joined with itself by a path of no edges, also if no edge has it.
    """
    spark = edges.sparkSession
    each = incident(checkpoint(edges.select("src", "tgt"))).select("here", "there")
    free(spark)
    degree = checkpoint(each.groupBy("here").agg(F.count("*").alias("edges")))
    nodes = degree.count()
    open_ = checkpoint(pairs.select("start_id", "end_id").dropna().distinct())
    sides = ("start_id", "end_id")
    wanted = lambda c: open_.select(F.col(c).alias("root")).distinct()
    kept = lambda c: front[c].join(wanted(c), "root", "left_semi")
    front = {c: _numbered(wanted(c).select("root", F.col("root").alias("id"), F.array("root").alias("path"))) for c in sides}
    before, done = {c: front[c].limit(0) for c in sides}, []
    for length in range(most + 1):
        if length:
            ahead = {}
            for c in sides:
                found = kept(c).select("id").join(degree, F.col("id") == F.col("here")).agg(F.sum("edges")).first()[0] or 0
                ahead[c] = (min(found, nodes * wanted(c).count()), found)
            side, other = sorted(sides, key=ahead.get)
            near = each
            if length == most:  # only where it meets the other frontier is the last one of use
                ends = kept(other).select(F.col("id").alias("there")).distinct()
                near = each.join(F.broadcast(ends), "there", "left_semi") if ends.limit(SENT + 1).count() <= SENT else each
            free(spark)
            before[side], front[side] = front[side], _numbered(_grown(kept(side), before[side], near))
            free(spark)
        # A path of this length has a node in both frontiers.
        met = _met(open_, front)
        done.append(met.select("start_id", "end_id", F.lit(length).alias("length"), "path"))
        open_ = checkpoint(open_.join(met, ["start_id", "end_id"], "left_anti"))
        if open_.isEmpty():
            break
    free(spark)
    return reduce(DataFrame.unionByName, done)


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 10) -> int | None:
    """Edges on a shortest undirected path; None if there is none of up to `most`."""
    pair = edges.sparkSession.createDataFrame([(start, end)], "start_id string, end_id string")
    found = shortest_paths(edges, pair, most).first()
    return found.length if found else None
