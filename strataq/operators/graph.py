"""Cycles: strongly connected directories, and the lines that entangle components."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.common import stash
from strataq.functions.text import folded_dir

#: Different edges of one graph up to which one task solves it in memory (about 200 bytes an edge).
TASK_EDGES = 500_000


def _drop_dead_ends(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both a way in and a way out, until none falls away."""
    while True:
        ins = edges.select("g", F.col("b").alias("v")).distinct()
        outs = edges.select("g", F.col("a").alias("v")).distinct()
        core = ins.intersect(outs)
        kept = stash(edges.join(core.withColumnRenamed("v", "a"), ["g", "a"], "left_semi").join(core.withColumnRenamed("v", "b"), ["g", "b"], "left_semi"), "graph")
        before, after = edges.count(), kept.count()
        edges = kept
        if after == before or after == 0:
            return edges


def _spread(edges: DataFrame, start: DataFrame, source: str, target: str, same: bool) -> DataFrame:
    """The greatest label (column c) that reaches each node along the edges, start's own included.
    With same, a label only goes to nodes whose colour (column k) it has."""
    state = start
    while True:
        moves = edges.join(state.select("g", F.col("v").alias(source), "c", *(["k"] if same else [])), ["g", source]).select("g", F.col(target).alias("v"), "c", *([F.col("k").alias("k_from")] if same else []))
        if same:
            moves = moves.join(state.select("g", "v", "k"), ["g", "v"]).where("k = k_from").drop("k_from")
        best = moves.groupBy("g", "v").agg(F.max("c").alias("new"))
        joined = stash(state.join(best, ["g", "v"], "left").withColumn("up", F.greatest("c", "new")), "graph")
        changed = joined.where(F.col("new") > F.coalesce("c", F.lit(""))).limit(1).count()
        state = joined.withColumn("c", F.col("up")).drop("new", "up")
        if not changed:
            return state


def strong_components(edges: DataFrame, group: str, source: str, target: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """(group, component, node) of the strongly connected components with two nodes or more; component is the greatest node's name.

    Groups of at most TASK_EDGES different edges are solved side by side, one
    group in a task's memory at a time; larger ones by colouring(), whatever
    their size. Both are exact and give the same rows.
    """
    graph = stash(edges.where(F.col(source) != F.col(target)).select(F.col(group).alias("g"), F.col(source).cast("string").alias("a"), F.col(target).cast("string").alias("b")).distinct(), "graph")
    large = graph.groupBy("g").count().where(F.col("count") > task_edges).select("g")
    if large.isEmpty():
        found = graph.groupBy("g").applyInPandas(_components_of, _FOUND)
    else:
        large = stash(large, "graph")
        small = graph.join(large, "g", "left_anti").groupBy("g").applyInPandas(_components_of, _FOUND)
        found = small.unionByName(colouring(stash(graph.join(large, "g", "left_semi"), "graph")))
    return found.select(F.col("g").alias(group), F.col("k").alias("component"), F.col("v").alias("node"))


_FOUND = "g string, v string, k string"


def _components_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Components of one group's edges: nodes are numbered, two walks without recursion, the second against the edges in
    the order in which the first left the nodes."""
    names = sorted(set(rows["a"]) | set(rows["b"]))
    number = {n: i for i, n in enumerate(names)}
    ahead, behind = [[] for _ in names], [[] for _ in names]
    for a, b in zip(rows["a"].map(number), rows["b"].map(number)):
        ahead[a].append(b)
        behind[b].append(a)
    left, seen = [], bytearray(len(names))
    for start in range(len(names)):
        if seen[start]:
            continue
        seen[start], path = 1, [(start, iter(ahead[start]))]
        while path:
            node, ways = path[-1]
            for to in ways:
                if not seen[to]:
                    seen[to] = 1
                    path.append((to, iter(ahead[to])))
                    break
            else:
                path.pop()
                left.append(node)
    out, taken = [], bytearray(len(names))
    for start in reversed(left):
        if taken[start]:
            continue
        taken[start], todo, members = 1, [start], []
        while todo:
            node = todo.pop()
            members.append(node)
            for to in behind[node]:
                if not taken[to]:
                    taken[to] = 1
                    todo.append(to)
        if len(members) > 1:
            name = names[max(members)]
            out += [(rows["g"].iloc[0], names[m], name) for m in members]
    return pd.DataFrame(out, columns=["g", "v", "k"])


def colouring(graph: DataFrame) -> DataFrame:
    """(g, v, k) of graphs of any size: dead ends are dropped; the greatest name that reaches a node colours it; the nodes
    from which a colour's namesake is reached back within the colour are its component and leave the graph."""
    found = None
    while True:
        graph = _drop_dead_ends(graph)
        if graph.isEmpty():
            break
        nodes = graph.select("g", F.col("a").alias("v")).distinct()
        coloured = _spread(graph, nodes.withColumn("c", F.col("v")), "a", "b", False).select("g", "v", F.col("c").alias("k"))
        # back from each colour's namesake, within the colour
        seeds = coloured.withColumn("c", F.when(F.col("v") == F.col("k"), F.col("v")).otherwise(F.lit("")))
        reached = _spread(graph, seeds, "b", "a", True).where("c <> ''").select("g", "v", "k")
        part = stash(reached, "graph")
        sizes = part.groupBy("g", "k").count().where("count > 1")
        members = part.join(sizes.select("g", "k"), ["g", "k"], "left_semi")
        found = members if found is None else found.unionByName(members)
        graph = graph.join(part.select("g", F.col("v").alias("a")), ["g", "a"], "left_anti").join(part.select("g", F.col("v").alias("b")), ["g", "b"], "left_anti")
        graph = stash(graph, "graph")
    if found is None:
        found = graph.select("g", F.col("a").alias("v"), F.col("b").alias("k"))
    return found


def import_edges(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(module, from_dir, to_dir, rel, line): imports of scanned packages of the same module. imports has module, rel, dir, path, line; packages module, dir."""
    inside = F.col("path").startswith(F.col("module"))
    to = F.when(F.col("path") == F.col("module"), F.lit(".")).otherwise(F.substring("path", F.length("module") + 2, F.length("path")))
    rows = imports.where(inside).select("module", F.col("dir").alias("from_dir"), to.alias("to_dir"), "rel", "line")
    return rows.join(packages.select("module", F.col("dir").alias("to_dir")).distinct(), ["module", "to_dir"], "left_semi")


def directory_cycles(edges: DataFrame) -> DataFrame:
    """(module, depth, members, from_dir, to_dir, rel, line): imports inside a cycle of directories.

    Directories are folded to 1, 2, ... parts; an import between two packages
    belongs to the shallowest cycle it is part of, and there to its first file and line.
    """
    deep = F.greatest(F.size(F.split("from_dir", "/")), F.size(F.split("to_dir", "/")))
    at = edges.where("from_dir <> '.' AND to_dir <> '.'").withColumn("depth", F.explode(F.sequence(F.lit(1), deep)))
    folded = at.withColumn("a", folded_dir(F.col("from_dir"), F.col("depth"))).withColumn("b", folded_dir(F.col("to_dir"), F.col("depth"))).where("a <> b")
    folded = folded.withColumn("graph", F.concat_ws("\t", "module", F.col("depth").cast("string")))
    members = stash(strong_components(folded, "graph", "a", "b"), "components")
    names = members.groupBy("graph", "component").agg(F.array_sort(F.collect_set("node")).alias("members"))
    left = members.select("graph", F.col("node").alias("a"), "component")
    right = members.select("graph", F.col("node").alias("b"), F.col("component").alias("component_b"))
    inside = folded.join(left, ["graph", "a"]).join(right, ["graph", "b"]).where("component = component_b")
    first = Window.partitionBy("module", "from_dir", "to_dir").orderBy("depth", "rel", "line")
    claimed = inside.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return claimed.join(names, ["graph", "component"]).select("module", "depth", "members", "from_dir", "to_dir", "rel", "line")


def direct_cycles(edges: DataFrame) -> DataFrame:
    """(a, b, weight, lighter_from, lighter_to): pairs of components that depend on each other, each once, with the lighter line; of equals the first."""
    back = edges.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("weight").alias("back"))
    both = edges.join(back, ["from", "to"]).where(F.col("from") < F.col("to"))
    lighter = F.col("weight") <= F.col("back")
    return both.select(F.col("from").alias("a"), F.col("to").alias("b"), F.least("weight", "back").alias("weight"), F.when(lighter, F.col("from")).otherwise(F.col("to")).alias("lighter_from"), F.when(lighter, F.col("to")).otherwise(F.col("from")).alias("lighter_to"))


class _Lines:
    """The lines between one language's components; claims take lines out, in order."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.weight = {(a, b): w for a, b, w in sorted(rows)}
        self.live = dict.fromkeys(self.weight, True)
        self.out: list[tuple[str, str, str, int, str]] = []

    def ways(self) -> dict[str, list[str]]:
        got: dict[str, list[str]] = defaultdict(list)
        for a, b in self.weight:
            if self.live[a, b]:
                got[a].append(b)
        return got

    def mutual(self) -> None:
        """Two lines between the same two components: the lighter is claimed, of equals both."""
        for a, b in self.weight:
            if a < b and (b, a) in self.weight:
                w, v = self.weight[a, b], self.weight[b, a]
                self.live[a, b], self.live[b, a] = w > v, v > w
                lighter = (a, b) if w <= v else (b, a)
                self.out.append(("cyclic", *lighter, min(w, v), f"{a} -> {b} ({w}) and {b} -> {a} ({v}) depend on each other"))

    def ring(self) -> list[tuple[str, str]]:
        """The first cycle that a depth-first walk in name order closes."""
        ways, done = self.ways(), set()
        for start in sorted({x for e in self.weight for x in e}):
            if start in done:
                continue
            path, open_ = [start], [iter(ways[start])]
            on = {start}
            while open_:
                step = next(open_[-1], None)
                if step is None:
                    open_.pop()
                    on.discard(path[-1])
                    done.add(path.pop())
                elif step in on:
                    ring = [*path[path.index(step) :], step]
                    return list(zip(ring, ring[1:]))
                elif step not in done:
                    path.append(step)
                    on.add(step)
                    open_.append(iter(ways[step]))
        return []

    def longer(self) -> None:
        """Cycles of three and more: the lightest line of each, the first on a tie, until none is left."""
        while ring := self.ring():
            a, b = min(ring, key=self.weight.__getitem__)
            self.live[a, b] = False
            self.out.append(("indirect cyclic", a, b, self.weight[a, b], "cycle through " + ", ".join(sorted(f"{x} -> {y}" for x, y in ring))))

    def bypasses(self) -> None:
        """A line no heavier than the lightest line on the other ways between its ends; lines to leaves are none.

        No cycle is left, so whatever lies on a way from a to b is reached from a
        and reaches b. Taking out a bypass leaves a way, so what reaches what is
        worked out once, as bit sets over numbered components.
        """
        names = sorted({x for e in self.weight for x in e})
        number = {n: i for i, n in enumerate(names)}
        lines = {(number[a], number[b]): w for (a, b), w in self.weight.items()}
        leads = {a for a, _ in lines}
        after = [0] * len(names)
        for (a, b), alive in zip(lines, self.live.values()):
            if alive:
                after[a] |= 1 << b
        ahead = [1 << i for i in range(len(names))]
        grown = True
        while grown:
            grown = False
            for i in range(len(names)):
                more = ahead[i]
                for j in _bits(after[i]):
                    more |= ahead[j]
                grown, ahead[i] = grown or more != ahead[i], more
        behind = [sum(1 << i for i in range(len(names)) if ahead[i] >> b & 1) for b in range(len(names))]
        for a, b in sorted(lines):
            if not after[a] >> b & 1 or b not in leads:
                continue
            between = ahead[a] & behind[b]
            lightest = min((lines[x, y] for x in _bits(between) for y in _bits(after[x] & between) if (x, y) != (a, b)), default=None)
            if lightest is not None and lines[a, b] <= lightest:
                after[a] ^= 1 << b
                line = names[a], names[b]
                self.live[line] = False
                self.out.append(("transitive", *line, lines[a, b], f"{line[0]} -> {line[1]} ({lines[a, b]}) duplicates an indirect path whose lightest line is {lightest}"))


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def violations(edges: DataFrame, group: str) -> DataFrame:
    """(group, kind, from, to, weight, detail): mutual lines, then longer cycles, then bypasses; each pass sees what the ones before left.

    The passes depend on their order, so a group runs in one task; its rows are
    at most the square of the number of components, which a decided map bounds.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = _Lines(list(zip(rows["from"], rows["to"], rows["weight"].astype(int))))
        g.mutual(), g.longer(), g.bypasses()
        return pd.DataFrame([(rows[group].iloc[0], *v) for v in g.out], columns=[group, "kind", "from", "to", "weight", "detail"])

    return edges.select(group, "from", "to", "weight").groupBy(group).applyInPandas(run, f"`{group}` string, kind string, `from` string, `to` string, weight long, detail string")


def entanglement(edges: DataFrame, group: str) -> DataFrame:
    """(group, lines, connected, density, total_weight, violations, violation_weight, violation_degree); a group without lines has no row."""
    ends = edges.select(group, F.explode(F.array("from", "to")).alias("end")).groupBy(group).agg(F.countDistinct("end").alias("connected"))
    lines = edges.groupBy(group).agg(F.count(F.lit(1)).alias("lines"), F.sum("weight").alias("total_weight"))
    bad = violations(edges, group).groupBy(group).agg(F.count(F.lit(1)).alias("violations"), F.sum("weight").alias("violation_weight"))
    all_ = lines.join(ends, group).join(bad, group, "left").fillna(0, ["violations", "violation_weight"])
    return all_.select(group, "lines", "connected", (F.col("lines") / F.col("connected")).alias("density"), "total_weight", "violations", "violation_weight", F.coalesce(F.try_divide(F.col("violation_weight"), F.col("total_weight")), F.lit(0.0)).alias("violation_degree"))
