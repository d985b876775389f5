"""Typed relations: reachability, lineage, closure, staleness, bridging, profiles.

Closures of most nodes, and chains, double their reach each round; those of few nodes run over frontiers, each round joining only
the rows that the last one added. Rounds are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

MOST_DEPTH = 20


def list_edges(edges: DataFrame, node: object, direction: str, kind: str | None = None) -> DataFrame:
    """Edges out of or into a node, oldest first."""
    if direction not in ("out", "in"):
        raise ValueError("direction is 'out' or 'in'")
    found = edges.filter(F.col("source_id" if direction == "out" else "target_id") == node)
    return (found.filter(F.col("type") == kind) if kind else found).orderBy("created_at", "source_id", "target_id")


def induced(edges: DataFrame, ids: DataFrame, within: bool = True) -> DataFrame:
    """Edges with both ends among ``ids`` (column id), or with the source among them."""
    out = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return out.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi") if within else out


def reach(roots: DataFrame, steps: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(root, node, depth) of all nodes that ``steps`` (from, to) reach from each root, at their least depth, without the root.

    Cycles end where nothing new is reached. Where most nodes are roots, paths are doubled: ways of up to d steps joined with
    each other are those of up to 2 d, so rounds are the logarithm of the depth. For few roots a frontier goes step by step,
    as ways between all nodes would be wasted.
    """
    steps = stored(steps.select(F.col("from").alias("__from"), F.col("to").alias("__to")).filter("__from is not null and __to is not null").distinct())
    asked = stored(roots.select("root").distinct())
    nodes = steps.select(F.col("__from").alias("root")).distinct()
    if 2 * nodes.join(asked, "root", "left_semi").count() >= nodes.count():
        ways = _doubled_ways(steps, most_depth)
        return ways.join(asked, "root", "left_semi").filter("root <> node").select("root", "node", "depth")
    seen = stored(asked.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    frontier, parts = seen, [seen]
    for depth in range(1, most_depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["__from"]).select("root", F.col("__to").alias("node")).distinct()
        frontier = stored(new.join(_union(parts), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return _union(parts).filter("root <> node")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _doubled_ways(steps: DataFrame, most_depth: int) -> DataFrame:
    """(root, node, depth) of ways of 1 to ``most_depth`` steps between all nodes, at their least depth."""
    power = stored(steps.select(F.col("__from").alias("root"), F.col("__to").alias("node"), F.lit(1).alias("depth")))
    done, length, whole = None, 1, 0

    def then(first: DataFrame | None, second: DataFrame) -> DataFrame:
        if first is None:
            return second
        on = first.withColumnRenamed("node", "__mid").withColumnRenamed("depth", "__d")
        joined = on.join(second.withColumnRenamed("root", "__mid"), "__mid").select("root", "node", (F.col("__d") + F.col("depth")).alias("depth"))
        return stored(first.union(second).union(joined).groupBy("root", "node").agg(F.min("depth").alias("depth")))

    left = most_depth
    while left:
        if left & 1:
            done, whole = then(done, power), whole + length
        left >>= 1
        if left:
            longer = then(power, power)
            if longer.filter(F.col("depth") > length).isEmpty():
                return longer  # no way is longer than those that are known
            power, length = longer, 2 * length
    return done


def reached(starts: DataFrame, steps: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(node) of all that one step or more (from, to) lead to from any start (column node): a frontier of nodes alone."""
    steps = stored(steps.select(F.col("from").alias("node"), F.col("to").alias("__to")).distinct())  # read by every round
    frontier, parts = starts.select("node").distinct(), []
    for _ in range(most_depth):
        new = frontier.join(steps, "node").select(F.col("__to").alias("node")).distinct()
        for p in parts:
            new = new.join(p, "node", "left_anti")
        frontier = stored(new)
        if frontier.isEmpty():
            break
        parts.append(frontier)
    out = starts.select("node").limit(0)
    for p in parts:
        out = out.union(p)
    return out


def reachable_superseders(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): transitive superseders of each root."""
    back = edges.filter("type = 'supersedes'").select(F.col("target_id").alias("from"), F.col("source_id").alias("to"))
    return reach(roots, back)


def suppress_superseded(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results that are not superseded and none of whose superseders stands among the same query's results."""
    roots = results.select(F.col("memory_id").alias("root")).distinct()
    above = reachable_superseders(edges, roots).select(F.col("root").alias("memory_id"), F.col("node").alias("by"))
    there = results.select("qid", F.col("memory_id").alias("by"))
    hidden = above.join(there, "by").select("qid", "memory_id").distinct()
    return results.filter("status <> 'superseded'").join(hidden, ["qid", "memory_id"], "left_anti")


def _chains(edges: DataFrame, roots: DataFrame, most_depth: int, forward: bool) -> DataFrame:
    """(root, path): the chain of superseders (or of what was superseded) from each root, by the oldest edge at each step.

    A chain ends where nothing follows, or what follows is in it already. By pointer doubling: a node's next d nodes, and
    the next d of the last of them, are its next 2 d.
    """
    at, to = ("target_id", "source_id") if forward else ("source_id", "target_id")
    first = Window.partitionBy(at).orderBy("created_at", to)
    step = edges.filter("type = 'supersedes'").withColumn("n", F.row_number().over(first)).filter("n = 1")
    ahead = stored(step.select(F.col(at).alias("at"), F.array(F.col(to)).alias("next")))
    length = 1
    while length < most_depth:
        further = ahead.select(F.col("at").alias("__last"), F.col("next").alias("__more"))
        joined = ahead.withColumn("__last", F.element_at("next", -1)).join(further, "__last", "left")
        ahead = stored(joined.select("at", F.when(F.size("next") == length, F.concat("next", F.coalesce("__more", F.slice("next", 1, 0)))).otherwise(F.col("next")).alias("next")))
        length *= 2
        if ahead.filter(F.size("next") == length).isEmpty():
            break
    asked = roots.select("root").distinct()
    path = F.concat(F.array("root"), F.coalesce(F.slice("next", 1, most_depth), F.array().cast(ahead.schema["next"].dataType)))
    walked = asked.join(ahead, asked["root"] == ahead["at"], "left").select("root", path.alias("path"))
    again = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_position("path", F.element_at("path", i)) < i)
    return walked.withColumn("path", F.when(F.size(again) > 0, F.slice("path", F.lit(1), F.element_at(again, 1) - 1)).otherwise(F.col("path")))


def lineage_heads(edges: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(root, head, depth): end of the chain of superseders, by the oldest edge at each step; the root itself if current."""
    return _chains(edges, roots, most_depth, True).select("root", F.element_at("path", -1).alias("head"), (F.size("path") - 1).alias("depth"))


def lineage(edges: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(root, ancestors, successors, is_current, head): what each root replaced, oldest last, and what replaced it, head last."""
    tail = lambda c: F.slice(c, 2, most_depth)
    up = _chains(edges, roots, most_depth, True).withColumnRenamed("path", "up")
    down = _chains(edges, roots, most_depth, False).withColumnRenamed("path", "down")
    return up.join(down, "root").select("root", tail(F.col("down")).alias("ancestors"), tail(F.col("up")).alias("successors"), (F.size("up") == 1).alias("is_current"), F.element_at("up", -1).alias("head"))


def bridge(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Supersession edges that join the neighbours of each removed node (column id): confidence is the lower of both."""
    sup = edges.filter("type = 'supersedes'")
    into = sup.join(removed.select(F.col("id").alias("target_id")), "target_id").select(F.col("target_id").alias("mid"), F.col("source_id").alias("new"), F.col("confidence").alias("c1"))
    out = sup.join(removed.select(F.col("id").alias("source_id")), "source_id").select(F.col("source_id").alias("mid"), F.col("target_id").alias("old"), F.col("confidence").alias("c2"))
    made = into.join(out, "mid").filter("new <> old").groupBy("new", "old").agg(F.max(F.least("c1", "c2")).alias("confidence"))
    have = sup.select(F.col("source_id").alias("new"), F.col("target_id").alias("old"))
    return made.join(have, ["new", "old"], "left_anti").select(F.col("new").alias("source_id"), F.col("old").alias("target_id"), F.lit("supersedes").alias("type"), "confidence")


def remove_touching(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that touch a removed node."""
    ids = removed.select("id")
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return left.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def stale_after(memories: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id) of active memories derived, over any number of steps, from the changed ones (column id)."""
    steps = edges.filter("type = 'derived_from'").select(F.col("target_id").alias("from"), F.col("source_id").alias("to"))
    hit = reached(changed.select(F.col("id").alias("node")), steps).select(F.col("node").alias("id"))
    return memories.filter("status = 'active'").join(hit, "id", "left_semi").select("id")


def dependency_closure(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, node, depth) over depends_on and derived_from edges."""
    return reach(roots, _needs(edges), depth)


def _needs(edges: DataFrame) -> DataFrame:
    return edges.filter("type in ('depends_on', 'derived_from')").select(F.col("source_id").alias("from"), F.col("target_id").alias("to"))


def limited_closure(edges: DataFrame, roots: DataFrame, depth: int, limit: int) -> DataFrame:
    """(root, node, depth, truncated): a root's dependency closure with at most ``limit`` nodes, the nearest first, smaller ids first.

    A root stops in the round in which it has more than ``limit`` nodes, and takes no more than one over it from any
    round, so the work is bounded by roots times limit times what a node depends on, whatever there is to reach.
    """
    steps = stored(_needs(edges).filter("from is not null and to is not null and from <> to").distinct())
    frontier = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    parts = [frontier]
    for d in range(1, depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["from"]).select("root", F.col("to").alias("node")).distinct()
        fresh = new.join(_union(parts), ["root", "node"], "left_anti")
        nearest = Window.partitionBy("root").orderBy("node")
        fresh = fresh.withColumn("__n", F.row_number().over(nearest)).filter(F.col("__n") <= limit + 1).select("root", "node", F.lit(d).alias("depth"))
        fresh = stored(fresh)
        if fresh.isEmpty():
            break
        parts.append(fresh)
        full = _union(parts[1:]).groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("root")
        frontier = fresh.join(full, "root", "left_anti")
    return bounded_closure(_union(parts).filter("depth > 0"), limit)


def bounded_closure(closure: DataFrame, limit: int) -> DataFrame:
    """A closure (root, node, depth) with at most ``limit`` nodes a root, the nearest first, and ``truncated`` where more were there.

    To stop before the whole closure is made, see ``limited_closure``.
    """
    w = Window.partitionBy("root").orderBy("depth", "node")
    placed = closure.withColumns({"__n": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy("root")) > limit})
    return placed.filter(F.col("__n") <= limit).drop("__n")


def graph_profile(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, key, n): memories by status and, where they have one, by kind, edges by type (a contradiction once), isolated memories."""
    by = lambda c: memories.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(c).alias("measure"), "key", "n")
    status = by("status").union(by("kind")) if "kind" in memories.columns else by("status")
    once = edges.filter("type <> 'contradicts' or source_id < target_id")
    kinds = once.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("measure"), "key", "n")
    touched = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()
    alone = memories.join(touched, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("isolated").alias("measure"), F.lit("all").alias("key"), "n")
    return status.union(kinds).union(alone)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node, a contradiction once."""
    once = edges.filter("type <> 'contradicts' or source_id < target_id")
    return once.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and those of ``new`` that don't exist yet; self-loops are left out and a contradiction is added both ways."""
    back = new.filter("type = 'contradicts'").withColumns({"source_id": F.col("target_id"), "target_id": F.col("source_id")})
    fresh = new.unionByName(back).filter("source_id <> target_id").dropDuplicates(["source_id", "target_id", "type"])
    return edges.unionByName(fresh.join(edges.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], "left_anti").select(edges.columns))


def neighbourhood(edges: DataFrame, node: object, most: int = 20) -> DataFrame:
    """(direction, type, ids): neighbours of a node by direction and type, oldest first, at most ``most`` each."""
    out = edges.filter(F.col("source_id") == node).select(F.lit("out").alias("direction"), "type", F.col("target_id").alias("id"), "created_at")
    into = edges.filter(F.col("target_id") == node).select(F.lit("in").alias("direction"), "type", F.col("source_id").alias("id"), "created_at")
    w = Window.partitionBy("direction", "type").orderBy("created_at", "id")
    some = out.union(into).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return some.groupBy("direction", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))


def link(memories: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) after adding edges, with what follows from them.

    The targets of new supersessions become superseded and what is derived from them stale, each with its version
    counted up; a contradiction is added both ways; edges that exist stay as they are.
    """
    old = new.filter("type = 'supersedes'").select(F.col("target_id").alias("id")).distinct()
    after = add_edges(edges, new)
    stale = stale_after(memories, after, old).withColumn("__to", F.lit("stale"))
    hit = old.withColumn("__to", F.lit("superseded"))
    change = hit.unionByName(stale.join(hit.select("id"), "id", "left_anti"))
    moved = memories.join(change, "id", "left").withColumn("version", F.col("version") + F.col("__to").isNotNull().cast("int"))
    return moved.withColumn("status", F.coalesce("__to", "status")).select(memories.columns), after


def topological(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, nodes): a root's bounded dependency closure (root, node, depth), what is needed before what needs it."""
    import pandas as pd

    need = edges.filter("type in ('depends_on', 'derived_from')").select(F.col("source_id").alias("node"), F.col("target_id").alias("needs"))
    own = closure.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    rows = closure.select("root", "node", "depth").union(own).join(need, "node", "left")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = set(pdf["node"])
        first = pdf.drop_duplicates("node").set_index("node")["depth"]
        needs = {n: sorted({x for x in g["needs"].dropna() if x in inside}, key=lambda x: (first[x], x)) for n, g in pdf.groupby("node")}
        out, seen, stack = [], set(), [(pdf["root"].iloc[0], False)]
        while stack:
            node, done = stack.pop()
            if done:
                out.append(node)
            elif node not in seen:
                seen.add(node)
                stack.append((node, True))
                stack += [(int(x), False) for x in reversed(needs.get(node, []))]
        return pd.DataFrame({"root": [pdf["root"].iloc[0]], "nodes": [[int(x) for x in out]]})

    return rows.groupBy("root").applyInPandas(order, "root long, nodes array<long>")
