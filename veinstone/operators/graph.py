"""Graph operators over edge tables (2.7). Loops only for fixpoints, each round one
join, a distinct and a checkpoint; nothing is gathered on the driver."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.windows import ranked
from veinstone.session import bucketed, cut_lineage, drop_checkpoint, drop_written, rewritten


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def edges(deps: DataFrame, source: str, target: str) -> DataFrame:
    """2.7.1, 2.7.3: distinct (src, dst)."""
    return deps.select(F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def internal(e: DataFrame, roots: DataFrame) -> DataFrame:
    """2.7.2: edges whose target's root package is one of ``roots`` (root)."""
    return e.join(roots, F.substring_index("dst", ".", 1) == F.col("root"), "left_semi")


def _united(table: pa.Table) -> pa.Table:
    """(node, root) of one small graph (u, v)."""
    up: dict = {}
    for pair in zip(table["u"].to_pylist(), table["v"].to_pylist(), strict=True):
        ends = []
        for x in pair:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            ends.append(x)
        up[max(ends)] = min(ends)
    for x in sorted(up):  # a node's next one is smaller and done
        up[x] = up[up[x]]
    kind = table.schema.field("u").type
    return pa.table({"node": pa.array(up.keys(), kind), "root": pa.array(up.values(), kind)})


def components(edges: DataFrame, few: int = 10_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), undirected; root is the smallest
    reachable node. At most ``few`` edges are joined by one task.

    Alternating large and small stars: every round connects each node's larger neighbours
    to its smallest and then its smaller ones; neighbour minima are aggregated before they
    are joined back, so no node's neighbours are ever gathered. The edge table is
    checkpointed each round and the loop ends when it no longer changes.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    kind = e.schema["u"].dataType.simpleString()
    if kind in ("string", "int", "bigint") and e.limit(few + 1).count() <= few:
        return e.groupBy(F.lit(0).alias("one")).applyInArrow(_united, f"node {kind}, root {kind}")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.where("u <> v").distinct(), e)
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).collect()[0]
        if (now.n, now.h) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        state = (now.n, now.h)


def closure(e: DataFrame, start: DataFrame) -> DataFrame:
    """2.7.14: (origin, node, depth): nodes reachable from ``start`` (origin, node), the
    start excluded unless it is reached again. Semi-naive: a round joins only what the last one
    found, with edges that stay where they are. What was found before goes out of the new rows
    once these are as many as it, so all that is known is not moved again in each round; in
    between a row may be found again, with a depth that is no smaller."""
    near = bucketed(e.select("src", "dst"), "src")
    fresh, depth, known, seen, recent, waiting = cut_lineage(start.select("origin", "node").distinct()), 0, 0, [], [], 0
    while True:
        depth += 1
        step = near.join(fresh.select("origin", "node"), F.col("src") == F.col("node")).select("origin", F.col("dst").alias("node")).distinct()
        fresh = cut_lineage(step.withColumn("depth", F.lit(depth)))
        found = fresh.count()
        recent, waiting = [*recent, fresh], waiting + found
        if found and waiting < known:
            continue
        new = _together(recent).groupBy("origin", "node").agg(F.min("depth").alias("depth"))
        if seen:
            new = new.join(_together(seen).select("origin", "node"), ["origin", "node"], "left_anti")
        new = cut_lineage(new, *recent)
        seen, known, recent, waiting = [*seen, new], known + new.count(), [], 0
        fresh = new.where(F.col("depth") == depth)
        if not found or fresh.isEmpty():
            drop_written(near)
            return _together(seen)
        if len(seen) > MANY:
            seen = [cut_lineage(_together(seen))]
            fresh = seen[0].where(F.col("depth") == depth)


def _spread(labels: DataFrame, e: DataFrame) -> DataFrame:
    """(node, label): the smallest label that reaches each node along ``e``. A round sends
    only the labels that the last one changed, until none changes."""
    labels = cut_lineage(labels.withColumn("moved", F.lit(True)))
    while True:
        sent = labels.where("moved").select(F.col("node").alias("from"), F.col("label").alias("sent"))
        came = e.join(sent, F.col("src") == F.col("from")).groupBy("dst").agg(F.min("sent").alias("came"))
        new = labels.join(came, F.col("node") == F.col("dst"), "left").select("node", F.least("label", "came").alias("label"), F.coalesce(F.col("came") < F.col("label"), F.lit(False)).alias("moved"))
        labels = cut_lineage(new, labels)
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")


def _peel(core: DataFrame) -> DataFrame:
    """The edges that lie on a cycle or on a path between two cycles."""
    if core.isEmpty():
        return core
    for _ in range(2):  # without the nodes that reach no cycle, then, against the edges, those that none reaches
        core = cut_lineage(_layers(core)[1].select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return core


#: Tables of rounds that are read as one before they are written together.
MANY = 60
#: Graphs of at most so many edges are done by one task, larger ones in rounds over the cluster.
FEW_EDGES = 10_000


def _strong(table: pa.Table) -> pa.Table:
    """Strongly connected components of one small graph (src, dst), without recursion: a walk
    that notes the earliest open node each node reaches."""
    near: dict[str, list[str]] = {}
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        near.setdefault(a, []).append(b)
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    is_open: set[str] = set()
    found: list[list[str]] = []
    for first in near:
        if first in seen:
            continue
        walk = [(first, iter(near[first]))]
        seen[first] = low[first] = len(seen)
        open_.append(first)
        is_open.add(first)
        while walk:
            node, rest = walk[-1]
            to = next((x for x in rest if x not in seen or x in is_open), None)
            if to is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == seen[node]:
                    at = open_.index(node)
                    found.append(sorted(open_[at:]))
                    is_open -= set(open_[at:])
                    del open_[at:]
            elif to in seen:
                low[node] = min(low[node], seen[to])
            else:
                seen[to] = low[to] = len(seen)
                open_.append(to)
                is_open.add(to)
                walk.append((to, iter(near.get(to, []))))
    found = [c for c in found if len(c) > 1 or c[0] in near.get(c[0], [])]
    return pa.table({"component": [c[0] for c in found], "members": found, "size": [len(c) for c in found]}, schema=pa.schema([("component", pa.string()), ("members", pa.list_(pa.string())), ("size", pa.int64())]))


def _contract(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without its chains: nodes with one edge in and one out. Three tables: edges, in
    which a chain from p to t is the edge (p, t); (node, p, t) of the nodes in chains; and
    (origin, component) of rings that are nothing but a chain.

    A round doubles the steps that each chain node looks ahead, so a chain or ring of n nodes
    takes log2(n) of them."""
    out = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("node"), "to")
    into = e.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select(F.col("dst").alias("node"))
    x = rewritten(out.join(into, "node").select("node", "to", F.col("node").alias("last"), F.col("node").alias("low"), F.lit(True).alias("on")))
    size, steps = x.count(), 1
    while size and steps < 2 * size and not x.where("on").isEmpty():
        ahead = x.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("low").alias("_low"))
        j = x.join(ahead, F.col("to") == F.col("_n"), "left")
        x = rewritten(j.select("node", F.coalesce("_to", "to").alias("to"), F.coalesce("_last", "last").alias("last"), F.least("low", "_low").alias("low"), F.col("_n").isNotNull().alias("on")), x)
        steps *= 2
    rings = x.where("on").select(F.col("node").alias("origin"), F.col("low").alias("component"))
    chain = x.where("NOT on").select("node", "to", "last")
    names = x.select(F.col("node").alias("_x"))
    outside = e.join(names, F.col("src") == F.col("_x"), "left_anti")
    into_chain = outside.join(chain, F.col("dst") == F.col("node")).select(F.col("src").alias("p"), F.col("to").alias("t"), "last")
    rest = outside.join(names, F.col("dst") == F.col("_x"), "left_anti").union(into_chain.select("p", "t")).distinct()
    out = rewritten(rest), rewritten(chain.join(into_chain.select("p", "t", "last"), "last").select("node", "p", "t")), rewritten(rings)
    drop_written(x)
    return out


def _coloured(core: DataFrame) -> DataFrame:
    """(origin, component) of the nodes on cycles, and of some that are alone, by forward-backward
    colouring: each node takes the smallest node that reaches it as its colour; inside a
    colour, the nodes from which that smallest one is reached are its component, which leaves
    the graph. Every round moves one label a node, so nothing grows with pairs of nodes."""
    found = None
    while True:
        core = _peel(core)
        if core.isEmpty():
            return found if found is not None else core.select(F.col("src").alias("origin"), F.col("dst").alias("component"))
        colour = _spread(nodes(core).withColumn("label", F.col("node")), core)
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
        inside = cut_lineage(core.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        start = colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label"))
        back = _spread(start, inside).where("label = 0").select("node")
        comp = cut_lineage(colour.join(back, "node").select(F.col("node").alias("origin"), F.col("label").alias("component")), inside)
        found = comp if found is None else found.unionByName(comp)
        gone = comp.select(F.col("origin").alias("g"))
        core = cut_lineage(core.join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti"), core)


def strong(e: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(origin, component) of every node on a cycle, and of some nodes that are alone; component
    is the smallest node. Chains are drawn together and dead ends cut off, in turns, while a
    tenth of the edges goes; what is left is coloured, or walked by one task if it has at most
    ``few`` edges. Then the chains follow whose both ends are in one component."""
    found = _strong_rounds(e, few)
    low = found.groupBy("component").agg(F.min("origin").alias("_low"))
    return found.join(low, "component").select("origin", F.col("_low").alias("component"))


def _strong_rounds(e: DataFrame, few: int) -> DataFrame:
    rest = cut_lineage(e.where("src <> dst"))
    before, chains, rings = rest.count(), [], []
    while before:
        drawn, inside, ring = _contract(rest)
        chains.append(inside)
        rings.append(ring)
        rest = _peel(drawn)
        now = rest.count()
        if now > 0.9 * before:
            break
        before = now
    if before and before <= few:
        walked = rest.select("src", "dst", F.lit(0).alias("one")).groupBy("one").applyInArrow(_strong, "component string, members array<string>, size long")
        found = walked.select(F.explode("members").alias("origin"), "component")
    else:
        found = _coloured(rest)
    found = rewritten(found)
    for inside, ring in zip(reversed(chains), reversed(rings), strict=True):
        p, t = (found.select(F.col("origin").alias(c), F.col("component").alias(f"c{c}")) for c in "pt")
        within = inside.join(p, "p").join(t, "t").where("cp = ct").select(F.col("node").alias("origin"), F.col("cp").alias("component"))
        found = rewritten(found.unionByName(within.distinct()).unionByName(ring), found)
        drop_written(inside)
        drop_written(ring)
    return found


def cycles(e: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """2.7.4: (component, members, size): strongly connected components of several nodes,
    and self-loops. At most ``few`` edges are walked by one task, others by :func:`strong`."""
    core = cut_lineage(e)
    if core.limit(few + 1).count() <= few:
        return core.select("src", "dst", F.lit(0).alias("one")).groupBy("one").applyInArrow(_strong, "component string, members array<string>, size long")
    loops = cut_lineage(core.where("src = dst").select(F.col("src").alias("origin"), F.col("src").alias("component")))
    found = cut_lineage(strong(core, few))
    every = found.unionByName(loops.join(found.select("origin"), "origin", "left_anti"))
    out = every.groupBy("component").agg(F.array_sort(F.collect_list("origin")).alias("members"), F.count("*").alias("size"))
    alone = loops.select(F.col("component").alias("_loop"))
    return out.join(alone, F.col("component") == F.col("_loop"), "left").where("size > 1 OR _loop IS NOT NULL").drop("_loop")


def _layers(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, depth) of the nodes that reach no cycle, and the edges of all others: the nodes
    without an edge out have depth 1 and leave, those that then have none depth 2, and so on.

    A round joins the edges, which stay where they are, only with the nodes that have left in
    the last one, and counts for the nodes before them how many of their edges are gone; nodes
    that have lost some but not all wait. So every edge moves once, whatever the rounds."""
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    into = bucketed(e.join(out, "src").select("src", "dst", "n"), "dst")
    gone = cut_lineage(_sinks(e).withColumn("depth", F.lit(1)))
    done, states, waiting, depth = [gone], [gone], None, 1
    while not gone.isEmpty():
        depth += 1
        came = into.join(gone.select("node"), F.col("dst") == F.col("node")).groupBy("src").agg(F.min("n").alias("n"), F.count("*").alias("lost")).withColumnRenamed("src", "node")
        if waiting is not None:
            came = came.unionByName(waiting).groupBy("node").agg(F.min("n").alias("n"), F.sum("lost").alias("lost"))
        state = cut_lineage(came)
        gone, waiting = state.where("lost = n").select("node", F.lit(depth).alias("depth")), state.where("lost < n")
        done, states = [*done, gone], [*states, state]
        if len(done) > MANY:  # the last state is still waited for
            done, states = [cut_lineage(_together(done), *states[:-1])], [states[-1]]
            states = [done[0], *states]
    drop_written(into)
    d = _together(done)
    return d, e.join(d.select(F.col("node").alias("_s")), F.col("src") == F.col("_s"), "left_anti")


def _by_visits(near: dict[str, list[str]], best: dict, alone, longer, closing) -> dict:
    """Values of all nodes of ``near`` by visit order: nodes and neighbours by name; a
    neighbour that is being visited counts as ``closing`` says, one in ``best`` as it stands there."""
    for first in sorted(near):
        if first in best:
            continue
        active, value = {first}, {first: alone(first)}
        stack = [(first, iter(sorted(near[first])))]
        while stack:
            node, rest = stack[-1]
            to = next(rest, None)
            if to is None:
                stack.pop()
                active.discard(node)
                best[node] = value.pop(node)
                if stack:
                    value[stack[-1][0]] = longer(stack[-1][0], value[stack[-1][0]], best[node])
            elif to in best or to in active:
                value[node] = longer(node, value[node], best[to] if to in best else closing(to))
            else:
                active.add(to)
                value[to] = alone(to)
                stack.append((to, iter(sorted(near[to]))))
    return best


def _visited(rest: DataFrame, known: DataFrame, column: str, kind: str, rules: tuple, most: int) -> DataFrame:
    """(node, column) of the nodes of ``rest`` (edges of nodes that reach a cycle). What a
    visit finds depends on all visits before it, so one task does them all; ``most`` edges."""
    if rest.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges lie on a cycle or lead to one; their longest paths depend on one order of visits")

    def run(table: pa.Table) -> pa.Table:
        near: dict[str, list[str]] = {}
        best: dict = {}
        for src, dst, value in zip(*(table.column(c).to_pylist() for c in ("src", "dst", "value")), strict=True):
            near.setdefault(src, []).append(dst)
            if value is not None:
                best[dst] = tuple(value) if isinstance(value, list) else value
        found = _by_visits(near, best, *rules)
        names = sorted(near)
        return pa.table({"node": names, column: [list(found[n]) if isinstance(found[n], tuple) else found[n] for n in names]}).cast(schema)

    schema = pa.schema([("node", pa.string()), (column, pa.int32() if kind == "int" else pa.list_(pa.string()))])
    value = known.select(F.col("node").alias("_n"), F.col(column).alias("value"))
    rows = rest.join(value, F.col("dst") == F.col("_n"), "left").select("src", "dst", "value", F.lit(0).alias("one"))
    return rows.groupBy("one").applyInArrow(run, f"node string, {column} {kind}")


_DEPTH_RULES = (lambda n: 1, lambda n, old, tail: max(old, 1 + tail), lambda n: 0)
_PATH_RULES = (lambda n: (n,), lambda n, old, tail: min(old, (n, *tail), key=lambda p: (-len(p), p)), lambda n: (n,))


def _sinks(e: DataFrame) -> DataFrame:
    """Nodes without an edge out, which a walk of all edges does not return."""
    return e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def depths(e: DataFrame, most: int = 1_000_000, few: int = FEW_EDGES) -> DataFrame:
    """2.7.5: (node, depth): nodes on the longest path from each node. Nodes that reach a
    cycle are done by visit order (:func:`_visited`), as are graphs of at most ``few`` edges."""
    e = cut_lineage(e)
    if e.limit(few + 1).count() <= few:
        ends = _sinks(e).withColumn("depth", F.lit(1))
        return _visited(e, ends, "depth", "int", _DEPTH_RULES, most).unionByName(ends)
    done, rest = _layers(e)
    return done if rest.isEmpty() else done.unionByName(_visited(rest, done, "depth", "int", _DEPTH_RULES, most))


def depth_profile(d: DataFrame) -> DataFrame:
    """2.7.6: maximum, average and p95 = sorted[ceil(.95 n) - 1]."""
    p95 = ranked(d, [], "depth", {"p95": lambda n: F.ceil(n * F.lit(0.95))})
    return d.agg(F.max("depth").alias("max_depth"), F.bround(F.avg("depth"), 4).alias("avg_depth")).join(F.broadcast(p95))


def _top_paths(paths: DataFrame, k: int) -> DataFrame:
    return paths.select("path").distinct().withColumn("length", F.size("path")).orderBy(F.desc("length"), "path").limit(k).select("length", "path")


def _leading(e: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """The edges of all longest paths of the nodes that may have one of the k longest: of the
    deepest depths that have k nodes or more. All edges, if these are all depths. The edges of
    a graph without cycles lie sorted by the depth (node, depth) of their targets, so that a
    depth looks at its own alone."""
    sizes = sorted(((r.depth, r.n) for r in d.groupBy("depth").agg(F.count("*").alias("n")).collect()), reverse=True)
    low, found = sizes[0][0], 0
    for low, n in sizes:
        found += n
        if found >= k:
            break
    if low == 1:
        return e
    tight = e.join(d.select(F.col("node").alias("_n"), F.col("depth").alias("at")), F.col("dst") == F.col("_n")).select("src", "dst", "at")
    tight = rewritten(tight.repartitionByRange("at", "src").sortWithinPartitions("at"))
    want, kept = None, []
    for depth in range(sizes[0][0], 1, -1):
        own = d.where(F.col("depth") == depth).select("node") if depth >= low else None
        want = own if want is None else want if own is None else want.union(own).distinct()
        part = cut_lineage(tight.where(F.col("at") == depth - 1).join(want, F.col("src") == F.col("node")).select("src", "dst"))
        kept.append(part)
        want = part.select(F.col("dst").alias("node")).distinct()
        if len(kept) > MANY:
            kept = [cut_lineage(_together(kept))]
    out = cut_lineage(_together(kept), *kept)
    drop_written(tight)
    return out


def chains(e: DataFrame, k: int = 5, most: int = 1_000_000, few: int = FEW_EDGES) -> DataFrame:
    """2.7.7: each node's longest path (the first by order of its nodes), and of those the k
    longest. Nodes that reach a cycle are done by visit order; a path may end in a node
    that it has already. Graphs of at most ``few`` edges are done by one task."""
    e = cut_lineage(e)
    if e.limit(few + 1).count() <= few:
        ends = _sinks(e).withColumn("path", F.array("node"))
        return _top_paths(_visited(e, ends, "path", "array<string>", _PATH_RULES, most).unionByName(ends), k)
    d, rest = _layers(e)
    if whole := rest.isEmpty():
        e = _leading(e, d, k)
        if e.limit(few + 1).count() <= few:
            return _top_paths(_visited(e, _sinks(e).withColumn("path", F.array("node")), "path", "array<string>", _PATH_RULES, most), k)
    at = cut_lineage(d.where("depth = 1").select("node", F.array("node").alias("path")))
    done = at
    for n in range(2, (d.agg(F.max("depth")).collect()[0][0] or 0) + 1):
        longer = e.join(at, F.col("dst") == F.col("node")).select("src", "path").join(d.where(F.col("depth") == n).select(F.col("node").alias("src")), "src")
        at = cut_lineage(longer.groupBy(F.col("src").alias("node")).agg(F.min(F.concat(F.array("src"), "path")).alias("path")))
        done = cut_lineage(done.unionByName(at), *([done] if n > 2 else []))
    if not whole:
        done = done.unionByName(_visited(rest, done, "path", "array<string>", _PATH_RULES, most))
    return _top_paths(done, k)


def fan(e: DataFrame) -> DataFrame:
    """2.7.9: distinct neighbours in and out, instability and hub balance per node."""
    g = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    total, low, high = F.col("fan_in") + F.col("fan_out"), F.least("fan_in", "fan_out"), F.greatest("fan_in", "fan_out")
    return g.withColumn("instability", F.bround(F.col("fan_out") / total, 4)).withColumn("hub_balance", F.bround(low / high, 4))


def rollup(e: DataFrame, depth: int) -> DataFrame:
    """2.7.10: edges between name prefixes, without loops, weighted by count."""
    p = e.select(F.substring_index("src", ".", depth).alias("src"), F.substring_index("dst", ".", depth).alias("dst"))
    return p.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def unwind_candidates(f: DataFrame, k: int = 25) -> DataFrame:
    """2.7.12: nodes with their signals (high fan-in by p90, hub, unstable), most first."""
    p90 = f.agg(F.percentile("fan_in", F.lit(0.9)).alias("p90"))
    signals = F.array_compact(F.array(F.when(F.col("fan_in") >= F.col("p90"), "high_fan_in"), F.when(F.col("hub_balance") >= 0.5, "hub"), F.when(F.col("instability") >= 0.8, "unstable")))
    rows = f.join(F.broadcast(p90)).select("node", "fan_in", signals.alias("signals")).where(F.size("signals") > 0)
    return rows.orderBy(F.desc(F.size("signals")), F.desc("fan_in"), "node").limit(k)


def dependents(e: DataFrame, origins: DataFrame) -> DataFrame:
    """2.7.13: (origin, dependent) one step against the edges; ``origins`` has (origin)."""
    return e.join(origins, F.col("dst") == F.col("origin")).select("origin", F.col("src").alias("dependent")).where("origin <> dependent").distinct()


def transitive_dependents(e: DataFrame, origins: DataFrame) -> DataFrame:
    """2.7.14: all steps against the edges, the origin excluded."""
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, origins.select("origin", F.col("origin").alias("node"))).where("origin <> node").select("origin", F.col("node").alias("dependent"), "depth")


def cohort_members(groups: DataFrame, origins: DataFrame) -> DataFrame:
    """2.7.15: other paths in groups (group, path) that an origin (path) is in."""
    mine = groups.join(origins, groups["path"] == origins["origin"]).select("group", "origin").distinct()
    return groups.join(mine, "group").where("path <> origin").select("origin", "path").distinct()


def radius_level(direct) -> F.Column:
    """2.7.17."""
    return F.when(direct == 0, "low").when(direct <= 5, "medium").otherwise("high")


def name_search(names: DataFrame, column: str, wanted: str) -> DataFrame:
    """2.7.21: the names of the narrowest tier that has any: equal, token, prefix, substring."""
    low, want = F.lower(F.col(column)), wanted.lower()
    tier = F.when(low == want, 0).when(F.array_contains(F.split(low, "[._: -]"), want), 1).when(low.startswith(want), 2).when(low.contains(want), 3)
    hits = names.select(F.col(column).alias("name"), tier.alias("tier")).where("tier IS NOT NULL").distinct()
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).select("name", "tier")


def forest(ops: DataFrame) -> DataFrame:
    """2.7.23, 2.7.24: operations (id, parent, at) with root, depth and offset from the
    root's start; an unknown parent makes a root. Operations in or under a circle of
    parents have no root: no forest holds them.

    Pointers jump: a round takes each operation from the ancestor that it knows to the one
    that this one knows, so a tree of depth d needs log2(d) rounds.
    """
    known = ops.select(F.col("id").alias("_known"))
    base = cut_lineage(ops.join(known, F.col("parent") == F.col("_known"), "left").select("id", F.col("_known").alias("parent"), "at"))
    up = base.select("id", F.coalesce("parent", "id").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNull().alias("top"))
    done, open_ = up.where("top"), cut_lineage(up.where("NOT top"))
    total, reach = open_.count(), 1
    while reach <= total:  # after it, only circles are open
        reach *= 2
        step = done.unionByName(open_).select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("depth").alias("_d"), F.col("top").alias("_t"))
        new = cut_lineage(open_.join(step, F.col("to") == F.col("_i")).select("id", F.col("_to").alias("to"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_t").alias("top")), open_)
        done, open_ = done.unionByName(new.where("top")), new.where("NOT top")
        if open_.isEmpty():
            break
    roots = base.where("parent IS NULL").select(F.col("id").alias("root"), F.col("at").alias("root_at"))
    offset = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("root_at").cast("timestamp"))
    rows = done.select("id", F.col("to").alias("root"), "depth").join(base.select("id", "at"), "id").join(roots, "root")
    return rows.select("id", "root", "depth", F.floor(offset / 1000).alias("offset_ms"))
