"""Graph tables: nodes (id, ...), edges (source, target, edge_type)."""

import ast
from collections import deque
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.source import brace_calls
from sextant.operators.chunking import _table
from sextant.sources.files import checkpoint_folder


def neighbors(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """id, neighbor: out-neighbours that are known nodes."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    return e.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("neighbor")).distinct()


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    calls = edges.where("edge_type = 'calls'").join(nodes.select(F.col("id").alias("source")), "source", "left_semi")
    return calls.select(F.col("target").alias("id"), F.col("source").alias("caller")).distinct()


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbors(nodes, edges, "calls").withColumnRenamed("neighbor", "callee")


#: Rows of a written table that are sent to all tasks, so that the edges stay where they are.
SMALL = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A written table (whose size the planner doesn't know) with a hint, if it has few rows."""
    return F.broadcast(df) if rows <= SMALL else df


def reaching(edges: DataFrame, end, most: int | None = None) -> DataFrame:
    """id, distance of every node from which end can be reached, by `most` edges if given, end included.

    A round for each edge of the longest distance.  A round joins the edges as they are: only what it finds is made distinct.
    """
    checkpoint_folder(edges.sparkSession)
    e = edges.select("source", "target").where("source <> target")
    front = edges.sparkSession.createDataFrame([(end, 0)], f"id {e.schema['source'].dataType.simpleString()}, distance int")
    found, away, size = front, 0, 1
    while most is None or away < most:
        away += 1
        step = e.join(_small(front.withColumnRenamed("id", "target").select("target"), size), "target").select(F.col("source").alias("id")).distinct()
        front = step.join(found, "id", "left_anti").withColumn("distance", F.lit(away)).checkpoint()
        size = front.count()
        if not size:
            break
        found = found.unionByName(front).checkpoint()
    return found


def paths(edges: DataFrame, start, end, cutoff: int | None = None) -> DataFrame:
    """path: all simple paths of at most cutoff edges (by default of any length).

    A frontier grows by one join a step until it is empty, over the edges alone that lead to a node from which end can be
    reached within the edges that are left.  Only those edges are made distinct and kept; repeated ones may come in.  There can
    be as many simple paths as subsets of nodes; what bounds them is the cutoff.
    """
    e = edges.select("source", "target").where("source <> target")
    near = reaching(e, end, None if cutoff is None else cutoff - 1).withColumnRenamed("id", "target")
    e = e.join(_small(near, near.count()), "target").select("source", "target", "distance").distinct().persist()
    front = e.sparkSession.createDataFrame([([start],)], f"path array<{e.schema['source'].dataType.simpleString()}>")
    found, grown = front.where("false"), 0
    while cutoff is None or grown < cutoff:
        grown += 1
        near = e if cutoff is None else e.where(F.col("distance") <= cutoff - grown)
        front = front.withColumn("source", F.element_at("path", -1)).join(near, "source").where(~F.array_contains("path", F.col("target")))
        front = front.select(F.concat("path", F.array("target")).alias("path")).checkpoint()
        found = found.unionByName(front.where(F.element_at("path", -1) == F.lit(end)))
        front = front.where(F.element_at("path", -1) != F.lit(end))
        if not front.limit(1).count():
            break
    e.unpersist()
    return found


def known(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The paths without the nodes that aren't in nodes (id), each in its order.  nodes is read once, for those of the paths."""
    one = paths.withColumn("_n", F.monotonically_increasing_id()).checkpoint()
    each = one.select("_n", F.posexplode("path").alias("_at", "id"))
    held = each.select("id").distinct().checkpoint()
    there = nodes.select("id").join(_small(held, held.count()), "id", "left_semi").distinct()
    kept = each.join(there, "id", "left_semi")
    back = kept.groupBy("_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("_path"))
    return one.join(back, "_n", "left").select(F.coalesce("_path", F.array().cast(paths.schema["path"].dataType)).alias("path"))


def get_node(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the ids given; unknown ids have no row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def shortest_path(edges: DataFrame, start, end, most: int | None = None) -> DataFrame:
    """One shortest path (the least of its length; if `most` is given, of at most that many edges).

    Searched from both ends: the smaller front grows by a join, a node is visited once from each side, and the first nodes that
    both fronts hold are the middles of the shortest paths.
    """
    e = edges.select("source", "target").where("source <> target").distinct().persist()
    kind = e.schema["source"].dataType.simpleString()
    # Plans are cut each round: else a round would hold the plans of all rounds before it.
    checkpoint_folder(e.sparkSession)
    one = lambda x: e.sparkSession.createDataFrame([(x, [x])], f"node {kind}, path array<{kind}>")
    fronts = [one(start), one(end)]
    seen, sizes, grown, best = [f.select("node") for f in fronts], [1, 1], 0, None
    while True:
        a, b = fronts[0].withColumnRenamed("path", "_a"), fronts[1].withColumnRenamed("path", "_b")
        best = a.join(b, "node").agg(F.min(F.concat("_a", F.expr("slice(_b, 2, size(_b))")))).first()[0]
        if best is not None or grown == most:
            break
        side = 0 if sizes[0] <= sizes[1] else 1
        at, to = ("source", "target") if side == 0 else ("target", "source")
        step = fronts[side].join(e, F.col("node") == F.col(at)).withColumn("node", F.col(to))
        path = F.concat("path", F.array("node")) if side == 0 else F.concat(F.array("node"), "path")
        step = step.select("node", path.alias("path")).join(seen[side], "node", "left_anti")
        fronts[side] = step.groupBy("node").agg(F.min("path").alias("path")).checkpoint()
        sizes[side], grown = fronts[side].count(), grown + 1
        if not sizes[side]:
            break
        seen[side] = seen[side].unionByName(fronts[side].select("node"))
        if not grown % 8:
            seen = [x.repartition("node").checkpoint() for x in seen]
    e.unpersist()
    return e.sparkSession.createDataFrame([] if best is None else [(best,)], f"path array<{kind}>")


def _contract(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Vertices, edges, single vertices and the steps by which chains were shortened.

    A vertex with one edge in and one out is in the component of its neighbours if they share one, and else its own.  So it
    can go, its edges becoming one.  Those go at once whose coin falls so and whose predecessor stays: a quarter of a chain in
    a round, and vertices without an edge in or out go as they are found.
    """
    done, steps, size, turn = v.where("false"), [], v.count(), 0
    while size:
        into = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"), F.min("source").alias("u"))
        out = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"), F.min("target").alias("w"))
        d = v.join(into, "id", "left").join(out, "id", "left").checkpoint()
        lone = d.where("n_in is null or n_out is null").select("id")
        coin = d.where("n_in = 1 and n_out = 1").where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0).select("id", "u", "w")
        gone = coin.join(coin.select(F.col("id").alias("u")), "u", "left_anti").select("id", "u", "w").checkpoint()
        done = done.unionByName(lone)
        v = d.select("id").join(lone, "id", "left_anti").join(gone, "id", "left_anti").checkpoint()
        short = gone.where("u <> w").select(F.col("u").alias("source"), F.col("w").alias("target"))
        e = _between(v, e.unionByName(short).distinct()).checkpoint()
        steps.append(gone)
        left, turn = v.count(), turn + 1
        if size - left <= size // 50:
            break
        size = left
    return v, e, done, steps


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its greatest id): strongly connected; nothing grows beyond the edges.

    Chains are shortened first, in rounds that grow with the logarithm of their length, and put back at the end.
    """
    checkpoint_folder(vertices.sparkSession)
    v = vertices.select("id").distinct().checkpoint()
    v, e, lone, steps = _contract(v, edges.select("source", "target").where("source <> target").distinct().checkpoint())
    found = _by_colours(v, e).unionByName(lone.withColumn("component", F.col("id"))).checkpoint()
    for gone in reversed(steps):
        of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        both = gone.join(of("u"), "u", "left").join(of("w"), "w", "left")
        found = found.unionByName(both.select("id", F.when(F.col("of_u") == F.col("of_w"), F.col("of_u")).otherwise(F.col("id")).alias("component"))).checkpoint()
    name = found.groupBy("component").agg(F.max("id").alias("name"))
    return found.join(name, "component").select("id", F.col("name").alias("component"))


def _by_colours(v: DataFrame, e: DataFrame) -> DataFrame:
    """id, component by trimming and colours.

    Vertices without an edge in or out are components of their own and go, round by round.  Then the greatest id that
    reaches a vertex is its colour; those of a colour that reach back to the vertex it is named after are a component.
    """
    cut = lambda df: df.checkpoint()
    end = lambda df, c: df.select(F.col(c).alias("id")).distinct()
    done, size = v.where("false").withColumn("component", F.col("id")), v.count()
    while size:
        while True:
            keep = cut(v.join(end(e, "source"), "id", "left_semi").join(end(e, "target"), "id", "left_semi"))
            left = keep.count()
            done = done.unionByName(v.join(keep, "id", "left_anti").withColumn("component", F.col("id")))
            v = keep
            if left == size:
                break
            size, e = left, cut(_between(v, e))
        if not size:
            break
        color = v.withColumn("color", F.col("id"))
        while True:
            best = color.join(e, color.id == e.source).groupBy(F.col("target").alias("id")).agg(F.max("color").alias("more"))
            nxt = cut(color.join(best, "id", "left").select("id", F.greatest("color", "more").alias("color"), (F.col("more") > F.col("color")).alias("new")))
            color = nxt.select("id", "color")
            if not nxt.where("new").limit(1).count():
                break
        back = e.join(color.withColumnRenamed("id", "source"), "source").select("source", F.col("target").alias("id"), "color")
        front = cut(color.where("id = color"))
        found = front
        while front.limit(1).count():
            step = front.join(back, ["id", "color"]).select(F.col("source").alias("id"), "color").distinct()
            front = cut(step.join(found, ["id", "color"], "left_anti"))
            found = found.unionByName(front)
        found = cut(found)
        done = done.unionByName(found.withColumnRenamed("color", "component"))
        v = cut(v.join(found, "id", "left_anti"))
        size, e = v.count(), cut(_between(v, e))
    return done


def _between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    for c in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    return edges.select("source", "target", *(c for c in edges.columns if c not in ("source", "target")))


def edges_between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are known."""
    return _between(nodes, edges)


def of_type(df: DataFrame, kind: str | None, col: str) -> DataFrame:
    """All rows, or those of one node_type or edge_type."""
    return df if kind is None else df.where(F.col(col) == kind)


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes take the place of those with their ids."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new)


def add_edges(edges: DataFrame, new: DataFrame, merge: bool = False) -> DataFrame:
    """New edges are appended; with merge, one edge of a type stays between two nodes."""
    both = edges.unionByName(new)
    return both.dropDuplicates(["source", "target", "edge_type"]) if merge else both


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges (distinct), is_dag, components (strongly connected): one row."""
    spark = nodes.sparkSession
    e = edges.select("source", "target").distinct()
    every = nodes.select("id").unionByName(e.select(F.col("source").alias("id"))).unionByName(e.select(F.col("target").alias("id"))).distinct()
    scc = components(every, e).agg(F.countDistinct("component")).scalar()
    loops = e.where("source = target").agg(F.count("*")).scalar()
    n = every.agg(F.count("*")).scalar()
    return spark.range(1).select(n.alias("nodes"), e.agg(F.count("*")).scalar().alias("edges"), ((loops == 0) & (scc == n)).alias("is_dag"), scc.alias("components"))


def import_rows(code: str):
    """module, alias, level, names, line of every import, breadth first."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                yield a.name, a.asname, 0, [], n.lineno
        elif isinstance(n, ast.ImportFrom):
            yield n.module or "", n.names[0].asname, n.level, [a.name for a in n.names], n.lineno


def imports(docs: DataFrame) -> DataFrame:
    return _table(docs, import_rows, "module string, alias string, level int, names array<string>, line int")


def module_dependencies(docs: DataFrame, exclude_stdlib: bool = True, exclude_relative: bool = True) -> DataFrame:
    """doc_id, modules: sorted top-level modules."""
    import sys

    found = imports(docs)
    if exclude_relative:
        found = found.where("level = 0")
    found = found.where("module <> ''").select("doc_id", F.split("module", r"\.")[0].alias("m"))
    if exclude_stdlib:
        found = found.where(~F.col("m").isin(sorted(sys.stdlib_module_names)))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("m")).alias("modules"))


def call_rows(code: str):
    """Definitions (kind 'node') and calls (kind 'edge'): names of enclosing function and last part of the callee."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return
    nodes, edges = {}, []
    todo = deque([(tree, None, None)])
    while todo:
        n, cls, fn = todo.popleft()
        if isinstance(n, ast.ClassDef):
            nodes[n.name] = ("class", n.lineno)
            cls = n.name
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            nodes[f"{cls}.{n.name}" if cls else n.name] = ("method" if cls else "function", n.lineno)
            fn = n.name
        elif isinstance(n, ast.Call) and fn:
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                edges.append((fn, name, n.lineno))
        todo.extend((c, cls, fn) for c in ast.iter_child_nodes(n))
    for name, (kind, line) in nodes.items():
        yield "node", name, kind, line
    for s, t, line in edges:
        if t in nodes:
            yield "edge", s, t, line


#: Names that a language goes by.
CALL_LANGUAGES = {"python": ["python", "py"], "typescript": ["typescript", "ts", "tsx"], "go": ["go", "golang"]}


def call_graph(docs: DataFrame, language: str | Column = "python") -> DataFrame:
    """doc_id, kind, name, other, line: nodes with their type, edges from caller to a callee that is defined.

    The language may be a column; sources of other languages give no rows.
    """
    name = F.lower(F.lit(language))
    out = None
    for known, aliases in CALL_LANGUAGES.items():
        rows = call_rows if known == "python" else partial(brace_calls, language=known)
        found = _table(docs.where(name.isin(aliases)), rows, "kind string, name string, other string, line int")
        out = found if out is None else out.unionByName(found)
    return out


def graph_tables(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, id, name, node_type, line_number) and edges (doc_id, source, target, edge_type, line) of call graphs."""
    nodes = calls.where("kind = 'node'").select("doc_id", F.col("name").alias("id"), F.element_at(F.split("name", r"\."), -1).alias("name"), F.col("other").alias("node_type"), F.col("line").alias("line_number"))
    edges = calls.where("kind = 'edge'").select("doc_id", F.col("name").alias("source"), F.col("other").alias("target"), F.lit("calls").alias("edge_type"), "line")
    return nodes, edges
