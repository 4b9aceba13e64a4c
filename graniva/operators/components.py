"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.plans.stage import materialize

#: Edges that one task may finish alone.
SINGLE_TASK_EDGES = 500_000


def component_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of their component, for one array of edges."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(v))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return v, v[root]
        root = new


def _forest(batches):
    """Star edges (vertex, smallest vertex) of the components within one partition."""
    kept, parts, n = None, [], 0
    for pdf in batches:
        parts.append(pdf)
        n += len(pdf)
        if n > 200_000:
            kept = _shrunk(parts if kept is None else [kept, *parts])
            parts, n = [], 0
    if parts or kept is not None:
        yield _shrunk(parts if kept is None else [kept, *parts])


def _shrunk(parts: list[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(parts)
    v, r = component_roots(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    own = v != r
    return pd.DataFrame({"src": v[own], "dst": r[own]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, single_task_edges: int = SINGLE_TASK_EDGES, max_rounds: int = 40) -> DataFrame:
    """(vertex, component) of every vertex with an edge, ``component`` being the smallest vertex of its component.

    Each partition first shrinks its edges to a forest. Then every vertex hooks to its smallest neighbour, chains
    are followed to their ends, and the contracted edges go into the next round, which has at most half
    the vertices; when few edges are left, one task finishes. Rows with a null end and self-loops are no edges;
    a vertex that only has self-loops is its own component. Repeated and reversed edges change nothing.
    """
    kind = edges.schema[src].dataType.simpleString()
    schema = f"src {kind}, dst {kind}"
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    loops = pairs.filter("src = dst").select(F.col("src").alias("vertex"))
    cur = materialize(pairs.filter("src <> dst").mapInPandas(_forest, schema), "edges")
    known = cur.select(F.explode(F.array("src", "dst")).alias("vertex")).union(loops).distinct()
    mapping = None  # vertex -> representative, composed over the rounds
    for _ in range(max_rounds):
        n = cur.count()
        if n <= single_task_edges:
            hooks = cur.coalesce(1).mapInPandas(_forest, schema) if n else cur
            hooks = hooks.select(F.col("src").alias("v"), F.col("dst").alias("r"))
            mapping = hooks if mapping is None else _compose(mapping, hooks)
            break
        both = cur.union(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("v")).agg(F.least(F.min("dst"), F.col("v")).alias("r"))
        hooks = materialize(hooks, "hooks")
        while True:
            nxt = hooks.alias("a").join(hooks.select(F.col("v").alias("r"), F.col("r").alias("rr")), "r").select("v", F.col("rr").alias("r"), (F.col("rr") != F.col("r")).alias("moved"))
            nxt = materialize(nxt, "hooks")
            hooks = nxt.select("v", "r")
            if nxt.filter("moved").isEmpty():
                break
        hooks = hooks.filter("v <> r")
        mapping = materialize(hooks if mapping is None else _compose(mapping, hooks), "mapping")
        names = hooks.select(F.col("v").alias("src"), "r")
        step = cur.join(names, "src", "left").select(F.coalesce("r", "src").alias("src"), "dst")
        names = hooks.select(F.col("v").alias("dst"), "r")
        step = step.join(names, "dst", "left").select("src", F.coalesce("r", "dst").alias("dst"))
        cur = materialize(step.filter("src <> dst").mapInPandas(_forest, schema), "edges")
    else:
        raise RuntimeError("components did not converge")
    out = known.join(mapping.select(F.col("v").alias("vertex"), "r"), "vertex", "left")
    return out.select("vertex", F.coalesce("r", "vertex").alias("component"))


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """Mapping ``first`` followed by ``then``, with the vertices that only ``then`` moves."""
    moved = first.join(then.select(F.col("v").alias("r"), F.col("r").alias("rr")), "r", "left").select("v", F.coalesce("rr", "r").alias("r"))
    return moved.union(then.join(first.select("v"), "v", "left_anti").select("v", "r"))
