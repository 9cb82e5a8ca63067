"""Embedding near-duplicates by a forest of random-projection trees.

Trees split recursively near the median of a random projection, where few linked pairs
are parted; a band around each cut goes to both sides (spill), and a node in which every
cut parts many stays whole. All vectors of a leaf are compared, in double precision, and
links found in several leaves count once: a pair counts in the least leaf that both
share. Trees are fit on a sample of at most ``sample`` distinct vectors; every vector is
indexed. A leaf beyond ``most_leaf`` rows is compared in pairs of parts, a task each.

Identical vectors are one class from the start, so a very common vector costs one row.

Defined results: a vector that is null, empty, all zero, or holds a null or non-finite
component links with nothing (n_links 0, its own component); vectors of different
lengths don't link; repeated ids are rows of their own that link as their vectors do; a
null id is the least only where a component has no other; labels and other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, scratch, with_component

SPILL = 0.05
#: Share of the linked pairs of a node that a cut may part.
MOST_PARTED = 0.1


def fit_tree(x: np.ndarray, depth: int, rng: np.random.Generator, threshold: float, least: float = 16) -> list:
    """A node is [direction, low, cut, high, left, right]; a leaf is None. Stops at ``least`` rows of the sample.

    Where vectors of the node are linked, the cut of several that parts the fewest of them
    is taken; where it still parts over MOST_PARTED of many, the node stays whole.
    """
    if depth == 0 or len(x) < 2 * max(least, 16):
        return None
    some = x[rng.permutation(len(x))[:512]]
    i, j = np.nonzero(np.triu(some @ some.T >= threshold, 1))
    best = None
    for _ in range(4 if len(i) else 1):
        d = rng.standard_normal(x.shape[1])
        p, q = x @ d, some @ d
        u, v = np.minimum(q[i], q[j]), np.maximum(q[i], q[j])
        for at in (0.5, 0.4, 0.6, 0.3, 0.7) if len(i) else (0.5,):
            low, cut, high = np.quantile(p, [at - SPILL, at, at + SPILL])
            parted = int(((u < low) & (v > high)).sum())
            if low < high and (best is None or parted < best[0]):
                best = (parted, d, low, cut, high, p)
    if best is None or (best[0] > MOST_PARTED * len(i) and len(i) >= 32):
        return None
    _, d, low, cut, high, p = best
    return [d, low, cut, high, fit_tree(x[p <= high], depth - 1, rng, threshold, least), fit_tree(x[p >= low], depth - 1, rng, threshold, least)]


def leaves_of(tree: list, x: np.ndarray) -> list[list[int]]:
    """For each row of x the leaves (numbers within the tree, in preorder) that it falls into."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    n = 0
    stack = [(tree, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if node is None:
            for r in rows:
                out[r].append(n)
            n += 1
            continue
        d, low, _, high, left, right = node
        p = x[rows] @ d
        stack += [(right, rows[p >= low]), (left, rows[p <= high])]
    return out


def count_leaves(tree: list) -> int:
    return 1 if tree is None else count_leaves(tree[4]) + count_leaves(tree[5])


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the least number above -1 that both padded rows hold."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return np.where(same.any(2), a, np.iinfo(a.dtype).max).min(1)


def _padded(lists: list, dtype=np.int32) -> np.ndarray:
    w = max(map(len, lists))
    out = np.full((len(lists), w), -1, dtype)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Roots after the pairs are joined (the least row of each tree), and the pairs that joined two trees."""
    edges = []
    while len(a):
        p, q = root[a], root[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        high, first = np.unique(np.maximum(p, q), return_index=True)
        root[high] = np.minimum(p, q)[first]
        edges += zip(a[first].tolist(), b[first].tolist(), strict=True)
        while (root[root] != root).any():
            root = root[root]
    return root, edges


def compare_leaf(ids, weights, x, shared, leaf, threshold, side) -> tuple[np.ndarray, list]:
    """Links of each row that count in this leaf, weighted by class, and a spanning forest.

    Every pair is compared; with rows on two sides, those across.
    """
    n = len(ids)
    links, root, edges = np.zeros(n, dtype=np.int64), np.arange(n), []
    one, two = np.flatnonzero(~side), np.flatnonzero(side)
    across = len(two) > 0
    for at in range(0, len(one), 1024):
        left, others = one[at : at + 1024], two if across else one
        for to in range(0 if across else at, len(others), 1024):
            right = others[to : to + 1024]
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            keep = np.ones(len(i), dtype=bool) if across or to > at else i < j
            i, j = i[keep], j[keep]
            for s in range(0, len(i), 200_000):
                a, b = i[s : s + 200_000], j[s : s + 200_000]
                ok = _first_shared(shared[a], shared[b]) == leaf
                a, b = a[ok], b[ok]
                links += np.bincount(a, weights[b], n).astype(np.int64) + np.bincount(b, weights[a], n).astype(np.int64)
                root, new = _joined(root, a, b)
                edges += [(ids[u], ids[v]) for u, v in new]
    return links, edges


def link(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", threshold: float = 0.95, trees: int = 6, leaf_rows: int = 256, most_leaf: int = 4096, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vec).cast("array<double>").alias("__v"))
    fit = F.expr("__v is not null and size(__v) > 0 and forall(__v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(__v, x -> x <> 0)")
    rows = rows.withColumn("__v", F.when(fit, F.col("__v")))
    keyed = rows.withColumn("__key", F.when(F.col("__v").isNotNull(), F.struct(F.size("__v").alias("n"), F.xxhash64("__v").alias("h"), F.hash("__v").alias("g"))))
    classes = keyed.where("__v is not null").groupBy("__key").agg(F.min("__id").alias("least"), F.count("*").alias("m"), F.first("__v").alias("v"))
    classes = scratch(classes.withColumn("rep", F.monotonically_increasing_id()))  # numbers of the classes, fixed by being written
    n = classes.count()
    of_class = keyed.select("__id", "__key").join(classes.select("__key", "rep", "m"), "__key", "left")

    rate = 1.0 if n <= sample else sample / n
    picked = classes.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * rate)).select("v").limit(2 * sample).toPandas()["v"]
    by_size: dict[int, list] = {}
    for v in picked:
        by_size.setdefault(len(v), []).append(v)
    forest: dict[int, list] = {}
    for size, vs in by_size.items():
        x = np.array(vs)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng(seed + size)
        here = n * len(vs) / max(1, len(picked))
        depth = max(0, int(np.ceil(np.log2(max(1, here / leaf_rows)))))
        # cuts off the middle need more levels; only half a leaf's rows end a branch early
        forest[size] = [fit_tree(x, 2 * depth, rng, threshold, leaf_rows * len(vs) / here / 2) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    def place(frames):
        for pdf in frames:
            for size, part in pdf.groupby(pdf["v"].map(len)):
                x = np.array(part["v"].tolist(), dtype=np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                mine: list[list[int]] = [[] for _ in range(len(x))]
                base = 0
                for t in shared.value.get(size, [None]):
                    for r, ls in enumerate(leaves_of(t, x)):
                        mine[r] += [base + v for v in ls]
                    base += count_leaves(t)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "m": part["m"].to_numpy(), "v": list(part["v"]), "leaves": mine})

    placed = classes.select("rep", "m", "v").repartition(spark.sparkContext.defaultParallelism).mapInPandas(place, "rep long, m long, v array<double>, leaves array<int>")
    placed = placed.select("rep", "m", "v", "leaves", F.size("v").alias("size"), F.explode("leaves").alias("leaf"))

    # a leaf beyond most_leaf rows is dealt to tasks as pairs of parts (i, j)
    large = placed.groupBy("size", "leaf").agg(F.ceil(F.count("*") / most_leaf).cast("int").alias("parts")).where("parts > 1")
    placed = placed.join(F.broadcast(large), ["size", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("cast(pmod(xxhash64(rep, leaf), parts) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("rep", "m", "v", "leaves", "size", "leaf", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy(dtype=bool)
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": pd.array([], dtype="Int64"), "n": np.zeros(0, np.int64)})
        if pdf["i"].iloc[0] != pdf["j"].iloc[0] and side.all() | (~side).all():
            return none
        x = np.array(pdf["v"].tolist(), dtype=np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, leaf = pdf["rep"].to_numpy(), int(pdf["leaf"].iloc[0])
        links, edges = compare_leaf(ids, pdf["m"].to_numpy(), x, _padded(list(pdf["leaves"])), leaf, threshold, side)
        hit = np.flatnonzero(links)
        a = [*ids[hit], *(e[0] for e in edges)]
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": pd.array([None] * len(hit) + [e[1] for e in edges], dtype="Int64"), "n": np.array([*links[hit], *[0] * len(edges)], dtype=np.int64)})

    found = scratch(placed.groupBy("size", "leaf", "i", "j").applyInPandas(compare, "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("__n"))
    comps = components(found.where("b is not null").select("a", "b"))
    named = with_component(classes.select("rep", "least"), comps, "rep", "__c")
    least = named.groupBy("__c").agg(F.min("least").alias("__least"))
    named = named.join(least, "__c").select("rep", "__least")
    out = of_class.join(links, "rep", "left").join(named, "rep", "left")
    out = out.select(F.col("__id").alias(id_col), F.coalesce(F.col("m") - 1 + F.coalesce("__n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("__least", "__id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
