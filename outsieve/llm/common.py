"""Shared pieces of the corpus operators: scratch tables, components, word hashes.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a column (and its name) that holds id and text hash: never null, even where both are."""
    key = fresh(docs, "__key")
    return docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))), key


def thin(batches, rows: int = 512):
    """Arrow batches cut to at most ``rows`` rows, so that few texts are Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and what they keep adds to the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_CACHES: dict[str, Callable[[], None]] = {}


def sole_cache(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Called in a Python worker when a task of ``owner`` starts: what other operators cached there goes.

    Workers are reused from stage to stage; so one holds the largest cache, not all of them.
    """
    for other in [k for k in _CACHES if k != owner]:
        _CACHES.pop(other)()
        gc.collect()
    give_back()
    if drop:
        _CACHES[owner] = drop


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session (tests) may leave it unset and gets one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="outsieve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Spark's setting (4.1 on) by which a query's shuffle files go as it ends; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the session's JVM ends, or earlier by ``discard``. ``free``: the shuffle
    files that made it go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    was = spark.conf.get(FREE_SHUFFLES, "false")
    try:
        if free:
            spark.conf.set(FREE_SHUFFLES, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SHUFFLES, was)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        files, where = _hadoop(t.sparkSession, t._scratch)
        files.delete(where, True)


#: Rows of an Arrow batch at most; Spark's 10,000 whole texts are held twice, off the JVM's heap and in the worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have at most BATCH_ROWS rows: Spark has no such setting for one query."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Bytes of an Arrow batch at most, for rows of packed arrays.
BATCH_BYTES = 4 << 20


def light_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have about BATCH_BYTES bytes at most."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame, small: bool = True) -> DataFrame:
    """Deal a table of fewer input splits than cores to all cores (a single small file, say); ``small``: for Python in small batches."""
    if small:
        small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 4) else df


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that bound."""
    return df.limit(rows + 1).count() <= rows


def semi(df: DataFrame, keys: DataFrame, on: str, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` left-semi ``keys`` (distinct longs); broadcast only where counted to be small."""
    return df.join(F.broadcast(keys) if small_enough(keys, most_rows) else keys, on, "left_semi")


#: Edges that one task contracts in memory, 16 MB; more are contracted in rounds.
AT_ONCE = 1_000_000


def _contracted(batches):
    """(node, component) of all edges (u, v) at once: roots hook to smaller neighbours, then paths are halved."""
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if edges:
        u, v = (np.concatenate(x) for x in zip(*edges, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while (root[u] != root[v]).any():
            np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
            while (root[root] != root).any():
                root = root[root]
        below = root != np.arange(len(nodes))  # a component's least node has no row, as in the rounds
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b: long); component is the least node.

    At most ``at_once`` distinct edges are contracted in one task. More: alternating large-star and small-star contraction (Kiveris et al., 2014). Each round
    is two aggregations and joins over the edge list, written to the shared folder; the
    driver sees counts only. Hot nodes are aggregated map-side before the shuffle.
    """
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if small_enough(now, at_once):
        return scratch(now.coalesce(1).mapInArrow(_contracted, "node long, component long"))
    state = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = state(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = scratch(small.select("e.*").where("u <> v").distinct())
        if (is_ := state(now)) == was:
            break
        was = is_
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (node, component) with more ``edges`` (a, b): only the distinct ones between components are contracted."""
    for x in "ab":
        edges = with_component(edges, comps, x, f"c{x}")
    between = edges.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    above = components(between)
    moved = with_component(comps.withColumnRenamed("component", "was"), above, "was", "component").select("node", "component")
    return scratch(moved.unionByName(above))


def with_component(nodes: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """Add each node's component, itself where it has no link."""
    c = comps.select(F.col("node").alias(node), F.col("component").alias("__component"))
    return nodes.join(c, node, "left").withColumn(name, F.coalesce("__component", node)).drop("__component")


# --- word hashes -----------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BLOCK = 1 << 22


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {"up": powers(_BASE, 1 << 12), "down": powers(_INVERSE, 1 << 12)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = 1 << (n - 1).bit_length()
        _POW["up"], _POW["down"] = powers(_BASE, size), powers(_INVERSE, size)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of MurmurHash3 (public domain)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased.

    Works in blocks that end at a space, so memory stays bounded for very long texts.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + _BLOCK)
        if to < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:to]])
            while not len(gaps) and to < len(data):  # one word longer than a block
                to = min(len(data), to + _BLOCK)
                gaps = np.flatnonzero(_SPACE[data[at:to]])
            if to < len(data):
                to = at + int(gaps[-1]) + 1
        part = data[at:to]
        at = to
        edge = np.diff(np.concatenate(([True], _SPACE[part], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            up, down = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[part] * up[: len(part)], out=total[1:])
            out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


#: Of each byte, A-Z as a-z; bytes of short texts that are hashed at once.
_LOWER = _BYTES[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_GROUP = 1 << 15


def words_of(texts: pa.Array):
    """``word_hashes`` of each text, in order; null has none. Short texts are hashed many at once, straight from Arrow's buffer."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _GROUP, "right")) - 1)
        if at[j] - at[i] > _GROUP:
            yield word_hashes(texts[i].as_py() or "")
            i = j
            continue
        part, cut = data[at[i] : at[j]], at[i : j + 1] - at[i]
        word = ~_SPACE[part]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        some = np.flatnonzero(np.diff(cut))  # a text's edges are words' edges
        first[cut[some]], last[cut[some + 1] - 1] = word[cut[some]], word[cut[some + 1] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[part] * up[: len(part)], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        n = np.searchsorted(start, cut).tolist()
        yield from (h[x:y] for x, y in zip(n[:-1], n[1:], strict=True))
        i = j


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; empty where there are fewer."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * _BASE + words[j : j + n]
    return mix(total)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
