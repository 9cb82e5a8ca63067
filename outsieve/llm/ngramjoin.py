"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, exact intersection.

Two texts link when 100 * |A and B| >= 75 * |A or B| over their sets of distinct word
shingles. The join drops no link; shingles and sets are told apart by 64-bit hashes.

1. Each text becomes a set id (hash of its sorted shingle set), its size, a prefix (the
   25 % + 1 first shingles in one global order; linked sets share one) and a parity
   bitmap of one to two bits a shingle. Equal sets share an id, so copies meet here and
   are one set from then on. The order puts frequent shingles last, by their counts in a
   fixed share of the texts; it only steers cost, any order gives the same links.
2. Star round: the sets of a prefix shingle are paired with its least set id, linear in
   the postings; the bitmap bound drops pairs, exact intersection of the survivors gives
   links, and links give components. Then in a few turns each shingle of many sets pairs
   those outside its largest component with PIVOTS sets inside, picked by hash: near copies of
   one text, which the star leaves in many components, meet in one at linear cost.
3. Tile round: where a shingle still meets sets of different components, pairs across
   components that sizes and the shingle's places let link are compared by bitmap, and
   survivors are intersected exactly. A shingle of over ``block`` sets deals them to
   tiles of (size band, block) pairs: rows outside the shingle's largest component meet all
   rows of their own and the neighbouring bands, those inside never meet each other. So no
   pair of different components goes untested and no pair inside a component is spelt out.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer
than five words has its whole word sequence as its one shingle; null, empty or blank
text has no shingle and links with nothing; repeated ids keep a row each; a null id
is the least only where a class has no other. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, grams, joined, mix, scratch, semi, sole_cache, spread, thin, with_component, word_hashes

WORDS, PERCENT = 5, 75
#: Rows of a tile's side; a shingle of no more sets is one tile.
BLOCK = 256
#: One text in so many is counted for the order, and so many frequent shingles are known at most.
SAMPLE_EVERY, MOST_KNOWN = 8, 500_000
#: A shingle known to be in more texts has its postings dealt to several tasks.
HOT = 10_000
#: Turns at most and pivots a turn, for shingles of more sets than MANY.
TURNS, PIVOTS, MANY = 3, 32, 32
#: Bits of the filter that spares texts of no candidate pair the shuffle: 8 MB, one in ten passes at about 7 million sets.
FILTER_BITS = 1 << 26


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(text)
    if not len(w):
        return w
    return np.unique(grams(w, k) if len(w) >= k else grams(w, len(w)))


def overlap_needed(a, b, percent: int = PERCENT):
    """Least intersection size at which sets of these sizes link (integers or arrays)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -((-percent * n) // 100) + 1


def width(n: int) -> int:
    return max(64, 1 << (n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap in 64-bit words: bit (h mod width) flips for each shingle; a wider one folds by XOR of its halves."""
    b = width(len(shingles))
    bits = np.bincount((mix(shingles) & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    while len(bits) > to:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def band(n: int, percent: int = PERCENT) -> int:
    """Sizes that can link are in the same or neighbouring bands."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def _known_frequent(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Rows (upper half of the hash, count) of the shingles seen most in one text of SAMPLE_EVERY, dealt by hash.

    At most MOST_KNOWN: the least count that is kept follows from the counts of counts.
    """

    def run(batches):
        for b in batches:
            got = [s for t in b.column(0).to_pylist() if len(s := shingle_set(t, k))]
            if got:
                h, c = np.unique(_upper(np.concatenate(got)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

    some = spread(docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE_EVERY)) == 0)).mapInArrow(run, "h int, c long")
    counted = scratch(some.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1"))
    total, least = 0, None
    for c, n in counted.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().orderBy(F.desc("c")).collect():
        total += n
        if total > MOST_KNOWN:
            break
        least = c
    if least is None:
        return np.zeros((2, 0), np.int32)
    top = counted.where(F.col("c") >= least).select("h", F.least("c", F.lit(2**31 - 1)).cast("int").alias("c")).toArrow()
    discard(counted)
    h, c = (top.column(x).to_numpy() for x in ("h", "c"))
    order = np.argsort(h)
    return np.stack([h[order], c[order]])


def _upper(h: np.ndarray) -> np.ndarray:
    return (h.view(np.int64) >> 32).astype(np.int32)


def signatures(docs: DataFrame, known: np.ndarray, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """(id, text_hash, n_shingles, set_id, prefix array, bits) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        sole_cache("ngramjoin")
        known, count = shared.value
        for b in thin(batches):
            ids, hashes, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            for at in range(0, len(texts), 500):
                n, key, prefix, bits = [], [], [], []
                for t in texts[at : at + 500]:
                    s = shingle_set(t, k)
                    n.append(len(s))
                    if not len(s):
                        key.append(None), prefix.append(None), bits.append(None)
                        continue
                    key.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) ^ len(s))
                    v = s.view(np.int64)
                    rank = np.zeros(len(v), dtype=np.int64)
                    if len(known):
                        u = _upper(s)
                        p = np.minimum(np.searchsorted(known, u), len(known) - 1)
                        rank = np.where(known[p] == u, count[p], 0)
                    prefix.append(v[np.lexsort((v, rank))[: prefix_length(len(v), percent)]])
                    bits.append(bitmap(s))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), hashes.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], [id_col, "text_hash", "n_shingles", "set_id", "prefix", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, F.xxhash64(text).alias("text_hash"), text)).mapInArrow(run, f"`{id_col}` {kind}, text_hash long, n_shingles long, set_id long, prefix array<long>, bits array<long>")


def _may_link(percent: int) -> Column:
    """Whether the bitmaps of a pair (na, nb, bits_a, bits_b) of near sizes let it link."""
    fold = "zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y)"
    both = "case when size(bits_a) > size(bits_b) then {} when size(bits_a) < size(bits_b) then {} else {} end"
    apart = "aggregate(zip_with({}, {}, (x, y) -> x ^ y), 0L, (n, x) -> n + bit_count(x))"
    apart = both.format(apart.format(fold.format("bits_a", "bits_b"), "bits_b"), apart.format("bits_a", fold.format("bits_b", "bits_a")), apart.format("bits_a", "bits_b"))
    return F.expr(f"floor((na + nb - {apart}) / 2) >= ceil({percent} * (na + nb) / {100 + percent}.0)")


def _perhaps_in(rows: DataFrame, keys: list[str], wanted: DataFrame, same: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not among ``wanted``'s ``same``, so that a join to come shuffles less.

    A bitmap of one hash, broadcast: at most bits / 8 bytes at any size. Where ``wanted`` fills it, more rows stay.
    """
    at = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1
    spots = wanted.select(at(same).alias("x")).select(F.bitmap_bucket_number("x").alias("__bucket"), F.bitmap_bit_position("x").alias("p"))
    maps = spots.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("p").alias("__map"))
    spotted = rows.withColumn("__x", at(keys)).withColumn("__bucket", F.bitmap_bucket_number("__x"))
    byte = "cast(conv(hex(substring(__map, cast(bitmap_bit_position(__x) div 8 as int) + 1, 1)), 16, 10) as int)"
    spotted = spotted.join(F.broadcast(maps), "__bucket").where(F.expr(f"getbit({byte}, cast(bitmap_bit_position(__x) % 8 as int)) = 1"))
    return spotted.select(*rows.columns)


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text: str, k: int, percent: int, group: int = 64) -> DataFrame:
    """Pairs (a, b) of set ids that link, by exact intersection of their sorted shingles.

    A set's partners are dealt to groups of about ``group``; its text goes once to each group.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).alias("m"))
    pairs = scratch(pairs.join(blocks, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), m) as int)").alias("g")))
    nodes = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()
    reps = scratch(semi(sets.select(F.col("set_id").alias("a"), "rep", "text_hash", "rows"), nodes, "a"))
    some = docs.select(F.col(id_col).alias("__i"), F.xxhash64(text).alias("__h"), F.col(text).alias("t"))
    some = _perhaps_in(some, ["__i", "__h"], reps, ["rep", "text_hash"])
    texts = some.join(reps, some["__i"].eqNullSafe(reps["rep"]) & (some["__h"] == reps["text_hash"])).select("a", "t", "rows")
    texts = scratch(texts.where("rows = 1").unionByName(texts.where("rows > 1").dropDuplicates(["a"])).select("a", "t"))
    heads = pairs.select("a", "g").distinct().join(texts, "a").select("a", "g", F.lit(None).cast("long").alias("b"), "t")
    tails = pairs.join(texts.withColumnRenamed("a", "b"), "b").select("a", "g", "b", "t")

    def run(batches):
        held = None
        for b in thin(batches):
            out: tuple[list, list] = ([], [])
            for x, y, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s = shingle_set(t, k)
                if y is None:
                    held = s
                    continue
                both = len(np.intersect1d(held, s, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(s) - both):
                    out[0].append(x), out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    rows = heads.unionByName(tails).repartition("a", "g").sortWithinPartitions("a", "g", F.asc_nulls_first("b"))
    out = scratch(rows.mapInArrow(run, "a long, b long"))
    discard(pairs, reps, texts)
    return out


def _tiles(percent: int):
    """In a tile (rows: list of side, set_id, n, comp, bits), compare bitmaps of different components."""

    def compare(x: list, y: list, found: set) -> None:
        to = min(len(r["bits"]) for r in (*x, *y))
        pack = lambda rows: np.stack([folded(np.array(r["bits"], np.int64), to) for r in rows])
        column = lambda rows, c: np.array([r[c] for r in rows], np.int64)
        xb, yb, xn, yn = pack(x), pack(y), column(x, "n")[:, None], column(y, "n")[None]
        xp, yp = column(x, "pos")[:, None], column(y, "pos")[None]
        step = max(1, 2_000_000 // yb.size)
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            apart = np.bitwise_count((xb[part, None] ^ yb[None]).view(np.uint64)).sum(2, dtype=np.int64)
            need = overlap_needed(xn[part], yn, percent)
            fit = (np.minimum(xn[part] - xp[part], yn - yp) >= need) & ((xn[part] + yn - apart) // 2 >= need) & (column(x, "comp")[part, None] != column(y, "comp")[None])
            for i, j in zip(*np.nonzero(fit), strict=True):
                u, v = x[at + i]["set_id"], y[j]["set_id"]
                found.add((min(u, v), max(u, v)))

    def run(batches):
        for b in thin(batches, 1):
            found: set[tuple[int, int]] = set()
            for rows in b.column(0).to_pylist():
                left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
                if left:
                    compare(left, right or left, found)
            a, c = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _tile_pairs(left: DataFrame, bits: DataFrame, percent: int, block: int) -> DataFrame:
    """Candidate pairs of rows (tok, set_id, n, pos, comp) of hot shingles, tile by tile.

    Rows are inside or outside their shingle's largest component. A tile (band, i, to, out, j) holds the outside
    rows of block i of ``band`` and those of block j of the band ``to``, outside (out = 1) or inside (out = 0).
    """
    main = left.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(F.max(F.struct("c", "comp")).alias("m")).select("tok", F.col("m.comp").alias("main"))
    rows = left.join(main, "tok").withColumns({"band": F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("long"), "out": (F.col("comp") != F.col("main")).cast("int")})
    counts = rows.groupBy("tok", "band", "out").agg(F.ceil(F.count("*") / block).cast("int").alias("c"))
    counts = counts.groupBy("tok").agg(F.map_from_entries(F.collect_list(F.struct(F.expr("2 * band + out").alias("k"), F.col("c").alias("v")))).alias("blocks"))
    rows = rows.join(counts, "tok").join(bits, "set_id")
    n = lambda d, out: f"coalesce(blocks[2 * (band + {d}) + {out}], 0)"
    rows = rows.withColumn("blk", F.expr(f"cast(pmod(xxhash64(set_id), {n(0, 'out')}) as int)"))
    each = lambda count, make: f"transform(if({count} > 0, sequence(0, {count} - 1), cast(array() as array<int>)), o -> {make})"
    tile = lambda band, i, to, out, j, side: f"named_struct('band', {band}, 'i', {i}, 'to', {to}, 'out', {out}, 'j', {j}, 'side', {side})"
    outside = [each(n(d, 0), tile("band", "blk", f"band + {d}", 0, "o", 0)) for d in (-1, 0, 1)]
    outside.append(each(n(0, 1), tile("band", "least(blk, o)", "band", 1, "greatest(blk, o)", "if(blk <= o, 0, 1)")))
    outside += [each(n(1, 1), tile("band", "blk", "band + 1", 1, "o", 0)), each(n(-1, 1), tile("band - 1", "o", "band", 1, "blk", 1))]
    inside = [each(n(d, 1), tile(f"band + {d}", "o", "band", 0, "blk", 1)) for d in (-1, 0, 1)]
    dealt = rows.select("tok", "set_id", "n", "pos", "comp", "bits", F.explode(F.expr(f"if(out = 1, concat({', '.join(outside)}), concat({', '.join(inside)}))")).alias("t"))
    dealt = dealt.groupBy("tok", "t.band", "t.i", "t.to", "t.out", "t.j").agg(F.collect_list(F.struct(F.col("t.side").alias("side"), "set_id", "n", "pos", "comp", "bits")).alias("rows"))
    return dealt.where("size(rows) > 1").select("rows").mapInArrow(_tiles(percent), "a long, b long")


def _places(percent: int, na: str = "na", nb: str = "nb", pa: str = "pa", pb: str = "pb") -> str:
    """Sizes and places of a shared shingle let (a, b) link, were it their first shared one."""
    need = f"ceil({percent} * ({na} + {nb}) / {100 + percent}.0)"
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and least({na} - {pa}, {nb} - {pb}) >= {need}"


def _shared_postings(sets: DataFrame, known: np.ndarray, hot: int) -> DataFrame:
    """Rows (set_id, n, pos, tok, c, p) of the prefix shingles that several sets hold; c counts them, p is the least of them.

    One shuffle by shingle. One known to be hot is shared for sure, so its rows are dealt
    to as many tasks as its estimated count needs; that estimate is its c, and each task has a p.
    """
    most = known[:, known[1] > hot / SAMPLE_EVERY]
    frequent = sets.sparkSession.createDataFrame([(int(h), int(c) * SAMPLE_EVERY) for h, c in most.T], "h int, est long")
    rows = sets.select("set_id", "n", F.posexplode("prefix").alias("pos", "tok"))
    rows = rows.join(F.broadcast(frequent), F.shiftright("tok", 32).cast("int") == F.col("h"), "left")
    rows = rows.withColumn("salt", F.expr(f"if(est is null, 0, cast(pmod(xxhash64(set_id), ceil(est / {hot})) as int))"))
    of = Window.partitionBy("tok", "salt")
    rows = rows.withColumns({"c": F.coalesce("est", F.count("*").over(of)), "p": F.min(F.struct(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))).over(of)})
    return rows.where("c > 1").select("set_id", "n", "pos", "tok", "c", "p")


def _pivot_pairs(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each shingle's pivots, PIVOTS sets of its largest component, with its sets of other components.

    Linear in the postings. Pivots go by a hash of shingle and turn, so that a set meets many of them.
    """
    rows = placed.where(f"c > {MANY}")
    pivot = F.struct(F.xxhash64("tok", "set_id", F.lit(turn)).alias("x"), F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    part = F.pmod(F.xxhash64("set_id", "tok", F.lit(turn)), F.lit(PIVOTS)).alias("part")
    each = rows.groupBy("tok", "comp", part).agg(F.count("*").alias("k"), F.min(pivot).alias("m")).groupBy("tok", "comp").agg(F.sum("k").alias("k"), F.collect_list("m").alias("m"))
    main = each.groupBy("tok").agg(F.max(F.struct("k", "comp", "m")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    outside = rows.join(main, "tok").where(F.col("comp") != F.col("main.comp")).select(F.explode(F.expr(f"filter(main.m, x -> {_places(percent, 'x.na', 'n', 'x.pa', 'pos')})")).alias("m"), "set_id", "n", "pos")
    pairs = outside.select("m.*", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    return pairs.select("a", "b", "na", "nb").distinct()


def _few_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of rows (tok, set_id, n, pos, comp) of shingles of few sets that places let link."""
    rows = left.groupBy("tok").agg(F.collect_list(F.struct(F.col("set_id").alias("s"), "n", F.col("pos").alias("p"), F.col("comp").alias("c"))).alias("r"))
    fit = f"x.c <> y.c and {_places(percent, 'x.n', 'y.n', 'x.p', 'y.p')}"
    pair = "if(x.s < y.s, struct(x.s as a, y.s as b, x.n as na, y.n as nb), struct(y.s as a, x.s as b, y.n as na, x.n as nb))"
    pairs = f"flatten(transform(r, (x, i) -> transform(filter(slice(r, i + 2, size(r)), y -> {fit}), y -> {pair})))"
    return rows.where("array_min(transform(r, x -> x.c)) < array_max(transform(r, x -> x.c))").select(F.explode(F.expr(pairs)).alias("p")).select("p.*").distinct()


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb) the (a, b) that bitmaps let link."""
    for x in "ab":
        pairs = pairs.join(bits.select(F.col("set_id").alias(x), F.col("bits").alias(f"bits_{x}")), x)
    return pairs.where(_may_link(percent)).select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, hashes: bool = False, block: int = BLOCK, hot: int = HOT, turns: int = TURNS) -> DataFrame:
    """(id, n_shingles, component_id[, text_hash]): size of the set, least id reachable by links."""
    known = _known_frequent(docs, text, k)
    sig = scratch(signatures(docs, known, id_col, text, k, percent))
    own = scratch(sig.select(F.col(id_col).alias("__id"), "n_shingles", "set_id", "text_hash"))
    rows = own.where("set_id is not null").groupBy("set_id", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "text_hash").alias("r")).agg(F.count("*").alias("rows"))
    rows = rows.groupBy("set_id").agg(F.min(F.struct("r", "rows")).alias("r")).select("set_id", F.col("r.r.id").alias("rep"), F.col("r.r.text_hash").alias("text_hash"), F.col("r.rows").alias("rows"))
    sets = sig.where("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    sets = scratch(sets.join(rows, "set_id"))
    discard(sig)
    bits = sets.select("set_id", "bits")
    members = scratch(_shared_postings(sets, known, hot))

    # star round
    pairs = members.select("p.*", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).where("a <> b").where(_places(percent))
    pairs = scratch(_bounded(pairs.select("a", "b", "na", "nb").distinct(), bits, percent))
    star = components(_verify(pairs, sets, docs, id_col, text, k, percent))
    place = lambda: with_component(members.select("tok", "set_id", "n", "pos", "c"), star, "set_id", "comp")

    # turns of pivots: near copies that the star left apart join before the tiles would spell out their pairs
    tested = [pairs]
    for turn in range(turns):
        some = scratch(_pivot_pairs(place(), percent, turn))
        tested.append(scratch(_bounded(some, bits, percent)))
        discard(some)
        if tested[-1].isEmpty() or (new := _verify(tested[-1], sets, docs, id_col, text, k, percent)).isEmpty():
            break
        star = joined(star, new)

    # tile round
    placed = place()
    before = reduce(DataFrame.unionByName, [t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for t in tested])
    few = _bounded(_few_pairs(placed.where(f"c <= {block}"), percent), bits, percent)
    tiled = _tile_pairs(placed.where(f"c > {block}"), bits, percent, block)
    more = scratch(few.unionByName(tiled).distinct().join(before, ["a", "b"], "left_anti"))
    comps = joined(star, _verify(more, sets, docs, id_col, text, k, percent))
    discard(members, more, *tested)

    # back from set ids to rows
    named = with_component(sets.select("set_id", "rep"), comps, "set_id", "cls")
    least = named.groupBy("cls").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "cls").select("set_id", "component_id")
    out = own.join(named, "set_id", "left")
    return out.select(F.col("__id").alias(id_col), "n_shingles", F.coalesce("component_id", "__id").alias("component_id"), *["text_hash"] * hashes)
