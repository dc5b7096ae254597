"""Exact Jaccard join of word n-gram sets by a grouped prefix join.

Every set is ordered by a global order, rare shingles first.  Two sets at the
threshold or above share one of their first |x| - ceil(t |x|) + 1 shingles, their
prefix.  Documents of the same size and prefix collapse into one group.

Groups that share a prefix shingle are filtered in pairs by size, by the place of
the shingle in both prefixes and by parity sketches, in the task that holds the
shingle's postings; that task keeps only as many of the pairs as connect all that
any pair connects.  So groups fall into families, and no pair at the threshold
crosses two of them.  A family's groups then expand to their members, whose whole
sets are verified against each other in one task, or in several where the family
is large; only the components that verified links make come out.  No step writes
more rows than it has members, however many pairs it judges, but for the parts of
very frequent shingles and very large families, which are dealt in blocks of
thousands.

The order comes from counters of fixed number, filled by all documents.

Only postings of shingles that several groups hold are shuffled with their
sketches: the shingles are counted first, and a Bloom filter of the shared ones
goes to every task, so postings need no join with them, however many there are.
Where they are many beside the prefixes, they are judged in passes over the
shingles, one after the other.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import ASCII_LOWER, chunks, mix, shingle_hashes, span_hashes, word_bounds
from .graph import components
from .near_sets import Postings, forest, linked, sketch
from .tables import discard, shuffles_cleared, small_batches, unused, written

#: Counters of the global order, in blocks that are summed apart.
COUNTERS = 1 << 22
_BLOCKS = 64
#: Rows up to which ids are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Postings of a shingle, and members of a family and shingles in their sets, beyond which several tasks share them.
POSTINGS_IN_BLOCK = 4096
SETS_IN_BLOCK = 4096
ITEMS_IN_BLOCK = 4 << 20
#: Members of a large family that all its blocks hold, so that what they link becomes one component early.
HUBS = 128
#: Postings that a task works on at once, and that it gives away at once.
_BUFFERED = 100_000
_GIVEN = 10_000
#: Bits of the filter for each shared shingle, and its bits at most; beyond, more shingles of one group pass, which pair nothing.
BITS_EACH = 16
MOST_BITS = 1 << 29
#: Bytes of postings shuffled at once, for each byte of prefix; more are dealt to passes over the shingles.
BYTES_AT_ONCE = 4


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit hashes.  Words are lower-cased in A-Z only."""
    for lo, hi, data, offsets in chunks(column):
        data = ASCII_LOWER[data]
        starts, ends, bounds = word_bounds(data, offsets)
        h, at = shingle_hashes(span_hashes(data, starts, ends), bounds, size)
        for d in range(hi - lo):
            yield np.unique(h[at[d] : at[d + 1]])


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set."""
    with np.errstate(over="ignore"):
        one = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        two = np.add.reduce(mix(s ^ np.uint64(0x14057B7EF767814F)))
        both = mix(np.array([one, two]) + np.uint64(len(s))).view(np.int64)
    return int(both[0]), int(both[1])


def _counters(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets have a shingle in each counter: a fixed number of counters, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in _joined(shingle_sets(batch.column(1), size)):
                total += np.bincount(part & np.uint64(COUNTERS - 1), minlength=COUNTERS)
        chunk = TaskContext.get().partitionId() % _BLOCKS
        rows = np.minimum(total, 65535).astype("<u2").reshape(_BLOCKS, -1)  # beyond, a shingle is frequent
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "chunk": pa.array([chunk] * _BLOCKS, pa.int32()), "counts": [x.tobytes() for x in rows]})

    def added(kind: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, dtype=kind) for x in pdf["counts"]], axis=0, dtype="<i8")
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "counts": [total.tobytes()]})

        return run

    schema = "block int, chunk int, counts binary"
    parts = texts.mapInArrow(count, schema).groupBy("block", "chunk").applyInPandas(added("<u2"), schema).groupBy("block").applyInPandas(added("<i8"), schema)
    out = np.zeros((_BLOCKS, COUNTERS // _BLOCKS), dtype=np.int64)
    for r in parts.collect():  # _BLOCKS rows
        out[r["block"]] = np.frombuffer(r["counts"], dtype="<i8")
    return out.reshape(-1).astype(np.uint32)


def _joined(sets: Iterator[np.ndarray], limit: int = 1 << 20) -> Iterator[np.ndarray]:
    held, n = [], 0
    for s in sets:
        held.append(s.astype(np.uint64))
        n += len(s)
        if n >= limit:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _longs(values: list | np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def _prefixes(texts: DataFrame, size: int, percent: int, counters: np.ndarray) -> DataFrame:
    """Every row's doc_id and digest, size, key of the set (k1, k2) and of its group (g1, g2), prefix and sketch."""
    shared = texts.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            ns, keys, groups, prefixes, sketches = [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n = len(s)
                rank = (order[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
                prefix = s[np.argsort(rank, kind="stable")[: n - -(-n * percent // 100) + 1]]
                one, two = set_key(prefix)
                ns.append(n)
                keys.append(set_key(s))
                groups.append((one ^ n, two))
                prefixes.append(prefix.view(np.int64))
                sketches.append(sketch(s))
            keys, groups = (np.array(x, dtype=np.int64).reshape(-1, 2) for x in (keys, groups))
            columns = [batch.column(0), batch.column(2), _longs(ns), *(_longs(x[:, k]) for x in (keys, groups) for k in (0, 1)), _lists(prefixes), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "k1", "k2", "g1", "g2", "prefix", "sketch"])

    return texts.mapInArrow(run, "doc_id long, digest long, n long, k1 long, k2 long, g1 long, g2 long, prefix array<long>, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` rows, cut only where one of the first ``keys`` columns changes; the rows come sorted by those."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= limit:
            last = [held[-1].column(k)[-1].as_py() for k in range(keys)]
            fresh = np.zeros(batch.num_rows, dtype=bool)
            for k in range(keys):
                fresh |= batch.column(k).to_numpy(zero_copy_only=False) != last[k]
            if fresh.any():
                cut = int(fresh.argmax())
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _block_numbers(table: pa.Table, keys: int) -> np.ndarray:
    fresh = np.zeros(table.num_rows, dtype=bool)
    for k in range(keys):
        x = table.column(k).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return np.cumsum(fresh)


def _bits(shingles: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each shingle in its block of ``width`` bits; the block is in the topmost six bits."""
    mask = np.uint64(width - 1)
    return (shingles >> np.uint64(12)) & mask, (shingles >> np.uint64(35)) & mask


def _filter(shared: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the shingles of ``shared``, a row of bytes for each block."""
    width = 512
    while width * _BLOCKS < min(MOST_BITS, BITS_EACH * rows):
        width *= 2

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, dtype=np.uint8)
        for place in _bits(pdf["shingle"].to_numpy().view(np.uint64), width):
            bits[place] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((_BLOCKS, width // 8), dtype=np.uint8)
    blocks = shared.select(F.shiftrightunsigned("shingle", 58).cast("int").alias("block"), "shingle")
    for r in blocks.groupBy("block").applyInPandas(filled, "block int, bits binary").collect():  # _BLOCKS rows
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _postings(groups: DataFrame, passing: np.ndarray) -> DataFrame:
    """A row (shingle, gid, n, at, sketch) for each place of a prefix whose shingle passes the filter."""
    sent = groups.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            held = batch.column(2).flatten().to_numpy().view(np.uint64)
            block = (held >> np.uint64(58)).astype(np.int64)
            hit = np.ones(len(held), dtype=bool)
            for place in _bits(held, 8 * rows.shape[1]):
                hit &= (rows[block, (place >> np.uint64(3)).astype(np.int64)] << (place & np.uint64(7)).astype(np.uint8)) & np.uint8(128) > 0
            where = np.flatnonzero(hit)
            group = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for lo in range(0, len(where), _GIVEN):
                now = where[lo : lo + _GIVEN]
                of = batch.take(pa.array(group[now], pa.int64()))
                yield pa.RecordBatch.from_arrays([_longs(held[now].view(np.int64)), of.column(0), of.column(1), pa.array(at[now], pa.int32()), of.column(3)], names=["shingle", "gid", "n", "at", "sketch"])

    return groups.select("g1", "n", "prefix", "sketch").mapInArrow(run, "shingle long, gid long, n long, at int, sketch binary")


def _split(postings: DataFrame) -> DataFrame:
    """The postings, those of very frequent shingles (``parts`` > 1) dealt to pairs of parts."""
    part = F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, part).alias("p"), F.greatest(q, part).alias("q")))
    return postings.select("shingle", F.explode(pairs.cast("array<struct<p:int,q:int>>")).alias("t"), "gid", "n", "at", part.alias("part"), "sketch").select("shingle", "t.p", "t.q", "gid", "n", "at", "part", "sketch")


def _families(groups: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the groups that near pairs connect, node and root being g1; no pair at the threshold is apart."""
    held = groups.select("n", F.explode("prefix").alias("shingle"))
    # a shingle that one group has in its prefix pairs nothing, nor does one of two groups whose sizes are too far apart
    counted = held.groupBy("shingle").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    fitting = counted.where((F.col("c") > 2) | ((F.col("c") == 2) & (100 * F.col("lo") >= percent * F.col("hi"))))
    shared = written(fitting.select("shingle", "c", F.ceil(F.col("c") / POSTINGS_IN_BLOCK).cast("int").alias("parts")), "shingles")
    total = shared.agg(F.count("*"), F.sum(F.col("c") * F.col("parts")), F.count_if(F.col("parts") > 1)).first()
    passing, n_frequent = _filter(shared, total[0]), total[2]
    frequent = shared.where("parts > 1").select("shingle", "parts")
    places = F.size("prefix").cast("long")
    least, most = groups.agg(F.sum(8 * places), F.sum(places * (F.coalesce(F.length("sketch"), F.lit(0)) + 40)) / F.sum(places)).first()
    passes = min(_BLOCKS, max(1, math.ceil((total[1] or 0) * (most or 0) / (BYTES_AT_ONCE * (least or 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3, _BUFFERED):
            column = lambda name: table.column(name).to_numpy()
            rows = Postings(column("gid"), column("n"), column("at").astype(np.int64), column("part"), table.column("sketch").to_pylist(), percent)
            a, b = forest(_block_numbers(table, 3), rows)
            yield pa.RecordBatch.from_arrays([_longs(a), _longs(b)], names=["a", "b"])

    def edges(now: np.ndarray) -> DataFrame:
        postings = _postings(groups, now)
        if n_frequent:
            joined = postings.join(F.broadcast(frequent) if n_frequent <= BROADCAST_ROWS else frequent, "shingle", "left")
            dealt = _split(joined.withColumn("parts", F.coalesce("parts", F.lit(1))))
        else:
            zero = F.lit(0).cast("int")
            dealt = postings.select("shingle", zero.alias("p"), zero.alias("q"), "gid", "n", "at", zero.alias("part"), "sketch")
        return dealt.repartition("shingle", "p", "q").sortWithinPartitions("shingle", "p", "q").mapInArrow(run, "a long, b long")

    if passes == 1:
        found = [edges(passing)]
    else:
        turn = np.arange(_BLOCKS) * passes // _BLOCKS
        found = [written(edges(np.where(turn[:, None] == k, passing, np.uint8(0))), "pairs") for k in range(passes)]
    out = components(functools.reduce(DataFrame.unionByName, found), "a", "b")
    for table in [shared, *(found if passes > 1 else [])]:
        discard(table)
    return out


def _sets(texts: DataFrame, members: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """``members`` (rep, digest, k1, k2, fam) with their whole sets, read from the texts once more.

    A member's text is found by its doc_id and digest, so rows that share a doc_id
    meet only their own; of ``repeated`` rows (doc_id, digest) one is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept, items = [], []
            for k, s in enumerate(shingle_sets(batch.column(0), size)):
                if set_key(s) == (k1[k], k2[k]):  # texts of one digest may differ
                    kept.append(k)
                    items.append(s.tobytes())
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(3), taken.column(1), taken.column(2), pa.array(items, pa.binary())], names=["fam", "k1", "k2", "items"])

    few = members.count() <= BROADCAST_ROWS
    key = ["doc_id", "digest"]
    wanted = members.select(F.col("rep").alias("doc_id"), "digest", "k1", "k2", "fam")
    columns = ["text", "k1", "k2", "fam"]

    def held(rows: DataFrame) -> DataFrame:
        return texts.select(*key, "text").join(F.broadcast(rows) if few else rows, key)

    if repeated.isEmpty():
        found = held(wanted).select(*columns)
    else:
        again = wanted.join(repeated, key, "left_semi")
        found = held(wanted.join(repeated, key, "left_anti")).select(*columns).unionByName(held(again).groupBy("k1", "k2", "fam").agg(F.any_value("text").alias("text")).select(*columns))
    return found.mapInArrow(run, "fam long, k1 long, k2 long, items binary")


def _verified(tiles: DataFrame, percent: int) -> DataFrame:
    """The links, as few as connect the same, between the known components of each tile's sets.

    ``tiles`` has a tile's number, sets (k1, k2, items) and the components they
    are known to be in (r1, r2).  A row (k1, k2, r1, r2) says that component k is
    in component r.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1, 2 * SETS_IN_BLOCK):
            numbers = _block_numbers(table, 1)
            keys = np.stack([table.column(c).to_numpy() for c in ("k1", "k2", "r1", "r2")], axis=1)
            raw = table.column("items")
            first = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]))
            out = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b - a < 2:
                    continue
                here = a + np.unique(keys[a:b, :2], axis=0, return_index=True)[1]  # a repeated row is one set
                roots, known = np.unique(keys[here, 2:], axis=0, return_inverse=True)
                labels = linked([np.frombuffer(raw[int(k)].as_buffer(), dtype=np.uint64) for k in here], known.reshape(-1), percent)
                before, at = np.unique(known.reshape(-1), return_index=True)
                for r, label in zip(before, labels[at], strict=True):
                    same = before[labels[at] == label]
                    if len(same) > 1:
                        out.append((*roots[r], *roots[same[0]]))
            found = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([_longs(found[:, k]) for k in range(4)], names=["k1", "k2", "r1", "r2"])

    dealt = tiles.select("tile", "k1", "k2", "r1", "r2", "items").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "k1 long, k2 long, r1 long, r2 long")


def _digest() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _blocks_of(rows: Column, items: Column) -> Column:
    return F.greatest(F.ceil(rows / SETS_IN_BLOCK), F.ceil(items / ITEMS_IN_BLOCK)).cast("int")


def _large(sets: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """(k1, k2, r1, r2) of the linked sets of families that several tasks share.

    First each block of a family is verified with the family's hubs; then blocks
    of what is still in different components, pair by pair.  Two blocks of one
    and the same component are not compared.
    """
    mine = sets.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "fam")
    hub = F.pmod(F.xxhash64("k1", "k2"), F.greatest(F.lit(1), F.floor(F.col("m") / HUBS))) == 0
    blocks = F.when(hub, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")))
    tiles = mine.withColumn("block", F.explode(blocks)).select(F.xxhash64("fam", "block").alias("tile"), "k1", "k2", F.col("k1").alias("r1"), F.col("k2").alias("r2"), "items")
    links = written(_verified(tiles, percent).select(_pair("k1", "k2").alias("a"), _pair("r1", "r2").alias("b")), "links")
    roots = components(links, "a", "b")
    rooted = mine.select("fam", "k1", "k2", F.length("items").alias("size"), _pair("k1", "k2").alias("node")).join(roots, "node", "left")
    rooted = written(rooted.select("fam", "k1", "k2", "size", F.coalesce("root", "node").alias("root")), "rooted")
    of_root = rooted.groupBy("fam", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s")).withColumn("parts", _blocks_of(F.col("c"), F.col("s") / 8))
    # components that fill a block are dealt to blocks of their own, the small ones of a family share blocks
    whole = F.col("c") >= SETS_IN_BLOCK
    pool = of_root.where(~whole).groupBy("fam").agg(_blocks_of(F.sum("c"), F.sum("s") / 8).alias("pool"))
    classes = of_root.join(pool, "fam", "left").select("fam", "root", F.when(whole, F.xxhash64("root")).alias("uniform"), F.when(whole, F.col("parts")).otherwise(F.col("pool")).alias("parts"))
    block = F.xxhash64("fam", F.coalesce("uniform", F.lit(0).cast("long")), F.pmod(F.xxhash64("k1"), F.col("parts")))
    placed = written(rooted.join(classes, ["fam", "root"]).select("fam", "k1", "k2", "root", "uniform", block.alias("block")), "placed")
    each = placed.select("fam", "block", "uniform").distinct()
    other = each.select("fam", F.col("block").alias("other"), F.col("uniform").alias("also"))
    pairs = each.join(other, "fam").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("uniform") == F.col("also"), F.lit(False)))
    pairs = pairs.select(F.xxhash64("block", "other").alias("tile"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    again = placed.join(pairs, "block").join(sets.select("k1", "k2", "items"), ["k1", "k2"]).select("tile", "k1", "k2", F.col("root.a").alias("r1"), F.col("root.b").alias("r2"), "items")
    more = _verified(again, percent).select(_pair("k1", "k2").alias("a"), _pair("r1", "r2").alias("b"))
    out = components(written(links.unionByName(more), "links"), "a", "b")
    return out.select("node.a", "node.b", F.col("root.a").alias("r1"), F.col("root.b").alias("r2")).toDF("k1", "k2", "r1", "r2")


@shuffles_cleared
def _judged(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, digest, n, k1, k2), the sets' (k1, k2, rep, copies) and, of the linked ones, (k1, k2, r1, r2)."""
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _digest().alias("digest"))
    wide = written(_prefixes(texts, size, percent, _counters(texts, size)), "prefixes")
    rows = written(wide.select("doc_id", "digest", "n", "k1", "k2"), "rows")
    usable = wide.where("n > 0 and doc_id is not null")
    nodes = written(usable.groupBy("k1", "k2", "g1").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n")), "nodes").select("k1", "k2", "g1", F.col("rep.doc_id").alias("rep"), F.col("rep.digest").alias("digest"), "copies", "n")
    # a group of different sets has no sketch: it passes
    one = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2"))
    groups = usable.groupBy("g1", "g2").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), one.alias("one"))
    groups = written(groups.select("g1", "n", "prefix", F.when(F.col("one"), F.col("sketch")).alias("sketch")), "groups")
    discard(wide)
    families = _families(groups, percent)
    discard(groups)
    several = nodes.groupBy("g1").agg(F.count("*").alias("c")).where("c > 1").select(F.col("g1").alias("node"), F.col("g1").alias("root"))
    families = families.unionByName(several.join(families.select("node"), "node", "left_anti"))
    members = written(nodes.join(families.withColumnRenamed("node", "g1"), "g1").select(F.col("root").alias("fam"), "k1", "k2", "rep", "digest", "n"), "members")
    repeated = written(rows.where("n > 0 and doc_id is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "digest"), "repeated")
    sets = written(_sets(texts, members, repeated, size), "sets")
    of_family = members.groupBy("fam").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    large = written(of_family.withColumn("parts", _blocks_of(F.col("m"), F.col("s"))).where("parts > 1").select("fam", "m", "parts"), "large")
    own = (F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    small = sets if (n_large := large.count()) == 0 else sets.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "fam", "left_anti")
    found = _verified(small.select(F.col("fam").alias("tile"), "k1", "k2", *own, "items"), percent)
    if n_large:
        found = found.unionByName(_large(sets, large, percent))
    roots = written(found, "roots")
    for table in (sets, members, repeated, large):
        discard(table)
    return rows, nodes, roots


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    A text's set is its distinct ``size``-word shingles; with fewer words its
    whole word sequence is the one shingle; without words the set is empty and
    linked with nothing.  Two rows link when their sets' Jaccard similarity is
    at least ``percent`` hundredths, judged in whole numbers.  component_id is the
    smallest doc_id reachable by links, the row's own included.

    A row with a null doc_id is counted, but takes no part in links and has no
    component.  Repeated rows are equal sets, and so linked.  An empty table
    gives no rows.  Other columns are not read.
    """
    rows, nodes, roots = _judged(docs, size, percent)
    keys = ["k1", "k2"]
    least = nodes.join(roots, keys).groupBy("r1", "r2").agg(F.min("rep").alias("least"))
    linked_nodes = roots.join(least, ["r1", "r2"]).select(*keys, "least")
    # a set of one row that links to nothing is its own component
    known = nodes.join(linked_nodes, keys, "left").where("copies > 1 or least is not null").select(*keys, F.coalesce("least", "rep").alias("component_id"))
    known = written(known, "known")
    named = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("k1"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), named.alias("k1"), "k2").join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, keys, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: that of its smallest doc_id.

    Of different texts with that doc_id the one of the smallest digest stays; of
    rows that repeat its doc_id and text one stays.  A row goes only if its own
    text is linked or equal to the one that stays, whatever rows share its
    doc_id.  Rows with a null doc_id stay, and so do texts without words, but for
    repeats of doc_id and text.
    """
    digest = _digest()
    rows, _, roots = _judged(docs, size, percent)
    ids = rows.where("doc_id is not null")
    keys = ["k1", "k2"]
    # each set's least row first, then each component's
    firsts = ids.where("n > 0").groupBy(*keys).agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("copies")).join(roots, keys, "left")
    firsts = firsts.where("copies > 1 or r1 is not null").select(*keys, F.coalesce("r1", "k1").alias("r1"), F.coalesce("r2", "k2").alias("r2"), "first")
    least = firsts.groupBy("r1", "r2").agg(F.min("first").alias("kept"))
    kept_of = written(firsts.join(least, ["r1", "r2"]).select(*keys, "kept"), "kept")
    few = kept_of.count() <= BROADCAST_ROWS
    copies = ids.where("n > 0").join(F.broadcast(kept_of) if few else kept_of, keys).where(F.struct("doc_id", "digest") != F.col("kept"))
    gone = written(copies.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    key = F.struct(F.col("doc_id").cast("long").alias("_id"), digest.alias("_digest"))
    gone = gone.select(F.struct("_id", "_digest").alias(name := unused(docs, "_key")))
    kept = docs.withColumn(name, key).join(F.broadcast(gone) if few else gone, name, "left_anti")
    repeated = ids.groupBy("doc_id", "digest").agg(F.count("*").alias("c")).where("c > 1")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(name)["_id"].isNotNull()).dropDuplicates([name])
    return once.unionByName(kept.where(F.col(name)["_id"].isNull())).select(*docs.columns)

