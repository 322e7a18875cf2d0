"""Exact candidates in dense regions of op 2, where more nodes share a signature prefix than a window can hold.

Nodes are put in inverted lists by shingle, with the component that they are in so far. Shingles have one order, from
those of few components to those of many. A set of n shingles shares three quarters of them with whatever it is linked
with, so its first n / 4, and one more, hold one of the common ones: only this prefix is joined. A shingle of one component
alone links nothing new, yet it comes first and leaves less of the prefix to join. Of two linked sets, what is common
and not in both prefixes lies beyond the prefix that ends first; so the common shingles of the prefixes and what is
beyond them have to add up to the threshold, first over components, then over their nodes, so that a large component is
unfolded only where a pair may be found. So every pair over the threshold is found, however many share a shingle.

Any one order will do, and a shingle may count as shared though it isn't. So the order comes from a table of slots by
hashed shingle, as long as that is small enough to broadcast: each task sums up its slots, and only prefixes are unfolded
into rows. Beyond that bound all shingles are, and counted by joins.

Components of near copies of one template pass these bounds in numbers that go with the square of the group. Of those
pairs, the parities say most: a bit for each slot of a set, set if an odd number of its shingles falls there. Where the
bits of two sets differ, so do the sets; no pair over the threshold has more such bits than shingles that differ.

With o common shingles, similarity 0.75 or more is 7 * o >= 3 * (n_a + n_b), and then 7 * d <= n_a + n_b for the d
shingles that are in one of the two sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import forget, map_arrow, stored
from tessera.llm.pretokens import mixed

#: Sets that are unfolded at a time.
SETS_AT_ONCE = 200
#: Slots a shingle in the table that gives the order, of a byte each; one of more slots than the bound (32 MB) is not
#: broadcast. Slots of a block travel together.
SLOTS, MOST_SLOTS, BLOCK = 4, 1 << 25, 1 << 16
#: Parity bits a shingle, at least; 64-bit words of parities that go with each row of a prefix.
PARITY_BITS, WORDS = 4, 16


def inverted(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, component, id, n): a row for each shingle of each node."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                some = batch.slice(at, SETS_AT_ONCE)
                raw = some.column("shingles").to_pylist()
                size = np.array([len(x) // 8 for x in raw])
                columns = [pa.array(np.repeat(some.column(c).to_numpy(), size)) for c in ("component", "id", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), *columns], ["s", "component", "id", "n"])

    return map_arrow(sets.join(nodes.select("id", "n", "component"), "id").select("id", "n", "component", "shingles"), kernel, "s long, component long, id long, n long")


def shared(lists: DataFrame) -> DataFrame:
    """``lists`` with ``k``, the number of components of each shingle, without the shingles of one component."""
    counted = lists.select("s", "component").distinct().groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    return lists.join(counted, "s").select("s", "component", "id", "n", "k")


def prefixes(lists: DataFrame) -> DataFrame:
    """``lists`` cut to the prefix of each node, with the numbers of its shingles in the prefix (``head``) and in ``lists``
    (``total``). Nodes that can't be linked are left out."""
    node = Window.partitionBy("id")
    least = F.expr("(3 * n + 3) div 4")
    sized = lists.withColumn("total", F.count("*").over(node)).withColumn("place", F.row_number().over(node.orderBy("k", "s")))
    return sized.withColumn("head", F.col("total") - least + 1).where("place <= head").drop("place", "k")


def slots(shingles: np.ndarray, size: int) -> np.ndarray:
    return (mixed(shingles.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def order_table(rows: DataFrame, size: int) -> np.ndarray:
    """A byte for each of ``size`` slots: 0 if the shingles there are of one component at most, else more for more components.

    ``rows`` is (component, shingles, ...). A component counts once for each batch that it is in.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("shingles").to_pylist()
            component = np.repeat(batch.column("component").to_numpy(), [len(x) // 8 for x in raw])
            slot = slots(np.frombuffer(b"".join(raw), np.int64), size)
            by = np.lexsort((component, slot))
            slot, component = slot[by], component[by]
            new = np.ones(len(slot), bool)
            new[1:] = (slot[1:] != slot[:-1]) | (component[1:] != component[:-1])
            slot, component = slot[new], component[new]
            slot, first, count = np.unique(slot, return_index=True, return_counts=True)
            columns = [(slot % BLOCK).astype(np.uint16), count.astype(np.int32), component[first], component[first + count - 1]]
            block, start = np.unique(slot // BLOCK, return_index=True)
            packed = [pa.array([x.tobytes() for x in np.split(c, start[1:])] if len(block) else [], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(block), *packed], ["block", "slot", "count", "least", "most"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] not in tables:
                    ends = np.iinfo(np.int64)
                    tables[r["block"]] = np.zeros(BLOCK, np.int64), np.full(BLOCK, ends.max), np.full(BLOCK, ends.min)
                count, least, most = tables[r["block"]]
                slot = np.frombuffer(r["slot"], np.uint16)
                count[slot] += np.frombuffer(r["count"], np.int32)
                least[slot] = np.minimum(least[slot], np.frombuffer(r["least"], np.int64))
                most[slot] = np.maximum(most[slot], np.frombuffer(r["most"], np.int64))
        for block, (count, least, most) in tables.items():
            rank = np.where(least < most, np.minimum(1 + 12 * np.log2(np.maximum(count, 1)), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([rank.tobytes()], pa.binary())], ["block", "ranks"])

    parts = map_arrow(rows.select("component", "shingles"), counted, "block long, slot binary, count binary, least binary, most binary")
    out = np.zeros((size // BLOCK, BLOCK), np.uint8)
    for r in map_arrow(parts.repartition("block"), summed, "block long, ranks binary").collect():
        out[r.block] = np.frombuffer(r.ranks, np.uint8)
    return out.ravel()


def hashed_prefixes(rows: DataFrame, size: int) -> DataFrame:
    """The like of ``prefixes`` of ``rows`` (id, n, component, shingles), in the order of ``order_table``."""
    shared = rows.sparkSession.sparkContext.broadcast(order_table(rows, size))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                some = batch.slice(at, SETS_AT_ONCE)
                found, total = [], []
                for raw, n in zip(some.column("shingles").to_pylist(), some.column("n").to_pylist(), strict=True):
                    s = np.frombuffer(raw, np.int64)
                    rank = shared.value[slots(s, size)]
                    s, rank = s[rank > 0], rank[rank > 0]
                    total.append(len(s))
                    found.append(s[np.lexsort((s, rank))[: max(0, len(s) - (3 * n + 3) // 4 + 1)]])
                head = np.array([len(x) for x in found])
                columns = [np.repeat(x, head) for x in (*(some.column(c).to_numpy() for c in ("component", "id", "n")), np.array(total), head)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(found), *columns)], ["s", "component", "id", "n", "total", "head"])

    return map_arrow(rows.select("id", "n", "component", "shingles"), kernel, "s long, component long, id long, n long, total long, head long")


def with_parities(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``nodes`` (id, component, n, head, total) with the parities of their sets: ``parity`` has 64-bit words, a power of two
    of them, and ``brief`` the same folded to ``WORDS``."""
    columns = ["id", "component", "n", "head", "total"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = []
            for raw in batch.column("shingles").to_pylist():
                size = 1 << max((64 * WORDS - 1).bit_length(), (PARITY_BITS * (len(raw) // 8) - 1).bit_length())
                odd = np.bincount(slots(np.frombuffer(raw, np.int64), size), minlength=size) & 1
                full.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            brief = [np.bitwise_xor.reduce(x.reshape(-1, WORDS)) for x in full]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x, pa.list_(pa.int64())) for x in (full, brief))], [*columns, "parity", "brief"])

    return map_arrow(nodes.join(sets, "id").select(*columns, "shingles"), kernel, "id long, component long, n long, head long, total long, parity array<long>, brief array<long>")


def differing(x: Column, y: Column) -> Column:
    """How many parities differ. The longer ones are folded to the length of the others: sizes that may be linked are one step apart."""
    bits = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    half = lambda p: F.zip_with(F.slice(p, F.lit(1), (F.size(p) / 2).cast("int")), F.slice(p, (F.size(p) / 2 + 1).cast("int"), (F.size(p) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    return F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(half(x), y)).when(F.size(y) == 2 * F.size(x), bits(x, half(y))).otherwise(0)


def meetings(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each shingle of the prefixes ``heads`` and two components that may be linked by nodes that have it there.

    Where it is one node on either side, their parities in ``nodes`` tell.
    """
    agreed = heads.join(nodes.select("id", "brief"), "id").groupBy("s", "component")
    sides = agreed.agg(F.max(7 * F.col("total") - 3 * F.col("n")).alias("room"), F.min("n").alias("least"), F.max(F.col("total") - F.col("head")).alias("rest"), F.when(F.count("*") == 1, F.first("brief")).alias("brief"))
    x, y = (sides.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("component", "room", "least", "rest", "brief")]) for k in "ab")
    met = x.join(y, "s").where("component_a < component_b and room_a >= 3 * least_b and room_b >= 3 * least_a")
    apart = sum((F.bit_count(F.col("brief_a")[i].bitwiseXOR(F.col("brief_b")[i])) for i in range(WORDS)), F.lit(0))
    return met.where(F.coalesce(7 * apart <= F.col("least_a") + F.col("least_b"), F.lit(True))).drop("brief_a", "brief_b")


def prefix_pairs(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the ``nodes`` of ``heads``, with parities, whose components share shingles of their prefixes, and which may be linked."""
    met = meetings(heads, nodes)
    sums = met.groupBy("component_a", "component_b").agg(F.count("*").alias("common"), *[F.max(f"rest_{k}").alias(f"rest_{k}") for k in "ab"], *[F.min(f"least_{k}").alias(f"least_{k}") for k in "ab"])
    pairs = sums.where("7 * (common + greatest(rest_a, rest_b)) >= 3 * (least_a + least_b)").select("component_a", "component_b", "common", F.col("rest_b").alias("most_b"), F.col("least_b").alias("fewest_b"))
    for k in "ab":
        pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "component", "n", "head", "total", "parity")]), f"component_{k}")
        if k == "a":
            pairs = pairs.where("7 * (least(common, head_a) + greatest(total_a - head_a, most_b)) >= 3 * (n_a + fewest_b) and 7 * total_a >= 3 * (n_a + fewest_b)")
    pairs = pairs.where("7 * (least(common, head_a, head_b) + greatest(total_a - head_a, total_b - head_b)) >= 3 * (n_a + n_b)")
    pairs = pairs.where("7 * least(total_a, total_b) >= 3 * (n_a + n_b) and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    pairs = pairs.where(7 * differing(F.col("parity_a"), F.col("parity_b")) <= F.col("n_a") + F.col("n_b"))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def dense_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): every pair of ``nodes`` (id, n, component) in two components that may be over the threshold.

    ``sets`` (id, shingles) has the full set of each node, and maybe others.
    """
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    size = max(BLOCK, 1 << (SLOTS * shingles - 1).bit_length())
    if size > MOST_SLOTS:
        lists = stored(inverted(nodes, sets), "lists")
        heads = stored(prefixes(shared(lists)), "prefixes")
    else:
        lists = stored(sets.join(nodes.select("id", "n", "component"), "id"), "dense-sets")
        heads = stored(hashed_prefixes(lists, size), "prefixes")
    forget(lists)
    ends = stored(with_parities(heads.select("id", "component", "n", "head", "total").distinct(), sets), "prefix-nodes")
    pairs = stored(prefix_pairs(heads, ends), "dense-pairs")
    forget(heads)
    forget(ends)
    return pairs.distinct()
