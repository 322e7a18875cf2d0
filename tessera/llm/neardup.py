"""Op 2, near-duplicates by an LSH forest over MinHash signatures.

A document is its set of 5-word shingles. Documents with equal sets become one node. Each of ``TREES`` trees orders the
nodes by a key of signature levels; the keys of all trees are range-partitioned and sorted together, so a dense region
is spread over tasks like any other. In an order, the neighbours of a node are its candidates as long as their common
prefix has ``LEAST_DEPTH`` levels: a sparse region is searched down to that depth, and a dense one as deep as its
nearest neighbours on either side (``WINDOW``) reach. Two sets of similarity 0.75 share a prefix of that depth in none
of the trees with probability (1 - 0.75**4)**40, under 1e-6.

Candidates are screened by their signatures, far below the threshold, and confirmed on full sets: first the best one of
each node, then those that still join two components. Nodes with more neighbours under a prefix than the window holds
are searched once more, with a wide window and for neighbours of other components alone. Nodes that have even more than
that are settled by an exact join on shingles (``dense``), so no window bounds what is found.

Nulls and edge cases: a document without words (null, empty or blank text) has no shingles and is linked with nothing.
Rows without a doc_id are linked with nothing, too. Rows that share a doc_id are documents of their own, whose
component_id is the smallest doc_id of their group; every row with that doc_id counts as kept. Texts of any length are
used whole. Repeated rows and exact copies fall together by the fingerprint of the set. Only doc_id and text are read,
so other columns of whatever name don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, map_arrow, partitions, spans_of_bytes, stored, texts_of
from tessera.llm.dense import dense_pairs
from tessera.llm.graphs import components
from tessera.llm.pretokens import mixed, range_hashes, runs

WORDS = 5
PERCENT = 75
TREES = 40
LEAST_DEPTH = 4
DEPTH = 12
HASHES = TREES * LEAST_DEPTH
WINDOW = 1
#: Nodes with so many candidates, and those at the ends of a run that has so many, are searched again with the wide
#: window and for neighbours in other components.
MANY = 2
WIDE_WINDOW = 32
#: Share of equal signature levels under which a candidate is not looked at; 0.75 less about six standard deviations, and
#: less about three where the candidates of dense regions are many.
SCREEN, WIDE_SCREEN = 0.55, 0.66
#: Bits a node in the filter that picks documents for the confirmation; a filter of more bits than the bound (8 MB) is not
#: broadcast, and the documents are joined by id instead.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26
BATCH_CHARS = 500_000

_rng = np.random.default_rng(20)
_byte_codes = mixed(np.arange(256) + 1000)
_byte_codes[ord("A") : ord("Z") + 1] = _byte_codes[ord("a") : ord("z") + 1]
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_places = mixed(np.arange(WORDS) + 77) | np.uint64(1)
_scale = (_rng.integers(0, 2**31, HASHES) * 2 + 1).astype(np.uint32)
_shift = _rng.integers(0, 2**32, HASHES).astype(np.uint32)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The set of each text as ascending 64-bit hashes."""
    raw = [x.encode("utf-8", "replace") for x in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
    blank = _blank[flat]
    start, end = runs(blank.astype(np.uint8), starts)
    if len(start):
        word = ~blank[start]
        start, end = start[word], end[word]
    words = range_hashes(_byte_codes[flat], start, end)
    first = np.searchsorted(start, starts)
    total = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        total += words[j : j + len(total)] * _places[j]
    total = mixed(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(total[a : b - WORDS + 1]))
        else:
            out.append(mixed(np.array([(words[a:b] * _places[: b - a]).sum()], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """One byte for each hash function: a scrambled part of its least value over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(least, (x[a : a + 512, None] * _scale + _shift).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch): size, fingerprint and signature of the set of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in spans_of_bytes(texts, BATCH_CHARS):
                sets = shingle_sets(texts[a:b])
                prints = [[int(mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64)) for s in sets] for salt in (1, 2)]
                columns = [pa.array(np.array(p, np.uint64).view(np.int64)) for p in prints]
                sketch = pa.array([signature(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *columns, sketch], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return map_arrow(docs.select("doc_id", "text"), kernel, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def tree_keys(nodes: DataFrame, *more: Column) -> DataFrame:
    """(row, id) of each node in each tree: the tree, its own levels, deeper ones taken from other trees' levels, and ``more``."""
    tags = F.posexplode(F.array(*[F.lit(bytes([t])) for t in range(TREES)])).alias("t", "tag")
    own = F.col("t") * LEAST_DEPTH + 1
    deeper = (F.col("t") + 13) % (TREES - 2) * LEAST_DEPTH + 1
    return nodes.select("*", tags).select(
        F.concat("tag", F.substring("sketch", own, F.lit(LEAST_DEPTH)), F.substring("sketch", deeper, F.lit(DEPTH - LEAST_DEPTH)), *more).alias("row"), "id"
    )


PAIRS = "kind int, a long, b long, row binary"
PAIR, END, CROWD = 0, 1, 2
LABEL = 8 + 8 + HASHES  # of a row of the second search, after its key: component, size and signature


def neighbour_pairs(window: int, labelled: bool = False):
    """A kernel over sorted (row, id), where row begins with the key: pairs of near rows (PAIR), rows that have more
    neighbours under their prefix than the window reaches (CROWD, their ids as bytes of one row), and the first and last rows of the partition (END).

    Of a run with more rows than the window reaches, CROWD names the first and the last one, as the others have pairs on
    both sides. With ``labelled`` it names all: then rows go on with a component, a size and a signature, and pairs are
    within no component and pass the screen.
    """
    width = 1 + DEPTH + (LABEL if labelled else 0)
    prefix, reach = 1 + LEAST_DEPTH, window + 1
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("row", pa.binary())])

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray, rows: np.ndarray | None = None) -> pa.RecordBatch:
        row = pa.nulls(len(a), pa.binary()) if rows is None else pa.array([r.tobytes() for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), row], schema=schema)

    def fits(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        label, size = (np.ascontiguousarray(rows[:, c : c + 8]).view(">i8").ravel() for c in (1 + DEPTH, 9 + DEPTH))
        ok = (label[x] != label[y]) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
        at = np.flatnonzero(ok)
        ok[at] = (rows[x[at], 17 + DEPTH :] == rows[y[at], 17 + DEPTH :]).mean(1) >= WIDE_SCREEN if len(at) else False
        return ok

    def crowded(rows: np.ndarray) -> np.ndarray:
        n = len(rows)
        if n <= reach:
            return np.zeros(0, np.int64)
        wide = np.flatnonzero((rows[:-reach, :prefix] == rows[reach:, :prefix]).all(1))
        if labelled:
            edge = np.bincount(wide, minlength=n + 1) - np.bincount(wide + reach + 1, minlength=n + 1)[: n + 1]
            return np.flatnonzero(np.cumsum(edge)[:n] > 0)
        same = np.concatenate(([False], (rows[1:, :prefix] == rows[:-1, :prefix]).all(1), [False]))
        return np.union1d(wide[~same[wide]], wide[~same[wide + reach + 1]] + reach)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, head = np.zeros((0, width), np.uint8), np.zeros(0, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, new_ids = np.frombuffer(b"".join(batch.column("row").to_pylist()), np.uint8).reshape(-1, width), batch.column("id").to_numpy()
            if head < reach:
                yield batch_of(END, new_ids[: reach - head], new_ids[: reach - head], new[: reach - head])
                head += min(len(new), reach - head)
            old = len(ids)
            rows, ids = np.concatenate((rows, new)), np.concatenate((ids, new_ids))
            found = [np.zeros((2, 0), np.int64)]
            for j in range(1, min(window, len(ids) - 1) + 1):
                at = np.arange(max(0, old - j), len(ids) - j)
                at = at[(rows[at, :prefix] == rows[at + j, :prefix]).all(1) & (ids[at] != ids[at + j])]
                if labelled:
                    at = at[fits(rows, at, at + j)]
                found.append(np.stack((np.minimum(ids[at], ids[at + j]), np.maximum(ids[at], ids[at + j]))))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            if pairs.shape[1]:
                yield batch_of(PAIR, pairs[0], pairs[1])
            crowd = np.unique(ids[crowded(rows)])
            if len(crowd):
                none = np.zeros(1, np.int64)
                yield batch_of(CROWD, none, none, crowd.view(np.uint8)[None, :])
            rows, ids = rows[-reach:], ids[-reach:]
        if len(ids):
            yield batch_of(END, ids, ids, rows)

    return kernel


def near_pairs(rows: DataFrame, window: int, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, that are near in the one sorted order of all (row, id), and the ids of CROWD."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), "row", "id").sortWithinPartitions("row", "id")
    found = stored(map_arrow(ordered, neighbour_pairs(window, labelled), PAIRS), "near")
    # the ends of the partitions, a window of rows of each, stream through one task
    ends = found.where(F.col("kind") == END).select("row", F.col("a").alias("id")).distinct().repartition(1).sortWithinPartitions("row", "id")
    across = map_arrow(ends, neighbour_pairs(window, labelled), PAIRS)
    both = stored(found.where(F.col("kind") != END).union(across.where(F.col("kind") != END)), "near-all")
    forget(found)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(batch.column("row").to_pylist()), np.int64)))], ["id"])

    crowd = map_arrow(both.where(F.col("kind") == CROWD).select("row"), unfold, "id long").distinct()
    return both.where(F.col("kind") == PAIR).select("a", "b").distinct(), crowd


def screened(pairs: DataFrame, nodes: DataFrame, least: float = SCREEN) -> DataFrame:
    """(a, b, likeness) of the pairs whose sizes and signatures allow a link."""
    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("s_a", "s_b")]
            like = (s[0] == s[1]).mean(1) if batch.num_rows else np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like)], ["a", "b", "likeness"])
            yield out.filter(pa.array(like >= least))

    return map_arrow(both.select("a", "b", "s_a", "s_b"), kernel, "a long, b long, likeness double")


def set_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles) of (id, text)."""
    for batch in batches:
        texts = texts_of(batch)
        for a, b in spans_of_bytes(texts, BATCH_CHARS):
            sets = [s.tobytes() for s in shingle_sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(sets, pa.binary())], ["id", "shingles"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents ``ids`` (id), and of some others where no text is shuffled for it.

    A filter of bits by hashed id goes to the scan, as long as it is small enough to broadcast; later joins are exact.
    """
    bits = 1 << max(15, (FILTER_BITS * ids.count()).bit_length())
    some = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    if bits > MOST_FILTER_BITS:
        return map_arrow(some.join(ids, "id", "left_semi"), set_kernel, "id long, shingles binary")
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    size = 1 << 15
    image = np.zeros((bits // size + 2, size // 8), np.uint8)
    for r in rows:
        image[r.bucket] = np.frombuffer(bytes(r.bits), np.uint8)[: size // 8]
    shared = docs.sparkSession.sparkContext.broadcast(image)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, place = (batch.column(c).to_numpy() for c in ("bucket", "place"))
            yield from set_kernel(iter([batch.filter(pa.array(shared.value[bucket, place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1))]))

    some = some.withColumn("slot", slot)
    return map_arrow(some.select("id", "text", F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("place")), kernel, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs (a, b) whose full sets are alike enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((np.diff(np.sort(np.concatenate((x, y)), kind="stable")) == 0).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "s_a", "s_b"), kernel, "u long, v long")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet; ``labels`` (id, component) lacks nodes that are their own."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def best_of(pairs: DataFrame) -> DataFrame:
    """The likeliest pair of each node."""
    both = pairs.union(pairs.select("b", "a", "likeness"))
    best = both.groupBy("a").agg(F.max(F.struct("likeness", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def big_endian(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with the component that the links ``found`` make."""
    return nodes.join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect the ``nodes`` (id, n, sketch) as all pairs over the threshold would."""
    pairs, run_ends = near_pairs(tree_keys(nodes), WINDOW)
    pairs = stored(pairs, "pairs")
    near = stored(screened(pairs, nodes), "candidates")
    # a node in a wider run has several candidates: its neighbours differ from tree to tree
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    crowd = stored(ends.where(F.col("n") >= MANY).select("id").union(run_ends).distinct(), "dense")
    forget(run_ends)
    asked = stored(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).union(crowd).distinct(), "asked")
    sets = stored(sets_of(docs, asked), "sets")
    first = stored(confirmed(best_of(near), sets), "links")
    found = stored(first.union(confirmed(apart(near, components(first)), sets)), "links")
    some = labelled(nodes.join(crowd, "id", "left_semi"), found)
    wide, left = near_pairs(tree_keys(some, big_endian(F.col("component")), big_endian(F.col("n")), F.col("sketch")), WIDE_WINDOW, labelled=True)
    more = stored(found.union(confirmed(wide, sets)), "links")
    last = stored(left, "crowded")
    forget(left)
    if not last.isEmpty():
        rest = stored(labelled(nodes.select("id", "n").join(last, "id", "left_semi"), more), "crowded-nodes")
        more = stored(more.union(confirmed(dense_pairs(rest, sets), sets)), "links")
    for old in (pairs, near, crowd, asked, first, found, last):
        forget(old)
    return more


def _near_duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` with their ``rows`` as prepared; no doc_id repeats."""
    some = rows.where("doc_id is not null and n_shingles > 0")
    nodes = stored(some.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "sketch")).alias("least")).select("f1", "f2", "n_shingles", F.col("least.doc_id").alias("id"), F.col("least.sketch").alias("sketch")), "nodes")
    found = components(links(docs, nodes.select("id", F.col("n_shingles").alias("n"), "sketch")))
    named = nodes.select("f1", "f2", F.col("n_shingles").alias("n"), "id").join(found, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = some.join(named, (some["f1"] == named["f1"]) & (some["f2"] == named["f2"]) & (some["n_shingles"] == named["n"])).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return joined.union(alone)


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """``docs`` (doc_id, text, row) and its signatures by row, which is doc_id unless doc_ids repeat (then the third is true)."""
    rows = stored(prepared(docs), "signatures")
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, rows, False
    forget(rows)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return docs, stored(prepared(docs.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")), "signatures"), True


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs, rows, repeat = _prepared(docs.select("doc_id", "text"))
    if not repeat:
        out = _near_duplicates(docs, rows)
    else:
        out = _grouped(docs, rows).select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _grouped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, first) of numbered ``docs``: the smallest doc_id of each row's group, and its first row."""
    named = docs.select("row", "doc_id")
    found = _near_duplicates(docs.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), rows)
    found = stored(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group")).join(named, "row"), "grouped")
    least = found.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("group", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first"))
    alone = docs.where("doc_id is null").select("row", "doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.col("row").alias("first"))
    return found.join(least, "group").select("row", "doc_id", "n_shingles", "component_id", "first").union(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near-duplicates: of each group the first row with its smallest doc_id stays.

    Rows without a doc_id stay, and all columns stay as they are.
    """
    plain, rows, repeat = _prepared(docs.select("doc_id", "text"))
    if not repeat:
        gone = _near_duplicates(plain, rows).where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    row = f"row-{uuid.uuid4().hex}"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plain = numbered.select("doc_id", "text", F.col(f"`{row}`").alias("row"))
    rows = stored(prepared(plain.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")), "signatures")
    gone = _grouped(plain, rows).where("row <> first").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
