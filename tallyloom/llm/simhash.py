"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints meet in one row first. The distinct ones are laid out in tiles by the population
counts of their four 16-bit quarters: when two fingerprints differ in at most r bits, these four
counts differ by at most r in sum, so tile pairs further apart are skipped and nothing is lost.
Tiles that are left are compared whole with numpy exclusive-or and bit counts. A tile
pair returns a spanning forest of its links, never all of its pairs.

Groups by shingle similarity use the same comparison on 256-bit fingerprints of the distinct shingles, in tiles of like population count and
size, to find the parts that candidates join: the first 64 bits within one radius, all of them within another. Candidates of a part are verified
on the texts before any is left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

CHUNK = 1 << 15


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        pairs = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())
        h = np.array([digest(joined[s:e], 42) for s, e in pairs], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, row_key, fp)``: one row per row of ``docs``; row_key is xxhash64 of the text, fp holds the 64 bits as a long. Null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, width) for t in b.column(2).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "row_key", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text")).mapInArrow(
        run, "id long, row_key long, fp long"
    )


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the links that make a minimum spanning forest of n members: every group stays whole, with its closest pairs."""
    label, at, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        apart = label[a[at]] != label[b[at]]
        at = at[apart]
        if not len(at):
            return np.concatenate(chosen) if chosen else at
        key = weight[at].astype(np.int64) * len(a) + at
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[a[at]], key)
        np.minimum.at(best, label[b[at]], key)
        picked = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        chosen.append(picked)
        while True:  # members of joined groups take the smallest label
            low = label.copy()
            for x, y in ((a, b), (b, a)):
                np.minimum.at(low, label[x[picked]], label[y[picked]])
            low = low[low[label]]
            if np.array_equal(low, label):
                break
            label = low


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, whole: int, same: bool, sizes: tuple[np.ndarray, np.ndarray] | None = None, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in left, in right and differing bits of all links between two tiles of shape (words of the fingerprint, members).

    The first word differs in ``radius`` bits or fewer and all words in ``whole``; with sizes, the smaller is ``ratio`` of the larger at least.
    """
    rows, found = max(1, (1 << 20) // max(1, right.shape[1])), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))]
    for k in range(0, left.shape[1], rows):
        bits = np.bitwise_count(left[0, k : k + rows, None] ^ right[0])
        i, j = np.nonzero(bits <= radius)
        w, i = bits[i, j].astype(int), i + k
        good = i < j if same else np.ones(len(i), bool)
        if sizes is not None:
            x, y = sizes[0][i], sizes[1][j]
            good &= np.minimum(x, y) >= ratio * np.maximum(x, y)
        i, j, w = i[good], j[good], w[good]
        if len(left) > 1:
            w = w + np.bitwise_count(left[1:, i] ^ right[1:, j]).sum(axis=0, dtype=int)
            near = w <= whole
            i, j, w = i[near], j[near], w[near]
        found.append((i, j, w))
    return tuple(np.concatenate(x) for x in zip(*found))


def compare(left: np.ndarray, right: np.ndarray, radius: int, whole: int, same: bool, sizes: tuple[np.ndarray, np.ndarray] | None = None, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of a spanning forest of all links between two tiles; see ``close_pairs``."""
    i, j, w = close_pairs(left, right, radius, whole, same, sizes, ratio)
    n = left.shape[1]
    kept = spanning(n if same else n + right.shape[1], i, j if same else j + n, w)
    return i[kept], j[kept]


class Layout(NamedTuple):
    """Cells of the tiles: coordinates with their number of values, and the moves that lead to cells in which a link can end."""

    coordinates: list[Column]
    sides: list[int]
    moves: list[tuple[int, ...]]


def by_quarters(radius: int) -> Layout:
    """Population counts of the four 16-bit quarters; they differ by at most the radius in sum."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF)) for q in range(4)]
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    return Layout(quarters, [17] * 4, [d for d in steps if sum(map(abs, d)) <= radius])


def by_size(radius: int, ratio: float) -> Layout:
    """Population count, and the size on a scale whose step is the ratio: similar sets lie in the same step or in neighbouring ones."""
    step = F.least(F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(ratio)), F.lit(199)).cast("int")
    return Layout([F.bit_count("fp"), step], [65, 200], list(itertools.product(range(-radius, radius + 1), (-1, 0, 1))))


def near_links(nodes: DataFrame, radius: int = 2, tile_size: int = 1024, layout: Layout | None = None, ratio: float = 0.0, whole: int = 0) -> DataFrame:
    """``(a, b)``: links that span every group of ``nodes(node, size, fp, ...)``; each is a pair within the radius. ``node`` is unique.

    Further columns named fp1, fp2 and so on hold more bits; then all bits must differ in ``whole`` at most.
    """
    spark = nodes.sparkSession
    carried = ["node", "size", *sorted(c for c in nodes.columns if c.startswith("fp"))]
    layout = layout or by_quarters(radius)
    scale = [math.prod(layout.sides[:q]) for q in range(len(layout.sides))]
    cell = sum((c * k for c, k in zip(layout.coordinates[1:], scale[1:])), layout.coordinates[0])
    placed = nodes.select(*carried, cell.cast("int").alias("cell"))
    # at most 17^4 or 65 x 200 cells, whatever the input: small enough to broadcast
    sizes = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / tile_size).cast("int").alias("n_tiles")), "cells")
    tiles = (
        placed.join(F.broadcast(sizes), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int"))
        .groupBy("cell", "tile")
        .agg(F.collect_list(F.struct(*carried)).alias("m"))
        .select("cell", "tile", *[F.col(f"m.{c}").alias(c) for c in carried])
    )
    tiles = stored(tiles, "tiles")
    ahead = [(sum(x * k for x, k in zip(d, scale)), *d) for d in layout.moves if sum(x * k for x, k in zip(d, scale)) >= 0]
    moves = spark.createDataFrame(ahead, "move int, " + ", ".join(f"m{q} int" for q in range(len(scale))))
    inside = F.lit(True)
    for q, (k, side) in enumerate(zip(scale, layout.sides)):
        inside &= (F.floor(F.col("cell") / k) % side + F.col(f"m{q}")).between(0, side - 1)
    # at most 21 moves from each of 17^4 cells, or 74 from 65 x 200: under 1.8 million rows of 12 bytes
    cell_pairs = sizes.select("cell").hint("broadcast").join(moves, inside).select("cell", (F.col("cell") + F.col("move")).alias("other"))
    cell_pairs = cell_pairs.join(F.broadcast(sizes.select(F.col("cell").alias("other"), "n_tiles")), "other")
    left = (
        tiles.join(F.broadcast(stored(cell_pairs, "cell_pairs")), "cell")
        .select("cell", "tile", *carried, "other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("other_tile"))
        .where("cell <> other or tile <= other_tile")
    )
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), *[F.col(c).alias(f"other_{c}") for c in carried])
    same = (F.col("cell") == F.col("other")) & (F.col("tile") == F.col("other_tile"))
    pairs = left.join(right.hint("shuffle_hash"), ["other", "other_tile"]).select(same.alias("same"), *carried, *[f"other_{c}" for c in carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                parts = [c[k].values.to_numpy() for c in batch.columns[1:]]
                (node, size, *fp), (other_node, other_size, *other_fp) = parts[: len(carried)], parts[len(carried) :]
                i, j = compare(np.stack(fp).view("u8"), np.stack(other_fp).view("u8"), radius, whole, batch.column(0)[k].as_py(), (size, other_size) if ratio else None, ratio)
                out.append((node[i], other_node[j]))
            x, y = (np.concatenate([o[s] for o in out]) if out else np.zeros(0, "i8") for s in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 2,
    tile_size: int = 1024,
) -> DataFrame:
    """One row per document: ``(id_col, fingerprint, component_id, row_key)``.

    Documents are linked where their fingerprints differ in ``radius`` bits or fewer; component_id is the
    smallest id that links lead to. Null and wordless texts have fingerprint zero and are linked like any
    other. Rows with a null id stay, with the component of their text (null if no member has an id).
    Repeated rows give repeated rows. An empty table gives no rows. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    nodes = distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("size"))
    roots = connected_components(near_links(nodes, radius, tile_size))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    named = stored(named, "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stored(named.join(stored(lows, "lows"), "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row_key"
    )


def shingle_set(text: str | None, width: int) -> set[int]:
    words = (text or "").encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[k : k + width])) for k in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a: str | None, b: str | None, width: int) -> float:
    """Shared over all shingles of two texts; two texts without words are alike."""
    x, y = shingle_set(a, width), shingle_set(b, width)
    return len(x & y) / len(x | y) if x or y else 1.0


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Four unsigned 64-bit words, the 256-bit fingerprint of a set of XXH64 values; zero for the empty set."""
    votes = np.zeros(256, np.int64)
    for k in range(0, len(shingles), CHUNK):
        h = shingles[k : k + CHUNK, None] + np.arange(4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 32), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(shingles), bitorder="little").view("<u8").astype(np.uint64)


def verified_pairs(nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, sides: np.ndarray, texts: list[str | None], radius: int, whole: int, least: float, width: int) -> list[tuple[int, int]]:
    """Links that span every group of similar texts: candidates, closest fingerprints first, are checked on the texts before one is left out, and
    left out only where verified links already join their ends. With two sides only pairs across them count. fps: (words, members)."""
    sets: dict[int, np.ndarray] = {}

    def shingles(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = np.sort(np.fromiter(shingle_set(texts[k], width), "u8"))
        return sets[k]

    one = sides.min() == sides.max()
    x, y = (np.flatnonzero(sides == side) for side in (sides.min(), sides.max()))
    i, j, bits = close_pairs(fps[:, x], fps[:, y], radius, whole, one, (sizes[x], sizes[y]), least)
    a, b = x[i], y[j]
    order = np.lexsort((nodes[b], nodes[a], bits))
    up, links = list(range(len(nodes))), []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        r, s = x, y
        while up[r] != r:
            up[r] = r = up[up[r]]
        while up[s] != s:
            up[s] = s = up[up[s]]
        if r == s:
            continue
        p, q = shingles(x), shingles(y)
        shared = len(np.intersect1d(p, q, assume_unique=True))
        if not len(p) + len(q) or shared / (len(p) + len(q) - shared) >= least:
            up[max(r, s)] = min(r, s)
            links.append((int(nodes[x]), int(nodes[y])))
    return links


def verified_links(members: DataFrame, radius: int, whole: int, least: float, width: int, block: int = 64, most_blocks: int = 16, largest: int = 4096) -> DataFrame:
    """``(a, b)``: links that span every group of similar texts in ``members(node, fp, fp1, fp2, fp3, size, part, text)``.

    A candidate never leaves its part. A part is dealt into blocks (of ``block`` members, larger ones from ``most_blocks`` on, up to
    ``largest``), and every pair of blocks is compared whole, so that no part has to fit into one task.
    """
    counted = stored(members.groupBy("part").agg(F.count("*").alias("n")), "part_sizes")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(most_blocks)), F.ceil(F.col("n") / largest)).cast("int")
    dealt = members.join(counted.select("part", blocks.alias("n_blocks")), "part").withColumn("side", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    key, words = ["part", "low_block", "high_block"], ["fp", "fp1", "fp2", "fp3"]
    dealt = dealt.select("part", F.least("side", "other").alias("low_block"), F.greatest("side", "other").alias("high_block"), "side", "node", *words, "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(pieces)
            x = {c: t.column(c).to_numpy() for c in ("node", *words, "size", "side")}
            lone = t.column(1)[0].as_py() != t.column(2)[0].as_py() and x["side"].min() == x["side"].max()  # a block whose partner is empty
            links = [] if lone else verified_pairs(x["node"], np.stack([x[c] for c in words]).view("u8"), x["size"], x["side"], t.column("text").to_pylist(), radius, whole, least, width)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if held and keys[at] != last:
                    yield linked(held)
                    held = []
                last = keys[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield linked(held)

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 24, whole: int = 84, tile_size: int = 1024, broadcast_keys: int = 500_000) -> DataFrame:
    """``(id_col, row_key, component_id)`` per row: texts whose sets of ``width``-word shingles share ``least`` or more are linked.

    Candidates are texts whose 256-bit fingerprints differ in ``whole`` bits or fewer, and in ``radius`` of the first 64. At a similarity of 0.8
    about 39 and 10 bits differ, with deviations of 6 and 3 (48 and 12 for four or five shingles, the worst sizes), and of unrelated texts 128 and 32
    with 8 and 4: so fewer than one link in ten thousand at the threshold is missed, and unrelated texts are no candidates. Tiles of like population
    count and size give the parts that candidates join; within a part each candidate is checked on the whole texts, unless checked links join its
    ends already. Equal texts are one node. Ids as in ``near_duplicates``.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, words = [], np.zeros((b.num_rows, 4), np.uint64)
            for k, t in enumerate(b.column(2).to_pylist()):
                shingles = np.fromiter(shingle_set(t, width), np.uint64)
                sizes.append(len(shingles))
                words[k] = sketch(shingles)
            fps = [pa.array(np.ascontiguousarray(words[:, q]).view("i8")) for q in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *fps, pa.array(sizes, pa.int32())], ["id", "row_key", "fp", "fp1", "fp2", "fp3", "size"])

    prints = stored(rows.mapInArrow(describe, "id long, row_key long, fp long, fp1 long, fp2 long, fp3 long, size int"), "sketches")
    words = ["fp", "fp1", "fp2", "fp3"]
    nodes = stored(prints.groupBy(F.col("row_key").alias("node")).agg(*[F.min(c).alias(c) for c in (*words, "size")], F.min("id").alias("low")), "nodes")
    pairs = stored(near_links(nodes.select("node", *words, "size"), radius, tile_size, by_size(radius, least), least, whole).distinct(), "candidates")
    parts = stored(connected_components(pairs).select("node", F.col("root").alias("part")), "parts")
    wanted = parts.select(F.col("node").alias("row_key"))
    wanted = F.broadcast(wanted) if parts.count() <= broadcast_keys else wanted
    texts = stored(rows.join(wanted, "row_key").groupBy(F.col("row_key").alias("node")).agg(F.first("text").alias("text")), "texts")
    links = stored(verified_links(nodes.join(parts, "node").join(texts, "node"), radius, whole, least, width), "links")
    roots = connected_components(links)
    named = stored(nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "named")
    lows = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = stored(named.join(lows, "root").select(F.col("node").alias("row_key"), "component_id"), "classes")
    return prints.join(classes, "row_key").select(F.col("id").alias(id_col), "row_key", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of similar texts: that with the smallest id. Columns stay as they are.

    A row without an id goes if its group has an id, else it stays. Rows that repeat id and text stay once.
    """
    found = stored(similar_groups(docs, id_col, text_col, **how), "near_duplicates")
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id"), F.col("row_key").alias("__key")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__key"))
    left = docs.join(gone, same, "left_anti")
    again = found.groupBy(id_col, "row_key").count().where("count > 1")
    return left if again.isEmpty() else left.dropDuplicates([id_col, text_col])
