"""Merkle manifest of a dataset: one leaf per row, a tree per group, and a tree over the groups' roots.

Leaves are ranked in their group by a range shuffle. 2^HEIGHT consecutive ranks are an aligned block, and the blocks' roots are the leaves of the next tier, so three tiers
hold more rows than there will be. Within a block the authentication paths are made by fractal traversal: for each storey of subtrees the existing one, which the
present leaf's path crosses, and the desired one, the next to its right, which a treehash stack completes by two steps a leaf just when it is needed. The paths of
the tiers above are made in the same way and appended by a join on the block.

A node is the lower-case hex SHA-256 of its children's digests, as text, one behind the other; the last node of a level may have one child only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

HEIGHT = 12  # of an aligned block: 4,096 leaves
SUBTREE = 3  # levels of a storey: memory is 2 * 4 storeys * 14 nodes, beside the block's own leaves
BROADCAST_ROWS = 300_000

LEFT, RIGHT, ALONE = "<", ">", "."  # an entry of a path: where the sibling stands, and its digest; ALONE without a sibling


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def treehash(leaf_at: Callable[[int], str], first: int, last: int, top: int, base: int, keep: dict) -> Generator[None, None, str]:
    """Digest of the node of level ``top`` over the leaves ``first`` to ``last`` - 1; each step is one leaf or one hash.

    ``first`` is a multiple of 2^top, and the leaves may end early. Nodes from level ``base`` to below ``top`` go to ``keep`` by (level, place).
    """
    stack: list[tuple[int, int, str]] = []

    def put(level: int, place: int, digest: str) -> None:
        stack.append((level, place, digest))
        if base <= level < top:
            keep[level, place] = digest

    def merge() -> None:
        level, place, right = stack.pop()
        put(level + 1, place >> 1, sha(stack.pop()[2] + right))

    paired = lambda: len(stack) > 1 and stack[-2][0] == stack[-1][0]
    for i in range(first, last):
        put(0, i, leaf_at(i))
        yield
        while paired():
            merge()
            yield
    while stack[-1][0] < top:  # the leaves ended early: what stands alone is hashed alone
        if paired():
            merge()
        else:
            level, place, digest = stack.pop()
            put(level + 1, place >> 1, sha(digest))
        yield
    return stack[-1][2]


def finish(steps: Generator[None, None, str]) -> str:
    while True:
        try:
            next(steps)
        except StopIteration as e:
            return e.value


def block_height(n: int, height: int, only: bool) -> int:
    """Levels above the leaves of a block of ``n``: all of them if other blocks follow or precede, else as many as it takes to one node."""
    return max(0, n - 1).bit_length() if only else height


def block_root(leaves: list[str], height: int) -> str:
    return finish(treehash(leaves.__getitem__, 0, len(leaves), height, 0, {}))


def fractal_paths(leaves: list[str], height: int, subtree: int = SUBTREE) -> Iterator[list[str]]:
    """The leaves' authentication paths up to level ``height``, bottom first, in order."""
    n, at = len(leaves), leaves.__getitem__
    storeys = [(low, min(low + subtree, height)) for low in range(0, height, subtree)]

    def begin(k: int, number: int, keep: dict) -> Generator[None, None, str] | None:
        low, top = storeys[k]
        first = number << top
        return treehash(at, first, min(n, (number + 1) << top), top, low, keep) if first < n else None

    existing: list[dict] = [{} for _ in storeys]
    desired: list[dict] = [{} for _ in storeys]
    for k in range(len(storeys)):
        finish(begin(k, 0, existing[k]))
    growing = [begin(k, 1, desired[k]) for k in range(len(storeys))]
    for j in range(n):
        for k, (_, top) in enumerate(storeys):
            if j and j & ((1 << top) - 1) == 0:  # the path crosses into the next subtree
                if growing[k] is not None:
                    finish(growing[k])
                existing[k], desired[k] = desired[k], {}
                growing[k] = begin(k, (j >> top) + 1, desired[k])
        path = []
        for k, (low, top) in enumerate(storeys):
            for level in range(low, top):
                place = j >> level
                sibling = existing[k].get((level, place ^ 1))
                path.append(ALONE if sibling is None else (LEFT if place & 1 else RIGHT) + sibling)
        yield path
        for k, steps in enumerate(growing):
            for _ in range(2):
                if steps is not None and next(steps, steps) is steps:
                    growing[k] = steps = None


def fold_path(digest: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for sibling in path:
        digest = sha(sibling[1:] + digest if sibling[0] == LEFT else digest + sibling[1:])
    return digest


def path_digest(path: list[str]) -> str:
    return sha("".join(sibling[1:] for sibling in path))


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``place``, the rank within ``group`` by ``order`` (nulls first) from 0, and ``size``, the group's rows, read from the shared folder.

    Rows go to tasks by ranges of all sort columns and a row number, so neither a large group nor equal rows meet in one task; only each range's counts are summed up.
    """
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    spread = stored(spread, name).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = spread.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    counts = counts.select("_group", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    counts = stored(counts, f"{name}-counts")  # at most one row for each group and one for each range
    side = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts.hint("merge")
    joined = spread.join(side, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_group", "_p", "_part", "_at", "_shift")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def next_tier(nodes: DataFrame, height: int) -> DataFrame:
    """The roots of the blocks of ``nodes`` (tree, place, node, size), with their own places and sizes."""

    def run(block: pa.Table) -> pa.Table:
        block = _sorted(block)
        size = block.column("size")[0].as_py()
        root = block_root(block.column("node").to_pylist(), block_height(size, height, size <= 1 << height))
        return pa.table({"tree": [block.column("tree")[0].as_py()], "place": [block.column("place")[0].as_py() >> height], "node": [root], "size": [((size - 1) >> height) + 1]})

    kept = nodes.select("tree", "place", "node", "size")
    return kept.groupBy("tree", F.shiftright("place", height).alias("block")).applyInArrow(run, "tree string, place long, node string, size long")


def with_paths(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """``nodes`` with ``path``: that within the block, made by fractal traversal, and behind it the path that ``upper`` (tree, place, path, more columns) has of the block."""
    own = [c for c in nodes.columns if c != "tree"]
    more = [c for c in upper.columns if c not in ("tree", "place", "path")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [nodes.schema["tree"], *(nodes.schema[c] for c in own), *(upper.schema[c] for c in more)]) + ", path array<string>"

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = _sorted(block)
        size, n = block.column("size")[0].as_py(), block.num_rows
        rest = above.column("path")[0].as_py()
        paths = [path + rest for path in fractal_paths(block.column("node").to_pylist(), block_height(size, height, size <= 1 << height))]
        out = {c: block.column(c) for c in ("tree", *own)} | {c: pa.array([above.column(c)[0].as_py()] * n, above.schema.field(c).type) for c in more}
        return pa.table(out | {"path": pa.array(paths, pa.list_(pa.string()))})

    left = nodes.withColumn("block", F.shiftright("place", height)).groupBy("tree", "block")
    return left.cogroup(upper.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(run, schema)


def tiers_of(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """``nodes`` and all tiers above them, the last with one row per tree: its root."""
    tiers, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1 or len(tiers) == 1:
        tiers.append(stored(next_tier(tiers[-1], height), f"{name}-tier{len(tiers)}"))
        most = ((most - 1) >> height) + 1
    return tiers


def down(tiers: list[DataFrame], upper: DataFrame, height: int) -> DataFrame:
    """The lowest tier's nodes with their paths; ``upper`` has the roots' paths."""
    for nodes in reversed(tiers[1:-1]):
        rest = with_paths(nodes, upper, height)
        upper = rest.drop("node", "size")
    return with_paths(tiers[0], upper, height)


def manifest(docs: DataFrame, group_col: str = "lang", key_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), extra: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: ``tree`` (the group: ``-`` for null, else ``=`` and its value), ``place``, ``size`` of the group, ``key``, ``node`` (the leaf), ``subroot``, ``root``,
    ``path`` (entries from the leaf to the root: ``<`` or ``>`` and the digest of the left or right sibling, ``.`` where there is none), and ``extra`` columns made from the row.

    Null keys come first in their group, and rows that repeat a key are ordered by their leaves, so the root doesn't depend on the order of the input. Null values have
    leaves of their own; other columns of ``docs`` don't count. Texts are read and hashed once; only digests are shuffled. An empty table gives no rows.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # sorts like the value, null first
    rows = docs.select(group.alias("tree"), F.col(key_col).alias("key"), leaf(*map(F.col, columns)).alias("node"), *[c.alias(k) for k, c in (extra or {}).items()])
    leaves = ranked(stored(rows, "merkle-leaves"), "tree", ["key", "node"], "merkle-ranked")
    tiers = tiers_of(leaves, height, "merkle")
    roots = tiers[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("group"), F.col("node"))
    groups = ranked(roots, "tree", ["group"], "merkle-groups")
    above = tiers_of(groups, height, "merkle-top")
    top = above[-1].select("tree", "place", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    upper = stored(down(above, top, height).select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"), "root"), "merkle-upper")
    return down(tiers, upper, height)


def folded(found: DataFrame, leaf_col: str = "node") -> DataFrame:
    """``found`` with ``proof_sha256``, the digest of the siblings in ``path``, and ``folded_root``, what ``leaf_col`` and the path lead to, in place of ``path``."""
    rest = [c for c in found.columns if c != "path"]
    at, path_at = found.columns.index(leaf_col), found.columns.index("path")
    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in rest) + ", proof_sha256 string, folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(path_at).to_pylist()
            proofs = [path_digest(p) for p in paths]
            roots = [fold_path(d, p) for d, p in zip(batch.column(at).to_pylist(), paths)]
            kept = [batch.column(k) for k in range(batch.num_columns) if k != path_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(proofs, pa.string()), pa.array(roots, pa.string())], [*rest, "proof_sha256", "folded_root"])

    return found.mapInArrow(run, schema)


def verified(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """Proofs of all rows, folded from a copy of the table in which the rows ``tampered`` have one added to n_chars: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null n_chars stay, so such rows verify. Nulls, repeated rows, clashing columns and empty tables as in ``manifest``.
    """
    changed = F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    plus = F.when(changed, leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    found = folded(manifest(docs, extra={"changed": plus}, height=height).withColumn("seen", F.coalesce("changed", "node")), "seen")
    return found.select(F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
