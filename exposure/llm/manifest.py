"""A Merkle manifest of a table, with a proof for every row, by nested-struct rollup.

A row is a leaf: the sha256 of its fields, each with its length. Per language the leaves ascend by doc_id; two consecutive nodes
become the hash of both, a last single one the hash of itself, until one is left. These subroots, ordered by language, are
leaves of one more tree of the same kind, whose root stands for the table.

``rolled`` works on blocks of 2^``DIGITS`` consecutive ranks. The binary digits of a rank are columns; grouping by all digits but the last one, then by
all but the last two, and so on, nests two child structs in their parent each time. All groupings of a block have
its number in front, so the rows move once, and each grouping finds them sorted. The result is one row per block, with the block's subtree in it,
and the blocks' hashes are the nodes of the next round, 2^``DIGITS`` times fewer. On the way back a block gets what is above it as a second row of its
own key; a transform goes down the nested structs with the siblings met so far, and an explode emits the leaves with their
proofs. No proof is looked up by a join, and no task holds more than blocks of bounded size, whatever the share of one language.

Ranks come from a table sorted by range over language and doc_id, so that a hot language is many ranges: the place in the range and the
rows of the ranges before it.

Nulls are hashed as ``-``; a null language is a tree of its own, before all others, and a null doc_id comes before all others
of its language. Rows of equal doc_id follow each other by their leaf hash; rows that repeat are leaves each. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.scratch import saved

DIGITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(replaced: dict[str, Column] | None = None) -> Column:
    columns = {c: F.col(c) for c in FIELDS} | (replaced or {})
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and ``changed``, the leaf of a row that is tampered with (null for the others)."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    more = leaf_hash({"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    return docs.select("doc_id", "lang", leaf_hash().alias("leaf"), F.when(chosen, more).alias("changed"))


def ranked(nodes: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """Add ``rank``, the place of a row in its tree from 0 on, and ``size``, the rows of the tree. Rows that tie in ``order`` must be equal."""
    # Equal rows may be many; by the running number they spread over ranges too.
    keys = [F.col(c).asc_nulls_first() for c in tree + order] + [F.col("_tie")]
    placed = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = saved(placed.select("*", F.spark_partition_id().alias("_range"), within.alias("_at")))
    # One row per range and tree that has rows there: as many as ranges and trees.
    parts = rows.groupBy("_range", *tree).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*tree)
    before = F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offset = (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset")
    offsets = parts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_of_{c}") for c in tree], offset, F.sum("_n").over(own).alias("size"))
    same = F.col("_range") == F.col("_r")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(offsets, same).select(*nodes.columns, (F.col("_offset") + F.col("_at")).alias("rank"), "size")


def _depth(size: Column) -> Column:
    """Levels of a tree of this many leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def rolled(nodes: DataFrame, tree: list[str], below: int) -> DataFrame:
    """One row ``tree, block, size, node`` for each block of ``nodes (tree, rank, size, node)``, which are ``below`` levels above the leaves."""
    digits = [f"_d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        *tree, F.shiftright("rank", DIGITS).alias("block"), "size", *[F.shiftright("rank", k).bitwiseAND(F.lit(1)).alias(d) for k, d in enumerate(digits)], "node"
    ).repartition(*tree, "block")
    for k, digit in enumerate(digits):
        children = [F.first(F.when(F.col(digit) == side, F.col("node")), ignorenulls=True).alias(name) for side, name in ((0, "_left"), (1, "_right"))]
        rows = rows.groupBy(*tree, "block", "size", *reversed(digits[k + 1 :])).agg(*children)
        both = F.sha2(F.concat("_left.hash", F.coalesce(F.col("_right.hash"), F.lit(""))), 256)
        # Above the top of its tree a node stands for itself.
        hashed = F.when(below + k + 1 <= _depth(F.col("size")), both).otherwise(F.col("_left.hash"))
        kids = F.array_compact(F.array("_left", "_right"))
        rows = rows.select(*tree, "block", "size", *reversed(digits[k + 1 :]), F.struct(hashed.alias("hash"), kids.alias("kids")).alias("node"))
    return rows


def _walk(node: Column, path: Column, depth: Column, below: int, level: int) -> Column:
    """The leaves under a node, each with its siblings from the lowest level up: (left, right), one or both of them empty."""
    if level == 0:
        return F.array(F.struct(node.alias("node"), path.alias("path")))
    kids, none = node["kids"], F.lit("")

    def go(kid: Column, i: Column) -> Column:
        left = F.when(i == 1, kids[0]["hash"]).otherwise(none)
        right = F.when((i == 0) & (F.size(kids) == 2), kids[1]["hash"]).otherwise(none)
        met = F.array(F.struct(left.alias("left"), right.alias("right")))
        return _walk(kid, F.when(below + level <= depth, F.concat(met, path)).otherwise(path), depth, below, level - 1)

    return F.flatten(F.transform(kids, go))


def emitted(blocks: DataFrame, tree: list[str], below: int, above: DataFrame | None) -> DataFrame:
    """``tree, node, path, top`` of each node that the blocks were rolled from. ``above (tree, block, path, top)`` has what is over each block;
    without it the blocks are tops themselves."""
    key = [*tree, "block"]
    if above is None:
        whole = blocks.withColumns({"path": F.array().cast("array<struct<left:string,right:string>>"), "top": F.struct(F.col("node.hash").alias("root"))})
    else:
        both = blocks.unionByName(above, allowMissingColumns=True)
        whole = both.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "path", "top")])
    found = _walk(F.col("node"), F.col("path"), _depth(F.col("size")), below, DIGITS)
    return whole.select(*tree, "top", F.explode(found).alias("_leaf")).select(*tree, "_leaf.node", "_leaf.path", "top")


def rounds(nodes: DataFrame, tree: list[str]) -> list[DataFrame]:
    """The blocks of each round, from the leaves up to one block a tree."""
    nodes = saved(nodes)
    most = nodes.agg(F.max(_depth(F.col("size")))).first()[0] or 0
    out = [saved(rolled(nodes, tree, 0))]
    while len(out) * DIGITS < most:
        below = out[-1].select(*tree, F.col("block").alias("rank"), "size", F.struct("node.hash", F.col("block").alias("rank")).alias("node"))
        out.append(saved(rolled(below, tree, len(out) * DIGITS)))
    return out


def proven(blocks: list[DataFrame], tree: list[str], above: DataFrame | None) -> DataFrame:
    for k in reversed(range(len(blocks))):
        found = emitted(blocks[k], tree, k * DIGITS, above)
        if k:
            above = found.select(*tree, F.col("node.rank").alias("block"), "path", "top")
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs (doc_id, source, lang, n_chars, text)``."""
    own = ranked(leaves(docs), ["lang"], ["doc_id", "leaf"])
    trees = rounds(own.select("lang", "rank", "size", F.struct(F.col("leaf").alias("hash"), "doc_id", "changed").alias("node")), ["lang"])
    subroots = ranked(trees[-1].select("lang", F.col("node.hash").alias("hash")), [], ["lang"])
    tops = rounds(subroots.select("rank", "size", F.struct("hash", "lang").alias("node")), [])
    above = proven(tops, [], None).select(
        F.col("node.lang").alias("lang"), F.lit(0).cast("long").alias("block"), "path", F.struct(F.col("node.hash").alias("subroot"), "top.root").alias("top")
    )
    found = proven(trees, ["lang"], above)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    start = F.coalesce(F.col("node.changed"), F.col("node.hash"))
    folded = F.aggregate("path", start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))
    out = found.select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.hash").alias("leaf"), "top.subroot", "top.root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
