"""A Merkle manifest of a table: trees of digests over its rows, of which only every third level is kept.

Rows of a group (a language) are leaves in the order of their ids; eight consecutive nodes have one parent; the groups'
subroots are the leaves of one more tree, whose root stands for the table. Of all levels, the manifest keeps every third
one. A proof needs the levels between, too: they are made again from the kept nodes below, one aligned subtree of 512
nodes a row, and go once the siblings are taken from them. So what is stored is 1/512 of the leaves and less, and no
task ever holds more than a subtree and the path above it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Children of a node, and levels of which one is kept.
FAN, KEPT = 8, 3
SUBTREE = FAN**KEPT
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts behind each other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` if null, else its bytes in UTF-8, ``:`` and the value as text."""
    text = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a value named in a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined(nodes: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(nodes, start, length), "")


def _parents(nodes: Column, n: Column) -> Column:
    """The level above; the only node of a tree (n = 1) has none and stays."""
    up = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: F.sha2(_joined(nodes, i * FAN + 1, F.lit(FAN)).cast("binary"), 256))
    return F.when(n > 1, up).otherwise(nodes)


def _fewer(n: Column) -> Column:
    return F.when(n > 1, F.ceil(n / FAN)).otherwise(n).cast("long")


def _siblings(nodes: Column, i: Column) -> Column:
    """Of node ``i``: the run's nodes before it and those after it, each joined."""
    k = F.pmod(i, F.lit(FAN))
    return F.struct(_joined(nodes, i - k + 1, k).alias("before"), _joined(nodes, i + 2, FAN - 1 - k).alias("after"))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0. Rows are cut into ranges; only the ranges' sizes meet."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = stored(own.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))  # a row a task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select("_part", (before - F.col("_first")).alias("_offset"))
    return ranges.join(offset, "_part").withColumn(name, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")


@dataclass
class Manifest:
    """What is kept, a row for each aligned subtree (tree, n, block, nodes): ``leaves`` with the columns carried, every third level above
    them (the last has one node a tree, its subroot), ``groups`` (tree, label) and the same levels of the tree of subroots. ``root`` is
    null for an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    root: str | None


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """A stored row per aligned subtree of a level: its nodes in order, at most SUBTREE."""
    block = F.floor(F.col("pos") / SUBTREE).cast("long").alias("block")
    return stored(nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("pos", "h", *more))).alias("nodes")), "merkle")


def _kept_level(blocks: DataFrame) -> DataFrame:
    """Nodes of the next level that is kept; those between are not stored."""
    n = F.col("n")
    n1, n2 = _fewer(n), _fewer(_fewer(n))
    h = _let(F.transform("nodes", lambda x: x["h"]), lambda a: _let(_parents(a, n), lambda b: _let(_parents(b, n1), lambda c: _parents(c, n2))))
    return blocks.select("tree", F.col("block").alias("pos"), _fewer(n2).alias("_n"), F.get(h, F.lit(0)).alias("h")).withColumnRenamed("_n", "n")  # an alias "n" would be taken for n in the lambdas


def _raised(blocks: DataFrame, most: int) -> list[DataFrame]:
    """Kept levels above the given one, up to one node a tree."""
    out = []
    while most > 1:
        blocks = _blocks(_kept_level(blocks))
        out.append(blocks)
        most = -(-most // SUBTREE)
    return out


def build(rows: DataFrame, label: str, order: str, *carried: str) -> Manifest:
    """The manifest of ``rows``, which have the leaf digest ``h``, the group ``label`` and ``order`` within it, and columns to carry.

    Groups ascend by label, null first; leaves by ``order``, null first, rows of the same one by digest. Rows that are the same in
    both are leaves each. A hot group is cut into ranges like any other."""
    at = stored(rows.select(F.col(label).alias("label"), F.col(order).alias("ord"), "h", *carried).withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    placed = numbered(at, [F.col("label").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("h"), F.col("_tie")])
    groups = placed.groupBy("label").agg(F.min("place").alias("_start"), F.count("*").alias("n"))
    groups = stored(numbered(groups, [F.col("label").asc_nulls_first()], "tree"), "groups")
    g = groups.select(F.col("label").alias("_label"), "_start", "n", "tree")
    met = placed.join(g, F.col("label").eqNullSafe(F.col("_label")))
    leaves = _blocks(met.select("tree", (F.col("place") - F.col("_start")).alias("pos"), "n", "h", *carried), *carried)
    size = groups.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("n")).first()
    levels = _raised(leaves, size["most"])
    alone = F.get("nodes", F.lit(0))["h"]
    subroots = (levels[-1] if levels else leaves).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size["n"]).cast("long").alias("n"), alone.alias("h"))
    top = [_blocks(subroots)]
    top += _raised(top[0], size["n"])
    root = top[-1].select(alone.alias("h")).first()
    return Manifest(leaves, levels, groups.select("tree", "label"), top, root["h"] if root else None)


def _lowered_paths(blocks: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """Of each node of a kept level: ``path``, the siblings level by level up to the root, and the columns of ``above`` (tree, block, path, ...).

    The levels between are made again from the nodes of an aligned subtree."""
    n = F.col("n")
    n1, n2 = _fewer(n), _fewer(_fewer(n))

    def path(a: Column, b: Column, c: Column, i: Column) -> Column:
        own = F.array(*[F.when(k > 1, _siblings(x, F.floor(i / FAN**j).cast("int"))) for j, (x, k) in enumerate(((a, n), (b, n1), (c, n2)))])
        return F.filter(own, lambda s: s.isNotNull())

    paths = _let(
        F.transform("nodes", lambda x: x["h"]),
        lambda a: _let(_parents(a, n), lambda b: _let(_parents(b, n1), lambda c: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: path(a, b, c, i)))),
    )
    met = blocks.join(above.withColumnRenamed("path", "_above"), ["tree", "block"])
    rest = [c for c in above.columns if c not in ("tree", "block", "path")]
    each = met.select("tree", "_above", *rest, F.explode(F.arrays_zip("nodes", paths.alias("own"))).alias("z"))
    return each.select("tree", F.col("z.nodes.pos").alias("pos"), F.col("z.nodes.h").alias("h"), *[F.col(f"z.nodes.{c}").alias(c) for c in more], *rest, F.concat("z.own", "_above").alias("path"))


def _paths(kept: list[DataFrame], above: DataFrame, *more: str) -> DataFrame:
    """Paths of the nodes of the lowest of ``kept``, from those (tree, block, path) of the nodes above the highest."""
    for blocks in reversed(kept[1:]):
        own = _lowered_paths(blocks, above)
        above = own.select("tree", F.col("pos").alias("block"), "path", *[c for c in above.columns if c not in ("tree", "block", "path")])
    return _lowered_paths(kept[0], above, *more)


def proofs(manifest: Manifest, *carried: str) -> DataFrame:
    """tree, pos, h, ``carried``, subroot and path of every leaf; a path is an array of (before, after), the siblings of a level each side.

    Nothing but kept nodes is read; a level's paths meet the level below by subtree, 512 nodes a row."""
    spark = manifest.leaves.sparkSession
    kind = "array<struct<before:string,after:string>>"
    none = F.array().cast(kind)
    start = spark.range(1).select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("block"), none.alias("path"))
    # a node that is alone is its own top: a subtree of one row, whose path is empty
    top = _paths(manifest.top[:-1] or manifest.top, start)
    above = top.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("h").alias("subroot"))
    return _paths([manifest.leaves, *manifest.levels[:-1]], above, *carried)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_digest, lambda h, s: digest(s["before"], h, s["after"]))


def verified_rows(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 3 divides the id's CRC-32, the row that is verified has its text's A-Z in lower case; a text that this does not change
    verifies. A null id is not tampered with and comes first in its group, a null group first of all; null fields are ``-`` in the leaf,
    an empty text is ``0:``. Rows that repeat an id go by digest, rows the same in all fields are leaves each. Texts are hashed whole where
    they are and do not shuffle. An empty table gives no row; other columns are ignored, whatever their names.
    """
    given = {c: F.col(c) for c in fields}
    altered = given | {text_col: F.when(F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False)), lowered(F.col(text_col))).otherwise(F.col(text_col))}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("label"), leaf(*given.values()).alias("h"), leaf(*altered.values()).alias("altered"))
    manifest = build(rows.select("doc_id", "label", F.col("doc_id").alias("ord"), "h", "altered"), "label", "ord", "doc_id", "altered")
    root = F.lit(manifest.root).cast("string")
    again = folded(F.col("altered"), F.col("path"))
    out = proofs(manifest, "doc_id", "altered").select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))
