"""Trees of unknown depth from parent links: cycle separation, heavy paths, paths, depths, roots, descendants.

1. ``_separate`` follows all parents at once by pointer doubling, so that links as deep as 2^k take k rounds. What
   reaches a root is a tree node; the rest runs in circles. The same rounds add up subtree sizes: a node collects the
   sizes of those whose pointer, 2^k links up, is the node itself.
2. Every node's heaviest child goes on its chain. Doubling along chains gives each node its chain's head and its
   position. A path crosses at most log2(n) chains, so that the tree of chains is shallow.
3. Depth, root, path and the interval of descendants of a node come from its chain's and its position.

A parent may have a third of all children: sizes and heaviest children are aggregated before the exchange, joins on
parents and chains go through ``join_hot``, positions among siblings through a range-partitioned prefix sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.hotkeys import join_hot, prefix_sum
from quillstone.operators.intervals import lei
from quillstone.session import Scratch


@dataclass
class Forest:
    """``nodes``: (id, parent, size, head, pos) of tree nodes. ``chains``: (head, root, head_depth, up_head, up_pos). ``circular``: (id, node_state)."""

    nodes: DataFrame
    chains: DataFrame
    circular: DataFrame
    scratch: Scratch
    rows: int


def _separate(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, parent, size) of tree nodes, and (id, ptr) of the others with a far ancestor each."""
    children = links.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    roots = links.select(F.col("parent").alias("id")).distinct().join(children.select("id"), "id", "left_anti")
    base = scratch.write(children.unionByName(roots.withColumn("parent", F.lit(None).cast("string"))))
    state, (open_rows,) = scratch.write_counting(base.select("id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("size")), F.count("ptr"))
    while open_rows:
        going = state.where("ptr is not null")
        gained = going.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("gain"))
        up = join_hot(going.select("id", "ptr"), state.select(F.col("id").alias("ptr"), F.col("ptr").alias("far")), "ptr", rows=open_rows).select("id", "far")
        step = state.join(up, "id", "left").join(gained, "id", "left").select("id", F.col("far").alias("ptr"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        after, (left,) = scratch.write_counting(step, F.count("ptr"))
        scratch.drop(state)
        state, done = after, left == open_rows
        open_rows = left
        if done:
            break  # a depth that no node has is followed by none deeper: what is left never ends
    finished = state.where("ptr is null").select("id", "size").join(base, "id")
    return finished, state.where("ptr is not null").select("id", "ptr")


def _circles(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, node_state): what is left of doubling once the images stop shrinking is on a cycle."""
    state, (rows,) = scratch.write_counting(rest, F.count(F.lit(1)))
    n, before = (state.select("ptr").distinct().count(), -1) if rows else (0, 0)
    while n != before:
        after = scratch.write(join_hot(state, state.select(F.col("id").alias("ptr"), F.col("ptr").alias("far")), "ptr", rows=rows).select("id", F.col("far").alias("ptr")))
        scratch.drop(state)
        state, before = after, n
        n = state.select("ptr").distinct().count()
    on = state.select(F.col("ptr").alias("id")).distinct().withColumn("on", F.lit(True))
    return state.select("id").join(on, "id", "left").select("id", F.when(F.col("on"), "CYCLE").otherwise("UNDER_CYCLE").alias("node_state"))


def _double(table: DataFrame, key: str, ptr: str, sums: str, top: str, scratch: Scratch, rows: int) -> DataFrame:
    """Pointers followed to their end: ``top`` the last key, ``sums`` added along the way. ``table``: (key, ptr, sums, top)."""
    state, (going,) = scratch.write_counting(table, F.count(ptr))
    while going:
        far = state.select(F.col(key).alias(ptr), F.col(ptr).alias("_ptr"), F.col(sums).alias("_sum"), F.col(top).alias("_top"))
        moved = join_hot(state.where(F.col(ptr).isNotNull()), far, ptr, rows=going).select(key, F.col("_ptr").alias(ptr), (F.col(sums) + F.col("_sum")).alias(sums), F.col("_top").alias(top))
        after, (going,) = scratch.write_counting(state.where(F.col(ptr).isNull()).select(key, ptr, sums, top).unionByName(moved), F.count(ptr))
        scratch.drop(state)
        state = after
    return state.drop(ptr)


def forest(links: DataFrame, scratch: Scratch | None = None) -> Forest:
    """The forest of ``links`` (child, parent: string).

    Rows with a null or blank end are left out, repeated links count once. Of several parents of one child the smallest
    is followed. A link of a node to itself is a cycle. No rows give an empty forest.
    """
    scratch = scratch or Scratch(links.sparkSession)
    links = scratch.write(links.select("child", "parent").where("trim(child) <> '' and trim(parent) <> ''").distinct())
    tree, rest = _separate(links, scratch)
    tree, (rows,) = scratch.write_counting(tree, F.count(F.lit(1)))
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max_by("id", F.struct("size", "id")).alias("id")).select("id", F.lit(True).alias("heavy"))
    nodes = scratch.write(tree.join(heavy, "id", "left"))
    along = _double(nodes.select("id", F.when(F.col("heavy"), F.col("parent")).alias("ptr"), F.when(F.col("heavy"), 1).otherwise(0).cast("bigint").alias("pos"), F.when(F.col("heavy").isNull(), F.col("id")).alias("head")), "id", "ptr", "pos", "head", scratch, rows)
    placed = scratch.write(nodes.drop("heavy").join(along, "id"))
    heads = placed.where("id = head").select("head", F.col("parent"))
    above = placed.select(F.col("id").alias("parent"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"))
    chain = scratch.write(join_hot(heads.where("parent is not null"), above, "parent").select("head", "up_head", "up_pos").unionByName(heads.where("parent is null").select("head", F.lit(None).cast("string").alias("up_head"), F.lit(None).cast("bigint").alias("up_pos"))))
    deep = _double(chain.select("head", F.col("up_head").alias("ptr"), F.coalesce(F.col("up_pos") + 1, F.lit(0)).alias("head_depth"), F.when(F.col("up_head").isNull(), F.col("head")).alias("root")), "head", "ptr", "head_depth", "root", scratch, rows)
    chains = scratch.write(chain.join(deep, "head"))
    return Forest(placed, chains, _circles(rest, scratch), scratch, rows)


def node_table(f: Forest) -> DataFrame:
    """``(id, node_state, root, depth)`` of every node: TREE with root and depth, CYCLE and UNDER_CYCLE with '' and -1."""
    tree = join_hot(f.nodes.select("id", "head", "pos"), f.chains.select("head", "root", "head_depth"), "head", rows=f.rows)
    tree = tree.select("id", F.lit("TREE").alias("node_state"), "root", (F.col("head_depth") + F.col("pos")).alias("depth"))
    return tree.unionByName(f.circular.select("id", "node_state", F.lit("").alias("root"), F.lit(-1).cast("bigint").alias("depth")))


def paths(f: Forest) -> DataFrame:
    """``(id, path array<string>, depth)`` of tree nodes, from the root to the node, by joining pieces of chains.

    A chain's members are gathered in order, as long as a path of the tree; a path itself can't be shorter than that.
    """
    members = f.nodes.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("members"))
    todo = f.scratch.write(f.chains.select("head", "up_head", "up_pos").join(members, "head"))
    done = f.scratch.write(todo.where("up_head is null").select("head", "members", F.array().cast("array<string>").alias("before")))
    level = done
    while not level.isEmpty():
        up = level.select(F.col("head").alias("up_head"), F.col("members").alias("up_members"), F.col("before").alias("up_before"))
        # the few chains above are joined to the many below: a chain with many side chains is the hot key here
        level = f.scratch.write(join_hot(todo.where("up_head is not null"), up, "up_head").select("head", "members", F.concat("up_before", F.expr("slice(up_members, 1, int(up_pos) + 1)")).alias("before")))
        done = done.unionByName(level)
    out = join_hot(f.nodes.select("id", "head", "pos"), done, "head", rows=f.rows)
    return out.select("id", F.concat("before", F.expr("slice(members, 1, int(pos) + 1)")).alias("path")).withColumn("depth", (F.size("path") - 1).cast("bigint"))


def descendant_intervals(f: Forest) -> DataFrame:
    """``(id, root, entry, last_entry, n_descendants)``: the descendants of a node are the nodes with entry in (entry, last_entry].

    Entries number each tree from 0 with the heavy child first, so that a chain is one run of numbers. The offset of a
    side chain is one more than the heavy child's size and the sizes of the smaller-named side children before it.
    """
    n, scratch = f.nodes, f.scratch
    kids = n.where("parent is not null")
    light = prefix_sum(kids.where("id = head").select("id", "parent", "size"), ["parent", "id"], F.col("size"), "before_all", scratch)
    start = light.groupBy("parent").agg(F.min("before_all").alias("first"))
    heavy = kids.where("id <> head").select("parent", F.col("size").alias("heavy_size"))
    offsets = join_hot(light, start.join(heavy, "parent", "left"), "parent").select(F.col("id").alias("head"), (1 + F.coalesce("heavy_size", F.lit(0)) + F.col("before_all") - F.col("first")).alias("after_parent"))
    chain = f.chains.join(offsets, "head", "left").select("head", F.col("up_head").alias("ptr"), F.coalesce(F.col("up_pos") + F.col("after_parent"), F.lit(0)).alias("entry"), F.when(F.col("up_head").isNull(), F.col("head")).alias("root"))
    entry = _double(chain, "head", "ptr", "entry", "root", scratch, f.rows)
    out = join_hot(n.select("id", "head", "pos", "size"), entry.withColumnRenamed("entry", "head_entry"), "head", rows=f.rows)
    at = F.col("head_entry") + F.col("pos")
    return out.select("id", "root", at.alias("entry"), (at + F.col("size") - 1).alias("last_entry"), (F.col("size") - 1).alias("n_descendants"))


def consolidation_links(relationships: DataFrame) -> DataFrame:
    """(child, parent) of active direct consolidation, whatever the dates."""
    rows = relationships.where((F.trim("relationship_type") == "IS_DIRECTLY_CONSOLIDATED_BY") & (F.upper(F.trim("relationship_status")) == "ACTIVE"))
    return rows.select(lei("child_lei").alias("child"), lei("parent_lei").alias("parent"))


def found_nodes(relationships: DataFrame) -> DataFrame:
    """``(lei, node_state, root_lei, depth)`` of all LEIs on either side of a link."""
    out = node_table(forest(consolidation_links(relationships)))
    return out.select(F.col("id").alias("lei"), "node_state", F.col("root").alias("root_lei"), "depth")
