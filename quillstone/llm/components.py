"""One group identifier for everything linked directly or through others, by low-diameter decomposition.

Every vertex draws an exponentially distributed shift from a hash of its id, so that a lost task draws the same again.
A vertex joins the cluster whose centre reaches it first when centres start at their shifted times: the least of
distance minus shift, found by a few rounds of passing labels along the links. Clusters become the vertices of
the next level, links between clusters its links, until no link is left. Long chains shrink by a factor at every level, stars
at once. A label always comes from the same component, so that cutting a round short costs another
level, never a link. The assignments of the levels are composed from the last to the first.

Nodes pass through all levels as numbers of eight bytes, checked to be one a node, and get their names back at the end.

A vertex may have a third of all links: labels of such vertices are joined apart (``join_hot``), what arrives at them
is aggregated before the exchange. Links are never brought to the driver; it sees row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.hotkeys import hot_keys, join_hot
from quillstone.session import Scratch

RATE = 0.4  # of the exponential shifts: smaller clusters and more levels with a higher rate
ROUNDS = 3  # of label passing in a level
SEEDS = 3  # tried for numbers that tell all nodes apart


def _shift(vertex: str, level: int):
    u = (F.pmod(F.xxhash64(F.col(vertex), F.lit(level)), F.lit(2**40)) + F.lit(0.5)) / F.lit(float(2**40))
    return -F.log(u) / F.lit(RATE)


def _label(cost, centre: str):
    return F.struct(cost.alias("cost"), F.col(centre).alias("centre"))


def _clusters(links: DataFrame, level: int, rows: int) -> DataFrame:
    """(v, label) of all ends of ``links`` (a, b).

    A round names the labels of the one before once (twice at a level with hot vertices): plans that double with every
    round took the driver's memory.
    """
    two = lambda a, b, *names: F.inline(F.array(*(F.struct(*(c.alias(n) for c, n in zip(x, names, strict=True))) for x in (a, b))))
    both = links.select(two((F.col("a"), F.col("b")), (F.col("b"), F.col("a")), "v", "to"))
    hot = hot_keys(both, "v", 2 * rows)
    both = both if hot else both.repartition("v")  # one exchange for all rounds
    labels = both.groupBy("v").agg(F.min(_label(1 - _shift("to", level), "to")).alias("l")).select("v", F.least("l", _label(-_shift("v", level), "v")).alias("l"))
    for _ in range(ROUNDS - 1):
        kept, sent = (F.col("v"), F.col("l")), (F.col("to"), _label(F.col("l.cost") + 1, "l.centre"))
        labels = join_hot(both, labels, "v", hot=hot).select(two(kept, sent, "v", "l")).groupBy("v").agg(F.min("l").alias("l"))
    return labels.select("v", F.col("l.centre").alias("label"))


def _number(node: str, seed: int):
    return F.xxhash64(F.col(node), F.lit(seed))


def _numbered(ends: DataFrame, scratch: Scratch):
    """A table of v and name of all nodes of ``ends`` (a, b), and the function from a column of nodes to their v.

    v is a hash of the node of which it is known that no other node has it: if two share one, another seed is taken. Where
    none of ``SEEDS`` tells all nodes apart (many billions of them), v is the node itself.
    """
    nodes = ends.select(F.explode(F.array("a", "b")).alias("name"))
    for seed in range(SEEDS):
        names = nodes.groupBy(_number("name", seed).alias("v")).agg(F.min("name").alias("name"), F.max("name").alias("other"))
        written, (shared,) = scratch.write_counting(names.select("v", "name", (F.col("name") != F.col("other")).alias("shared")), F.count_if("shared"))
        if not shared:
            return written, lambda c: _number(c, seed)
        scratch.drop(written)
    return scratch.write(nodes.distinct().select(F.col("name").alias("v"), "name")), F.col


def connected_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node string, group string)``: every node with at least one link to another node; group is the smallest node of its component.

    Links have no direction; repeated ones count once. Rows with a null end and links of a node to itself link nothing.
    No rows give no groups. Other columns play no part. ``links`` is read twice.
    """
    scratch = Scratch(links.sparkSession)
    ends = links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a <> b")
    names, number = _numbered(ends, scratch)
    pairs = ends.select(number("a").alias("a"), number("b").alias("b"))
    level_links, (rows,) = scratch.write_counting(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), F.count(F.lit(1)))
    assignments: list[tuple[DataFrame, int]] = []
    while rows:
        mapped, (vertices,) = scratch.write_counting(_clusters(level_links, len(assignments), rows), F.count(F.lit(1)))
        assignments.append((mapped, vertices))
        left = join_hot(level_links, mapped.select(F.col("v").alias("a"), F.col("label").alias("la")), "a", rows=rows)
        joined = join_hot(left, mapped.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b", rows=rows).where("la <> lb")
        after, (rows,) = scratch.write_counting(joined.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), F.count(F.lit(1)))
        scratch.drop(level_links)
        level_links = after
    scratch.drop(level_links)
    if not assignments:
        return names.select(F.col("name").alias("node"), F.col("name").alias("group"))
    top = assignments[-1][0]
    for mapped, vertices in reversed(assignments[:-1]):
        whole = scratch.write(join_hot(mapped, top.select(F.col("v").alias("label"), F.col("label").alias("last")), "label", "left", rows=vertices).select("v", F.coalesce("last", "label").alias("label")))
        scratch.drop(mapped, top)
        top = whole
    named = scratch.write(top.join(names, "v").select("label", "name"))
    scratch.drop(top, names)
    groups = named.groupBy("label").agg(F.min("name").alias("group"))
    return join_hot(named, groups, "label", rows=assignments[0][1]).select(F.col("name").alias("node"), "group")


def accepted_links(packets: DataFrame) -> DataFrame:
    """(a, b) of accepted packets, ids trimmed and lower case."""
    accepted = packets.where(F.upper(F.trim("deterministic_evaluation.decision")) == "ACCEPT")
    node = lambda c: F.nullif(F.lower(F.trim(f"{c}.node_id")), F.lit(""))
    return accepted.select(node("candidate_a").alias("a"), node("candidate_b").alias("b"))


def found_groups(packets: DataFrame) -> DataFrame:
    """``(node_id, group_id)`` of all nodes of groups of two or more."""
    return connected_groups(accepted_links(packets), "a", "b").select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))
