"""Registry tables as of now, upward walks over ownership links, and the choice of a company's root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.hotkeys import join_hot
from quillstone.operators.intervals import lei
from quillstone.session import Scratch

DIRECT, ULTIMATE = "IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY"
MAX_DEPTH = 12
PARTS = 32


def upsert_last(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key, the one delivered last. Aggregated before the exchange, so that a key delivered very often is no burden. Null keys are left out."""
    known = rows.dropna(subset=keys)
    last = known.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), position).alias("_row"))
    return last.select(*keys, "_row.*")


def entities(lei_entities: DataFrame) -> DataFrame:
    """(lei, legal_name, name, jurisdiction, entity_status): the last delivery of every LEI."""
    rows = lei_entities.select(lei("lei").alias("lei"), "record_id", F.trim("legal_name").alias("legal_name"), F.trim("legal_jurisdiction").alias("jurisdiction"), F.trim("entity_status").alias("entity_status"))
    return upsert_last(rows.where("lei <> ''"), ["lei"], "record_id").withColumn("name", T.fold_name(F.col("legal_name"))).drop("record_id")


def links(relationships: DataFrame, status: str | None = None) -> DataFrame:
    """(child, parent, direct, ultimate): one row a pair of the two consolidation types; with ``status`` only rows of that relationship_status."""
    if status:
        relationships = relationships.where(F.upper(F.trim("relationship_status")) == status)
    rows = relationships.where(F.trim("relationship_type").isin(DIRECT, ULTIMATE)).select(lei("child_lei").alias("child"), lei("parent_lei").alias("parent"), F.trim("relationship_type").alias("t"))
    return rows.where("child <> '' and parent <> ''").groupBy("child", "parent").agg(F.bool_or(F.col("t") == DIRECT).alias("direct"), F.bool_or(F.col("t") == ULTIMATE).alias("ultimate"))


def seeds(known: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, lei, legal_name, entity_status, likeness): names equal to the query, else names with it as a whole-word phrase.

    ``queries``: (query_id, query), folded. Blocked on the query's first word, which a matching name must have.
    """
    named = known.where("name is not null").select("lei", "legal_name", "entity_status", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    q = queries.where("query <> ''").withColumn("word", F.split("query", " ")[0])
    hits = named.join(q, "word").where(T.has_phrase(F.col("name"), F.col("query")))
    hits = hits.withColumn("exact", F.col("name") == F.col("query"))
    sure = hits.groupBy("query_id").agg(F.bool_or("exact").alias("any_exact"))  # joined back: a word of very many names is no single task's
    return hits.join(sure, "query_id").where("exact or not any_exact").select("query_id", "query", "lei", "legal_name", "entity_status", T.name_likeness(F.col("query"), F.col("name")).alias("likeness"))


def walk_upward(start: DataFrame, edges: DataFrame, scratch: Scratch, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(query_id, seed, node, depth, direct, ultimate, terminal) of everything reached from the seeds within ``max_depth`` links.

    ``start``: (query_id, seed). Every differing seed walks once, all together, one round a depth; a round keeps the nodes at that
    many links, each once a seed, and doesn't look back. The least depth of a node counts, so that a circle only goes on to the
    last round. ``terminal``: no parent is known.
    """
    asked = scratch.write(start.select("query_id", "seed").distinct())
    frontier = asked.select("seed", F.col("seed").alias("node")).distinct()
    rounds = frontier.withColumn("depth", F.lit(0))
    up = edges.select(F.col("child").alias("node"), "parent")
    for depth in range(1, max_depth + 1):
        frontier, (n,) = scratch.write_counting(frontier.join(up, "node").select("seed", F.col("parent").alias("node")).distinct(), F.count(F.lit(1)))
        if not n:
            break
        rounds = rounds.unionByName(frontier.withColumn("depth", F.lit(depth)))
    reached = scratch.write(rounds.groupBy("seed", "node").agg(F.min("depth").alias("depth")))
    all_seen = asked.join(reached, "seed")
    walked = all_seen.where(F.col("depth") < max_depth)
    flags = walked.select("query_id", "seed", F.col("node").alias("child")).join(edges, "child").groupBy("query_id", "seed", F.col("parent").alias("node")).agg(F.bool_or("direct").alias("direct"), F.bool_or("ultimate").alias("ultimate"))
    parents = edges.select(F.col("child").alias("node")).distinct().withColumn("has_parent", F.lit(True))
    out = all_seen.join(flags, ["query_id", "seed", "node"], "left").join(parents, "node", "left")
    no = F.lit(False)
    return out.select("query_id", "seed", "node", F.col("depth").cast("bigint"), F.coalesce("direct", no).alias("direct"), F.coalesce("ultimate", no).alias("ultimate"), (F.col("has_parent").isNull() & (F.col("depth") < max_depth)).alias("terminal"))


def root_scores(walks: DataFrame, known: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates for the root of every query with votes and a score, in which agreement of the graph counts most.

    Only seeds that lead anywhere vote.
    """
    informative = walks.where("node <> seed").select("query_id", "seed").distinct()
    total = informative.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    votes = walks.join(informative, ["query_id", "seed"]).groupBy("query_id", "node").agg(F.count(F.lit(1)).alias("matched"), F.count_if("direct").alias("direct_votes"), F.count_if("ultimate").alias("ultimate_votes"), F.count_if("terminal").alias("terminal_votes"), F.max("depth").alias("max_depth"))
    zero = F.lit(0).cast("bigint")
    rows = walks.select("query_id", "node").distinct().join(votes, ["query_id", "node"], "left").join(total, "query_id", "left").join(queries, "query_id").join(known.select(F.col("lei").alias("node"), "legal_name", "name", "entity_status"), "node", "left")
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("matched", "direct_votes", "ultimate_votes", "terminal_votes", "max_depth", "n_seeds")})
    rows = rows.withColumn("coverage", F.when(F.col("n_seeds") > 0, F.col("matched") / F.col("n_seeds")).otherwise(0.0)).withColumn("likeness", T.name_likeness(F.col("query"), F.col("name")))
    score = F.col("coverage") * 100 + F.col("ultimate_votes") * 8 + F.col("terminal_votes") * 5 + F.col("direct_votes") * 2 + F.least(F.col("max_depth"), F.lit(6)) * 1.5 + F.col("likeness") * 6 + F.when(F.col("entity_status") == "ACTIVE", 2.0).otherwise(0.0)
    return rows.select("query_id", F.col("node").alias("lei"), "legal_name", "entity_status", "matched", "n_seeds", "coverage", "direct_votes", "ultimate_votes", "terminal_votes", "max_depth", "likeness", score.alias("score"))


def decide_roots(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, lei, score, margin, status, confidence): the best candidate of each query, and whether it can stand by itself."""
    order = [F.desc("score"), F.desc("coverage"), F.desc("ultimate_votes"), F.desc("terminal_votes"), F.coalesce("legal_name", F.lit("")), F.col("lei")]
    part = [F.col("query_id"), F.pmod(F.xxhash64("lei"), F.lit(PARTS))]  # first within parts of a query's candidates, then among the best two of each
    few = scores.withColumns({"place": F.row_number().over(Window.partitionBy(*part).orderBy(*order)), "n": F.count(F.lit(1)).over(Window.partitionBy(*part))}).where("place <= 2")
    few = few.withColumn("n", F.sum(F.when(F.col("place") == 1, F.col("n")).otherwise(0)).over(Window.partitionBy("query_id")))
    rank = Window.partitionBy("query_id").orderBy(*order)
    ranked = few.withColumns({"place": F.row_number().over(rank), "second": F.lead("score").over(rank)}).where("place = 1")
    exact = found.where("likeness = 1.0 and entity_status = 'ACTIVE'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.min("lei").alias("exact_lei"))
    top = ranked.join(exact, "query_id", "left").withColumn("margin", F.col("score") - F.coalesce("second", F.lit(0.0)))
    strong = (F.col("matched") >= 2) & (F.col("coverage") >= 0.6) & ((F.col("ultimate_votes") >= 1) | (F.col("terminal_votes") >= 2)) & (F.col("margin") >= 8)
    single = (F.col("n_exact") == 1) & (F.col("lei") == F.col("exact_lei")) & (F.col("second").isNull() | (F.col("margin") >= 8))
    alone = (F.col("n") == 1) & (F.col("likeness") >= 0.9) & (F.col("entity_status") == "ACTIVE")
    by_itself = F.coalesce(strong, F.lit(False)) | F.coalesce(single, F.lit(False)) | F.coalesce(alone, F.lit(False))
    confidence = F.when(F.coalesce(strong, F.lit(False)), "HIGH").when(by_itself | (F.col("coverage") >= 0.5), "MEDIUM").otherwise("LOW")
    return top.select("query_id", "lei", "score", "margin", F.when(by_itself, "AUTO_RESOLVED").otherwise("REVIEW_REQUIRED").alias("status"), confidence.alias("confidence"))


def touching(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Links with a root at either end, as the union of two equi-joins; an OR condition would plan as a nested loop. ``roots``: (root).

    The links are written once, as they are read and counted more than once.
    """
    edges, (n,) = Scratch(edges.sparkSession).write_counting(edges, F.count(F.lit(1)))
    as_child = edges.join(roots.withColumnRenamed("root", "child"), "child").select(F.col("child").alias("root"), "child", "parent", "direct", "ultimate")
    as_parent = join_hot(edges, roots.withColumnRenamed("root", "parent"), "parent", rows=n).select(F.col("parent").alias("root"), "child", "parent", "direct", "ultimate")
    return as_child.unionByName(as_parent).distinct()


def relation(root: Column, child: Column, direct: Column, ultimate: Column) -> Column:
    """How the other end relates to the root: PARENT or CHILD, direct, ultimate or both."""
    side = F.when(child == root, "PARENT").otherwise("CHILD")
    grade = F.when(direct & ultimate, "DIRECT_AND_ULTIMATE").when(direct, "DIRECT").otherwise("ULTIMATE")
    return F.concat(grade, F.lit("_"), side)


def expand(edges: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """(root, lei, name, relations, enrichment): one row for every entity linked to a root; an unknown one keeps its LEI as name."""
    near = touching(edges, roots).select("root", F.when(F.col("child") == F.col("root"), F.col("parent")).otherwise(F.col("child")).alias("lei"), relation(F.col("root"), F.col("child"), F.col("direct"), F.col("ultimate")).alias("r"))
    rows = near.groupBy("root", "lei").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("relations"))
    out = rows.join(known.select("lei", "legal_name"), "lei", "left")
    return out.select("root", "lei", F.coalesce("legal_name", "lei").alias("name"), "relations", F.when(F.col("legal_name").isNotNull(), "RESOLVED").otherwise("UNRESOLVED_LEVEL1").alias("enrichment"))


def compare_snapshots(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value_before, value_after, movement): ADDED, REMOVED, CHANGED or SAME by full outer join; one row a key on either side."""
    a, b = before.select(key, F.col(value).alias("value_before"), F.lit(True).alias("_a")), after.select(key, F.col(value).alias("value_after"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    movement = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("value_before").eqNullSafe(F.col("value_after")), "SAME").otherwise("CHANGED")
    return both.select(key, "value_before", "value_after", movement.alias("movement"))


def top_names(found: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, lei, place): of each query's names the first ``most``, active ones before others, then by name and LEI. Parts of a query are cut first, as each can hold all of the first."""
    order = [F.when(F.col("entity_status") == "ACTIVE", 0).otherwise(1), F.coalesce("legal_name", F.lit("")), F.col("lei")]
    return _first_places(found, order, most).select("query_id", "lei", "place")


def top_candidates(scores: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, lei, score, place): of each query's candidates for the root the best ``most``."""
    order = [F.desc("score"), F.desc("coverage"), F.desc("ultimate_votes"), F.desc("terminal_votes"), F.coalesce("legal_name", F.lit("")), F.col("lei")]
    return _first_places(scores, order, most).select("query_id", "lei", "score", "place")


def _first_places(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    part = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", F.pmod(F.xxhash64("lei"), F.lit(PARTS))).orderBy(*order))).where(F.col("place") <= most)
    return part.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)


def named_ends(edges: DataFrame, known: DataFrame, overrides: DataFrame) -> DataFrame:
    """(child, parent, child_name, parent_name, child_source, parent_source): a name given by hand counts before the registry's, and that before the LEI itself.

    ``overrides``: (lei, name); of several names for one LEI the smallest counts.
    """
    given = overrides.where("lei is not null and name is not null").groupBy("lei").agg(F.min("name").alias("given"))
    both = known.select("lei", "legal_name").join(given, "lei", "full_outer")
    out = edges
    for end in ("child", "parent"):
        side = both.select(F.col("lei").alias(end), F.col("legal_name").alias(f"_{end}n"), F.col("given").alias(f"_{end}g"))
        out = join_hot(out, side, end, "left") if end == "parent" else out.join(side, end, "left")
    name = lambda e: F.coalesce(f"_{e}g", f"_{e}n", e).alias(f"{e}_name")
    source = lambda e: F.when(F.col(f"_{e}g").isNotNull(), "OVERRIDE").when(F.col(f"_{e}n").isNotNull(), "INDEX").otherwise("UNRESOLVED").alias(f"{e}_source")
    return out.select("child", "parent", name("child"), name("parent"), source("child"), source("parent"))
