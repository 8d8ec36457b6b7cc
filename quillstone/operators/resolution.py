"""Provider results put together: links in one direction, records of one entity merged, packets of evidence for a pair, and seeds for what comes next.

Records: (pos, node_id, name, name_normalized, jurisdiction, aliases array, provider_id, is_root). ``pos`` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.hotkeys import join_hot
from quillstone.session import Scratch

# Links from a child to its parent; standing of a name, the worst last
PARENT_LINKS = ("SUBSIDIARY_OF", "IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY")
STANDING = ("RESOLVED", "UNRESOLVED_TERMINAL", "UNRESOLVED_RETRY")


def ids(name: Column, place: Column) -> dict[str, Column]:
    """Identifiers that rest on a normalized name and place: of a node and of an alias."""
    return {"node_id": T.stable_id("node", name, place), "alias_id": T.stable_id("alias", name, place)}


def canonical_links(links: DataFrame) -> DataFrame:
    """``links`` (subject, predicate, object, ..) from child to parent: a parent's statement about its subsidiary is turned round, one about itself left out."""
    flip = F.col("predicate") == "HAS_SUBSIDIARY"
    kept = links.where(~F.col("predicate").eqNullSafe(F.lit("SELF_OR_ULTIMATE_PARENT")))
    other = [c for c in links.columns if c not in ("subject", "predicate", "object")]
    return kept.select(F.when(flip, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.when(flip, "SUBSIDIARY_OF").otherwise(F.col("predicate")).alias("predicate"), F.when(flip, F.col("subject")).otherwise(F.col("object")).alias("object"), *other)


def _agree(records: DataFrame) -> DataFrame:
    """(pos, key, as_name): keys under which records may be one. The place is part of the key, and none is a place of its own."""
    key = lambda n: F.xxhash64(F.coalesce(n, F.lit("")), F.coalesce("jurisdiction", F.lit("")), F.col("jurisdiction").isNull())
    named = records.select("pos", key(F.col("name_normalized")).alias("key"), F.lit(True).alias("as_name"))
    return named.unionByName(records.select("pos", "jurisdiction", F.explode("aliases").alias("a")).where("a <> ''").select("pos", key(F.col("a")).alias("key"), F.lit(False).alias("as_name"))).distinct()


def merge_records(records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(pos, into, reason): the first record that each one is merged into, itself where none comes before.

    Two records are one by equal normalized name and jurisdiction, none being equal to none; or where a former name of one is the
    name of the other in the same jurisdiction, which two former names alone don't make them. What follows from several merges
    holds too. The smallest position goes along keys round by round until nothing changes; a key aggregates before it is exchanged.
    """
    scratch = scratch or Scratch(records.sparkSession)
    keys = scratch.write(_agree(records))
    live = scratch.write(keys.join(keys.where("as_name").select("key").distinct(), "key", "left_semi"))
    label = scratch.write(records.select("pos", F.col("pos").alias("into")).distinct())
    while True:
        told = live.join(label, "pos")
        # a key's names are one; its aliases follow a name, and a name follows its aliases
        least = told.groupBy("key").agg(F.min("into").alias("least"))
        better = join_hot(live, least, "key").groupBy("pos").agg(F.min("least").alias("least"))
        after, (n,) = scratch.write_counting(label.join(better, "pos", "left").select("pos", F.least("into", "least").alias("into"), (F.coalesce("least", "into") < F.col("into")).alias("moved")), F.count_if("moved"))
        scratch.drop(label)
        label = after.drop("moved")
        if not n:
            break
    same = records.select("pos", "name_normalized", "jurisdiction").join(label, "pos").join(records.select(F.col("pos").alias("into"), F.col("name_normalized").alias("n2"), F.col("jurisdiction").alias("j2")), "into")
    exact = F.col("name_normalized").eqNullSafe(F.col("n2")) & F.col("jurisdiction").eqNullSafe(F.col("j2"))
    return same.select("pos", "into", F.when(F.col("pos") == F.col("into"), F.lit(None).cast("string")).when(exact, "exact_identity").otherwise("former_name_same_jurisdiction").alias("reason"))


def resolved_nodes(records: DataFrame, merged: DataFrame) -> DataFrame:
    """One row an entity, with the first record's id and name, all providers' ids and former names, whether any is a root, and the number of records."""
    both = records.join(merged, "pos")
    first = lambda c: F.min_by(c, "pos").alias(c)
    return both.groupBy("into").agg(first("node_id"), first("name"), first("name_normalized"), first("jurisdiction"), F.array_sort(F.collect_set("provider_id")).alias("provider_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.bool_or("is_root").alias("is_root"), F.count(F.lit(1)).alias("n_records"))


def review_candidates(nodes: DataFrame) -> DataFrame:
    """(base_name, class_id, node_id, n): entities whose names agree but for legal forms, for review and never merged: each with its class, not pair by pair."""
    based = nodes.withColumn("base_name", T.strip_suffixes(F.col("name_normalized"))).where("base_name is not null")
    classes = based.groupBy("base_name").agg(F.min("node_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return based.join(classes, "base_name").select("base_name", "class_id", "node_id", "n")


def resolve(records: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """(entities, links between them, candidates for review, counts) of all providers' records and links (subject, predicate, object by node_id)."""
    scratch = Scratch(records.sparkSession)
    merged = scratch.write(merge_records(records, scratch))
    nodes = scratch.write(resolved_nodes(records, merged))
    final = scratch.write(records.select("pos", "node_id").join(merged, "pos").join(nodes.select("into", F.col("node_id").alias("final")), "into").groupBy("node_id").agg(F.min("final").alias("final")))
    edges = canonical_links(links)
    for end in ("subject", "object"):
        edges = join_hot(edges, final.withColumnRenamed("node_id", end).withColumnRenamed("final", f"_{end}"), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    edges = scratch.write(edges)
    review = review_candidates(nodes)
    counts = {"nodes": nodes.count(), "links": edges.count(), "merged": merged.where("reason is not null").count(), "review": review.count()}
    return nodes, edges, review, counts


def graph_context(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (packet_id, left_id, right_id) with shared_parents, same_source, both_have_parents: what the graph says of the two ends.

    ``edges``: (subject, predicate, object, source). A node with very many parents is aggregated into a set once.
    """
    up = edges.where(F.col("predicate").isin(*PARENT_LINKS)).groupBy("subject").agg(F.collect_set("object").alias("parents"), F.collect_set("source").alias("sources"))
    side = lambda n: up.select(F.col("subject").alias(f"{n}_id"), F.col("parents").alias(f"{n}_parents"), F.col("sources").alias(f"{n}_sources"))
    both = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    none = F.array().cast("array<string>")
    x = lambda c: F.coalesce(c, none)
    shared, sources = F.array_sort(F.array_intersect(x("left_parents"), x("right_parents"))), F.array_intersect(x("left_sources"), x("right_sources"))
    return both.select(*pairs.columns, shared.alias("shared_parents"), (F.size(sources) > 0).alias("same_source"), ((F.size(x("left_parents")) > 0) & (F.size(x("right_parents")) > 0)).alias("both_have_parents"))


def packets(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One packet a pair: both ends, what the graph says of them, and evidence with ids of its own, each once.

    ``pairs``: (policy, left_id, right_id, decision, reason); ``nodes``: (node_id, name, jurisdiction). An id rests on the content,
    so that the same packet built twice is the same.
    """
    keyed = pairs.withColumn("packet_id", T.stable_id("pkt", F.col("policy"), F.col("left_id"), F.col("right_id"), F.col("decision"), F.col("reason")))
    ctx = graph_context(keyed, edges)
    node = F.struct("node_id", "name", "jurisdiction")
    for side in ("left", "right"):
        ctx = ctx.join(nodes.select(F.col("node_id").alias(f"{side}_id"), node.alias(side)), f"{side}_id", "left")
    touch = edges.select(F.explode(F.array("subject", "object")).alias("end"), F.to_json(F.struct(*(F.col(c) for c in sorted(edges.columns)))).alias("payload")).distinct()
    ends = keyed.select("packet_id", F.explode(F.array("left_id", "right_id")).alias("end"))
    links = ends.join(touch, "end").select("packet_id", F.lit("graph_relationship").alias("kind"), "payload")
    own = ends.join(nodes.select(F.col("node_id").alias("end"), F.to_json(node).alias("payload")), "end").select("packet_id", F.lit("source_entity").alias("kind"), "payload")
    evidence = links.unionByName(own).distinct().withColumn("evidence_id", T.stable_id("ev", F.col("kind"), F.col("payload")))
    gathered = evidence.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "kind", "payload"))).alias("evidence"))
    return ctx.join(gathered, "packet_id", "left").select("packet_id", "policy", "decision", "reason", "left", "right", "shared_parents", "same_source", "both_have_parents", F.coalesce("evidence", F.array().cast("array<struct<evidence_id:string,kind:string,payload:string>>")).alias("evidence"))


def standing(known: Column, retry: Column) -> Column:
    """RESOLVED where the registry knows the identifier, else whether asking again may help."""
    return F.when(known, "RESOLVED").when(F.coalesce(retry, F.lit(True)), "UNRESOLVED_RETRY").otherwise("UNRESOLVED_TERMINAL")


def seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, name, jurisdiction, providers, worst, disposition, n_links): entities next to a root, for discovery.

    ``edges``: (subject, predicate, object, provider, subject_standing, object_standing). The worst standing on any link counts;
    a seed that the registry confirms on one and nothing leaves open is safe with context, all others are for review.
    """
    links = edges.where(F.col("predicate").isin(*PARENT_LINKS))
    roots = nodes.where("is_root").select("node_id")
    near = lambda own, other: links.join(roots.withColumnRenamed("node_id", other), other, "left_semi").select(F.col(own).alias("node_id"), "provider", F.col(f"{own}_standing").alias("standing"))
    rows = near("subject", "object").unionByName(near("object", "subject")).join(roots, "node_id", "left_anti")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STANDING)), F.col("standing")), F.lit(0))
    sure = (F.lower("provider") == "gleif") & (F.col("standing").isNull() | (F.col("standing") == "RESOLVED"))
    per = rows.groupBy("node_id").agg(F.array_sort(F.collect_set("provider")).alias("providers"), F.max(rank).cast("int").alias("worst"), F.bool_or(F.coalesce(sure, F.lit(False))).alias("sure"), F.count(F.lit(1)).alias("n_links"))
    named = F.when(F.col("worst") > 0, F.element_at(F.array(*map(F.lit, STANDING)), F.greatest(F.col("worst"), F.lit(1))))
    return per.join(nodes.select("node_id", "name", "jurisdiction"), "node_id").select("node_id", "name", "jurisdiction", "providers", named.alias("worst"), F.when(F.col("sure") & (F.col("worst") <= 1), "SAFE_WITH_CONTEXT").otherwise("REVIEW_REQUIRED").alias("disposition"), "n_links")


def only_match(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the only known row with their key; a key unknown or with several rows raises when the result is read."""
    per = known.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value))
    both = rows.join(per, key, "left")
    why = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("unknown: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("ambiguous: "), F.col(key).cast("string"))))
    return both.select(*rows.columns, F.coalesce(why.cast(known.schema[value].dataType), F.col(value)).alias(value))


def registrable(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, domain, suffix) by a table of public suffixes (suffix): the longest that ends a host, its label before it included.

    ``*.x`` stands for any one label before x, ``!a.x`` takes a.x out of it. A host without a known suffix counts its last label
    as one; a host that is a suffix itself is its own domain. Private suffixes are rows like all others.
    """
    labels = F.split("host", r"\.")
    tails = hosts.where("host is not null").distinct().select("host", F.size(labels).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("tail")))).alias("t")).select("host", "n", "t.*")
    rules = suffixes.select(F.lower(F.trim("suffix")).alias("rule")).where("rule <> ''").distinct()
    wild = F.concat(F.lit("*."), F.regexp_replace("tail", r"^[^.]+\.", ""))
    asked = tails.select("host", "n", F.explode(F.array(F.struct(F.col("tail").alias("rule"), F.col("k")), F.struct(F.when(F.contains("tail", F.lit(".")), wild).alias("rule"), F.col("k")), F.struct(F.concat(F.lit("!"), "tail").alias("rule"), (F.col("k") - 1).alias("k")))).alias("x")).select("host", "n", "x.*")
    best = asked.join(rules, "rule").groupBy("host").agg(F.max(F.when(F.startswith("rule", F.lit("!")), F.col("k"))).alias("out"), F.max("k").alias("k"))
    length = F.coalesce("out", "k", F.lit(1))
    parts = hosts.where("host is not null").distinct().join(best, "host", "left").withColumn("k", length).withColumn("l", labels)
    tail = lambda n: F.array_join(F.slice("l", F.greatest(F.size("l") - n + 1, F.lit(1)), n), ".")
    return parts.select("host", tail(F.col("k") + 1).alias("domain"), tail(F.col("k")).alias("suffix"))
