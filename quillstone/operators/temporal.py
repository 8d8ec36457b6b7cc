"""A graph of entities over time from canonical events, and questions as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import stable_id

PARTIES = ("acquirer", "target", "subject", "object_entity", "result_entity")


def mentions(events: DataFrame) -> DataFrame:
    """(name, day, event_id, place, role) of every party. ``events``: (event_id, event_type, day string, the five parties)."""
    parties = F.explode(F.array(*(F.struct(F.col(p).alias("name"), F.lit(i).alias("place"), F.lit("COMPANY" if i < 2 else "ENTITY").alias("role")) for i, p in enumerate(PARTIES))))
    return events.select("event_id", "day", parties.alias("m")).select("m.name", "day", "event_id", "m.place", "m.role").where("name is not null and name <> ''")


def ends(events: DataFrame) -> DataFrame:
    """(name key, existence_end): the end set by the last merger, conversion or renaming in the order of events."""
    ending = ((F.col("event_type") == "MERGED_INTO") & (F.col("subject") != F.col("object_entity"))) | (F.col("event_type").isin("CONVERTED_TO", "RENAMED_TO") & (F.col("subject") != F.col("result_entity")))
    return events.where(ending).groupBy(F.lower(F.trim("subject")).alias("entity_key")).agg(F.max_by("day", F.struct(F.coalesce("day", F.lit("")), "event_id")).alias("existence_end"))


def nodes(events: DataFrame) -> DataFrame:
    """(node_id, canonical_name, entity_key, role, observed_from, existence_end): one node a name in any letter case; first name and role seen stay."""
    order = F.struct(F.coalesce("day", F.lit("")), "event_id", "place")
    rows = mentions(events).groupBy(F.lower(F.trim("name")).alias("entity_key")).agg(F.min_by("name", order).alias("canonical_name"), F.min_by("role", order).alias("role"), F.min("day").alias("observed_from"))
    return rows.join(ends(events), "entity_key", "left").select(stable_id("node", F.col("canonical_name"), digits=20).alias("node_id"), "canonical_name", "entity_key", "role", "observed_from", "existence_end")


def edges(events: DataFrame) -> DataFrame:
    """(edge_type, edge_class, subject, object, day, end_day, event_id): links in the order of events; ownership follows from acquisitions and subsidiaries.

    An agreement ends with the last acquisition of the same pair that comes after it and before the next agreement.
    """
    pair = Window.partitionBy("acquirer", "target").orderBy(F.coalesce("day", F.lit("")), "event_id")
    deals = events.where("event_type in ('AGREED_TO_ACQUIRE', 'ACQUIRED') and acquirer is not null and target is not null")
    turn = deals.withColumn("turn", F.sum(F.when(F.col("event_type") == "AGREED_TO_ACQUIRE", 1).otherwise(0)).over(pair))
    closed = turn.where("event_type = 'ACQUIRED' and turn > 0").groupBy("acquirer", "target", "turn").agg(F.max_by("day", F.struct(F.coalesce("day", F.lit("")), "event_id")).alias("end_day"))
    agreed = turn.where("event_type = 'AGREED_TO_ACQUIRE'").join(closed, ["acquirer", "target", "turn"], "left")
    none = F.lit(None).cast("string")
    edge = lambda df, kind, cls, s, o, end=none: df.select(F.lit(kind).alias("edge_type") if kind else F.col("event_type").alias("edge_type"), F.lit(cls).alias("edge_class"), F.col(s).alias("subject"), F.col(o).alias("object"), "day", end.alias("end_day"), "event_id").where("subject is not null and object is not null")
    of = lambda kind: events.where(F.col("event_type") == kind)
    parts = [
        edge(agreed, None, "EVENT", "acquirer", "target", F.col("end_day")), edge(of("ACQUIRED"), None, "EVENT", "acquirer", "target"), edge(of("ACQUIRED"), "CORPORATE_OWNS", "STATE", "acquirer", "target"),
        edge(of("SUBSIDIARY_OF"), None, "STATE", "subject", "object_entity"), edge(of("SUBSIDIARY_OF"), "CORPORATE_OWNS", "STATE", "object_entity", "subject"), edge(of("MERGED_INTO"), None, "EVENT", "subject", "object_entity"),
        edge(of("CONVERTED_TO").where("subject <> result_entity"), None, "EVENT", "subject", "result_entity"), edge(of("RENAMED_TO"), None, "EVENT", "subject", "result_entity"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def existence_as_of(node_rows: DataFrame, day: str) -> DataFrame:
    """(node_id, canonical_name, status): starts are never known from events, so that a node has ended or its start is unknown."""
    return node_rows.select("node_id", "canonical_name", F.when(F.col("existence_end") <= day, "ENDED").otherwise("UNKNOWN_START").alias("status"))


def edges_as_of(edge_rows: DataFrame, day: str) -> DataFrame:
    """States in effect on the day, the end not included, and events up to it."""
    started = F.col("day").isNull() | (F.col("day") <= day)
    effective = started & (F.col("end_day").isNull() | (F.col("end_day") > day))
    return edge_rows.where(F.when(F.col("edge_class") == "STATE", effective).otherwise(F.col("day") <= day))


def attribute_as_of(ledger_rows: DataFrame, valid_day: int, recorded_us: int) -> DataFrame:
    """What the ledger held at a recording time about a valid day."""
    return ledger_rows.where((F.col("valid_from") <= valid_day) & (F.col("valid_to") > valid_day) & (F.col("recorded_from") <= recorded_us) & (F.col("recorded_to") > recorded_us))


def states(events: DataFrame) -> DataFrame:
    """(entity_key, day, state_type, value, event_id) that events leave behind: a merger two legal statuses, a conversion a legal form. ``to_form`` of the events is optional."""
    key = lambda c: F.lower(F.trim(c)).alias("entity_key")
    merged = events.where("event_type = 'MERGED_INTO' and subject is not null and object_entity is not null and subject <> object_entity")
    form = F.col("to_form") if "to_form" in events.columns else F.lit(None).cast("string")
    status = lambda who, value: merged.select(key(who), "day", F.lit("LEGAL_STATUS").alias("state_type"), F.lit(value).alias("value"), "event_id")
    converted = events.where("event_type = 'CONVERTED_TO' and subject is not null").select(key("subject"), "day", F.lit("LEGAL_FORM").alias("state_type"), form.alias("value"), "event_id")
    return status("subject", "MERGED_OUT").unionByName(status("object_entity", "SURVIVING_ENTITY")).unionByName(converted)


def state_log(state_rows: DataFrame) -> DataFrame:
    """(entity_key, log array of (day, state_type, value)): a node's states in the order of day and type; undated ones first."""
    entry = F.struct(F.coalesce("day", F.lit("")).alias("day"), "state_type", "value")
    return state_rows.groupBy("entity_key").agg(F.array_sort(F.collect_list(entry)).alias("log"))


def existence(start: Column, end: Column, day: str) -> Column:
    """NOT_YET_EXISTING before a known start, ENDED from a known end on, UNKNOWN_START where none is known, else EXISTING."""
    return F.when(start > day, "NOT_YET_EXISTING").when(end <= day, "ENDED").when(start.isNull(), "UNKNOWN_START").otherwise("EXISTING")


def entity_view(state_rows: DataFrame, edge_rows: DataFrame, day: str) -> DataFrame:
    """(entity_key, kind, what, other, day) as of a day: states up to it, state links in effect, events up to it, from either end's side."""
    had = state_rows.where(F.col("day").isNull() | (F.col("day") <= day)).select("entity_key", F.lit("STATE").alias("kind"), F.col("state_type").alias("what"), F.col("value").alias("other"), "day")
    seen = edges_as_of(edge_rows, day)
    side = lambda own, other: seen.select(F.lower(F.trim(own)).alias("entity_key"), F.when(F.col("edge_class") == "STATE", "RELATION").otherwise("EVENT").alias("kind"), F.col("edge_type").alias("what"), F.col(other).alias("other"), "day")
    return had.unionByName(side("subject", "object")).unionByName(side("object", "subject"))


def find_nodes(node_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id): the first node with exactly the name, in any letter case, else the only one whose name has the query in it, else none.

    ``queries``: (query_id, query). Blocked on the query's first three letters, which a name that holds it has in a row.
    """
    named = node_rows.select("node_id", F.lower("canonical_name").alias("name")).where("name is not null")
    q = queries.select("query_id", F.lower(F.trim("query")).alias("query")).where("query <> ''").withColumn("gram", F.substring("query", 1, 3))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("name"))), lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr("name", i, n)))))
    hits = named.where("name <> ''").withColumn("gram", F.explode(grams)).join(q, "gram").where(F.contains("name", F.col("query")))
    per = hits.groupBy("query_id").agg(F.min(F.when(F.col("name") == F.col("query"), F.col("node_id"))).alias("exact"), F.count_distinct("node_id").alias("n"), F.min("node_id").alias("only"))
    return per.select("query_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("node_id")).where("node_id is not null")


def activity(rows: DataFrame) -> DataFrame:
    """(entity_key, first_seen, last_seen) of rows (entity_key, day): bounds of what is recorded, undated rows aside."""
    return rows.groupBy("entity_key").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


def active_as_of(activity_rows: DataFrame, day: str) -> DataFrame:
    """Nodes active on the day, the last one not included; an unknown bound doesn't bind."""
    return activity_rows.where((F.col("first_seen").isNull() | (F.col("first_seen") <= day)) & (F.col("last_seen").isNull() | (F.col("last_seen") > day)))
