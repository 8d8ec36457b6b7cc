"""The system's events against hand-made ones: matching that uses each event up, the stages each true event reached, and identities compared loosely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import identity_key

# Kinds of events that count as one when compared
ALIKE_TYPES = {"MERGED_INTO": ("MERGED_INTO", "ACQUIRED"), "ACQUIRED": ("ACQUIRED",), "DIVESTED_BUSINESS": ("DIVESTED_BUSINESS",)}
STAGES = ("filings_retrieved", "relevant_text_present", "locator_captured", "entity_recognized", "event_extracted", "candidate_emitted")
# What is missing where a stage is the first not reached
FAILURES = {"relevant_text_present": "DISCLOSURE_NOT_IN_RETRIEVED_CORPUS", "locator_captured": "LOCATOR_MISS", "entity_recognized": "ENTITY_RECOGNITION_MISS", "event_extracted": "EVENT_GRAMMAR_MISS", "candidate_emitted": "CANDIDATE_EMISSION_MISS"}


def same_type(gold: Column, system: Column) -> Column:
    """Equal kinds, or one that counts as the gold one's."""
    alike = F.create_map(*(x for k, v in ALIKE_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_contains(F.coalesce(F.element_at(alike, gold), F.array(gold)), system)


def match_events(gold: DataFrame, system: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((company, gold_id, seq, stage, system_seq), system events used by none) by going through each company's gold events in order.

    Both sides: (company, counterparty, event_type, status, seq), gold with gold_id. A gold event takes, of the events not yet
    taken with its counterparty's identity, the first of its type and status (stage NONE), else the first of its type
    (STATUS_MISMATCH), else the first (EVENT_TYPE_MISMATCH); without any it is NOT_DISCOVERED. Only events of one company and
    counterparty compete, so that each such pair is one small fold.
    """
    key = identity_key(F.col("counterparty")).alias("party")
    g = gold.select("company", key, F.struct("seq", "gold_id", "event_type", "status").alias("g")).groupBy("company", "party").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    s = system.select("company", key, F.struct("seq", "event_type", "status").alias("s")).groupBy("company", "party").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    both = g.join(s, ["company", "party"], "left").withColumn("ss", F.coalesce("ss", F.array().cast("array<struct<seq:bigint,event_type:string,status:string>>")))
    result = "array<struct<seq:bigint,gold_id:string,stage:string,system_seq:bigint>>"

    def take(state: Column, x: Column) -> Column:
        left = state["left"]
        typed = F.filter(left, lambda y: same_type(x["event_type"], y["event_type"]))
        exact = F.filter(typed, lambda y: y["status"].eqNullSafe(x["status"]))
        pick = F.when(F.size(exact) > 0, exact[0]).when(F.size(typed) > 0, typed[0]).otherwise(F.try_element_at(left, F.lit(1)))
        stage = F.when(F.size(left) == 0, "NOT_DISCOVERED").when(F.size(typed) == 0, "EVENT_TYPE_MISMATCH").when(F.size(exact) == 0, "STATUS_MISMATCH").otherwise("NONE")
        row = F.struct(x["seq"].alias("seq"), x["gold_id"].alias("gold_id"), stage.alias("stage"), pick["seq"].alias("system_seq"))
        return F.struct(F.filter(left, lambda y: ~y["seq"].eqNullSafe(pick["seq"])).alias("left"), F.concat(state["done"], F.array(row)).alias("done"))

    start = F.struct(F.col("ss").alias("left"), F.array().cast(result).alias("done"))
    matched = both.withColumn("done", F.aggregate("gs", start, take, lambda st: st["done"])).select("company", F.explode("done").alias("d")).select("company", "d.gold_id", "d.seq", "d.stage", "d.system_seq")
    unused = system.join(matched.where("system_seq is not null").select("company", F.col("system_seq").alias("seq")), ["company", "seq"], "left_anti")
    return matched, unused


def recall(matched: DataFrame) -> DataFrame:
    """(stage, n, n_gold, share): how the gold events of all companies end."""
    total = matched.agg(F.count(F.lit(1)).alias("n_gold"))
    return matched.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("stage", "n", "n_gold", (F.col("n") / F.col("n_gold")).alias("share"))


def by_pivot(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """(company, counterparty, event_type, status): events in which a company takes part under any of its names, each once.

    ``events``: (subject, object, event_type, status); ``aliases``: (company, name). A company's events under its names are
    united; one whose two ends are both the company says nothing.
    """
    names = aliases.select("company", identity_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    sides = events.select("subject", "object", "event_type", "status", F.explode(F.array(F.struct(F.col("subject").alias("own"), F.col("object").alias("counterparty")), F.struct(F.col("object").alias("own"), F.col("subject").alias("counterparty")))).alias("x"))
    rows = sides.select("x.own", "x.counterparty", "event_type", "status", identity_key(F.col("x.own")).alias("k"), identity_key(F.col("x.counterparty")).alias("o")).join(names, "k")
    return rows.join(names.select("company", F.col("k").alias("o")), ["company", "o"], "left_anti").where("counterparty is not null").groupBy("company", "o", "event_type", "status").agg(F.min("counterparty").alias("counterparty")).select("company", "counterparty", "event_type", "status")


def funnel(gold: DataFrame, texts: DataFrame, sections: DataFrame, organizations: DataFrame, events: DataFrame, candidates: DataFrame) -> DataFrame:
    """(company, gold_id, the six stages, deepest_stage, failure) of every gold event.

    ``gold``: (company, gold_id, names array, event_type, status). ``texts`` and ``sections``: (company, text); ``organizations``
    and ``candidates``: (company, name); ``events``: (company, subject, object, event_type, status). Names stand in a text in any
    letter case; organizations agree by identity. Texts and gold events meet only within a company.
    """
    named = gold.select("company", "gold_id", "event_type", "status", F.explode("names").alias("name")).where("trim(name) <> ''").withColumn("k", identity_key(F.col("name")))
    low = named.select("company", "gold_id", F.lower(F.trim("name")).alias("n"))
    ids = named.where("k <> ''").select("company", "gold_id", "k", F.upper("event_type").alias("gt"), F.upper("status").alias("gs")).distinct()
    flag = lambda df, name: df.select("company", "gold_id").distinct().withColumn(name, F.lit(True))
    in_text = lambda df: low.join(df.select("company", F.lower("text").alias("t")), "company").where(F.contains("t", F.col("n")))
    by_id = lambda df, c: ids.join(df.select("company", identity_key(F.col(c)).alias("k")), ["company", "k"])
    side = events.select("company", F.explode(F.array("subject", "object")).alias("p"), F.upper("event_type").alias("et"), F.upper("status").alias("es")).select("company", identity_key(F.col("p")).alias("k"), "et", "es")
    hit = ids.join(side, ["company", "k"]).where("(gt is null or gt = '' or gt = et) and (gs is null or gs = '' or gs = es)")
    out = gold.select("company", "gold_id").join(texts.select("company").distinct().withColumn(STAGES[0], F.lit(True)), "company", "left")
    for rows, stage in ((in_text(texts), STAGES[1]), (in_text(sections), STAGES[2]), (by_id(organizations, "name"), STAGES[3]), (hit, STAGES[4]), (by_id(candidates, "name"), STAGES[5])):
        out = out.join(flag(rows, stage), ["company", "gold_id"], "left")
    out = out.withColumns({s: F.coalesce(s, F.lit(False)) for s in STAGES})
    deepest, reached = F.lit("CIK_RESOLVED"), F.lit(True)
    for s in STAGES:
        reached = reached & F.col(s)
        deepest = F.when(reached, s.upper()).otherwise(deepest)
    failure = F.coalesce(*(F.when(~F.col(s), f) for s, f in FAILURES.items()))
    return out.select("company", "gold_id", *STAGES, deepest.alias("deepest_stage"), failure.alias("failure"))


def loosely_same(a: Column, b: Column) -> Column:
    """One identity is a beginning of the other in whole words; false where either is empty."""
    x, y = F.concat(identity_key(a), F.lit(" ")), F.concat(identity_key(b), F.lit(" "))
    return (x != " ") & (y != " ") & (F.startswith(x, y) | F.startswith(y, x))
