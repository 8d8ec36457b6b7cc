"""Passages of texts around names: sentences with what stands about them, windows around terms, names in order, and the longest name that begins a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import decomposed
from quillstone.operators.regions import merged_windows
from quillstone.session import Scratch

SENTENCE_END = r"([.!?])\s+([A-Z“\"(])"
RADIUS = 900  # characters before and after a term


def name_passages(docs: DataFrame, text: str, names: DataFrame, context: int = 1) -> DataFrame:
    """(doc_id, name_id, first, last, passage): sentences that hold the name in any letter case with ``context`` sentences about them, fused where they meet.

    ``names``: (doc_id, name_id, name), few a document. All of a document's passages come out.
    """
    cut = docs.where(F.col(text).isNotNull()).select("doc_id", F.filter(F.split(F.regexp_replace(text, SENTENCE_END, "$1\u0001$2"), "\u0001"), lambda s: F.trim(s) != "").alias("s")).where(F.size("s") > 0)
    both = cut.join(names.where("trim(name) <> ''"), "doc_id")
    hit = both.select("doc_id", "name_id", F.size("s").alias("n"), F.explode(F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: F.contains(F.lower(F.element_at("s", i)), F.lower(F.trim("name"))))).alias("i"))
    span = hit.select("doc_id", "name_id", F.greatest(F.lit(1), F.col("i") - context).alias("lo"), F.least("n", F.col("i") + context).alias("hi"))
    w = Window.partitionBy("doc_id", "name_id").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = span.withColumn("new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    spans = runs.groupBy("doc_id", "name_id", "k").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    return spans.join(cut, "doc_id").select("doc_id", "name_id", "first", "last", F.array_join(F.transform(F.slice("s", F.col("first"), F.col("last") - F.col("first") + 1), F.trim), " ").alias("passage"))


def term_hits(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(doc_id, term, kind, start, end, n_chars) of terms standing in a document's text as whole words, whatever stands between the words.

    ``terms``: (doc_id, term). The pattern is the term's words, so that no term is taken for a pattern.
    """
    words = F.filter(F.split(F.regexp_replace(decomposed(F.col("term")), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    known = terms.select("doc_id", "term", F.concat(F.lit(r"(?<![a-z0-9])"), F.array_join(words, "[^a-z0-9]+"), F.lit(r"(?![a-z0-9])")).alias("p"), F.size(words).alias("n")).where("n > 0")
    both = docs.where(F.col(text).isNotNull()).select("doc_id", F.lower(text).alias("_t")).join(known, "doc_id")
    m = F.regexp_extract_all("_t", F.col("p"), F.lit(0))
    found = both.select("doc_id", "term", F.length("_t").alias("n_chars"), F.posexplode(F.arrays_zip(F.transform(F.slice(F.split("_t", F.col("p"), -1), F.lit(1), F.size(m)), F.length).alias("g"), F.transform(m, F.length).alias("l"))).alias("i", "x"))
    end = F.sum(F.col("x.g") + F.col("x.l")).over(Window.partitionBy("doc_id", "term").orderBy("i"))
    return found.select("doc_id", "term", F.lit("TERM").alias("kind"), (end - F.col("x.l")).cast("int").alias("start"), end.cast("int").alias("end"), "n_chars")


def term_passages(docs: DataFrame, text: str, terms: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, start, end, terms, passage): windows of ``radius`` characters around the terms, fused where they meet; all of them."""
    hits = term_hits(docs, text, terms)
    windows = merged_windows(hits, radius, radius, 0)
    inside = windows.join(hits.select("doc_id", "term", F.col("start").alias("s"), F.col("end").alias("e")), "doc_id").where("s < end and e > start")
    per = inside.groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return per.join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id").select("doc_id", "start", "end", "terms", F.trim(F.expr("substring(_t, start + 1, end - start)")).alias("passage"))


def in_region(passages: DataFrame, regions: DataFrame, chars: int = 200) -> DataFrame:
    """``passages`` (doc_id, passage, ..) with ``in_region``: a region of the same document holds the passage's first ``chars`` characters, blanks and letter case aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    keyed = passages.withColumn("_p", F.substring(plain("passage"), 1, chars))
    hit = keyed.select("doc_id", "_p").distinct().join(regions.select("doc_id", plain("region").alias("_r")), "doc_id").where(F.contains("_r", F.col("_p"))).select("doc_id", "_p").distinct().withColumn("in_region", F.lit(True))
    return keyed.join(hit, ["doc_id", "_p"], "left").withColumn("in_region", F.coalesce("in_region", F.lit(False))).drop("_p")


def ordered_names(docs: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """(doc_id, name, position, context, is_shell): names in the order of their first place, each with what stands up to the next one's.

    ``names``: (doc_id, name). A name is a shell where its own description, up to the end of the sentence, says "subsidiary of".
    """
    at = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("_t")).join(names.where("name <> ''").distinct(), "doc_id").withColumn("position", F.instr("_t", F.col("name"))).where("position > 0")
    following = F.lead("position").over(Window.partitionBy("doc_id").orderBy("position", F.desc(F.length("name"))))
    after = at.withColumn("next", F.coalesce(following, F.length("_t") + 1)).withColumn("context", F.expr("substring(_t, position + length(name), greatest(next - position - length(name), 0))"))
    own = F.split(F.col("context"), r"\.\s+(?=[A-Z])", 2)[0]
    return after.select("doc_id", "name", "position", "context", own.rlike(r"(?i)\bsubsidiary of\b").alias("is_shell"))


def parents_named(ordered: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, parent): of shells, the known name that begins what follows "subsidiary of", the longest of several; the name itself where none does."""
    said = ordered.where("is_shell").select("doc_id", "name", F.regexp_extract("context", r"(?is)^.{0,220}?\bsubsidiary of\s+(.{0,100})", 1).alias("said"))
    best = longest_prefix(said.select("doc_id", "name", F.col("said").alias("text")), names.select("doc_id", F.col("name").alias("known")))
    return said.select("doc_id", "name").join(best, ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce("known", "name").alias("parent"))


def longest_prefix(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, name, known): the longest of a document's known names that begins ``text``, a full stop at the end aside; rows without one are left out."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"\.+$", "")
    both = rows.join(known.where("known <> ''").distinct(), "doc_id").where(F.startswith("text", F.col("known")) | F.startswith(bare("text"), bare("known")))
    return both.groupBy("doc_id", "name").agg(F.max_by("known", F.struct(F.length("known"), "known")).alias("known"))


def survivor_aliases(docs: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """(doc_id, alias, name): ``aliases`` and those that "X continuing as the surviving corporation (the "Y")" adds, until nothing new comes.

    Each round looks up the X of all such statements among the names known so far; a chain of statements ends by itself.
    """
    said = docs.where(F.col(text).isNotNull()).select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(r"(?i)\b[\w&.,’' -]{2,80}?\s+continuing as the surviving (?:corporation|company|limited liability company)[^.;]{0,260}?\(\s*the\s+[“\"][^”\"]+[”\"]\s*\)"), 0)).alias("m"))
    said = said.select("doc_id", F.trim(F.regexp_extract("m", r"(?is)^(.*?)\s+continuing as the surviving", 1)).alias("before"), F.trim(F.regexp_extract("m", r"(?is)\(\s*the\s+[“\"]([^”\"]+)[”\"]\s*\)$", 1)).alias("defined"))
    scratch = Scratch(docs.sparkSession)
    said, known = scratch.write(said), scratch.write(aliases.select("doc_id", "alias", "name").distinct())
    while True:
        ends = said.join(known, "doc_id").where(F.endswith(F.concat(F.lit(" "), F.lower("before")), F.concat(F.lit(" "), F.lower("alias"))))
        new = ends.groupBy("doc_id", F.col("defined").alias("alias")).agg(F.max_by("name", F.struct(F.length("alias"), "name")).alias("name")).where("alias <> ''")
        new = new.join(known.select("doc_id", "alias"), ["doc_id", "alias"], "left_anti")
        new, (n,) = scratch.write_counting(new, F.count(F.lit(1)))
        if not n:
            return known
        known = known.unionByName(new)


def explicit_mergers(docs: DataFrame, text: str, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, survivor, event_day, excerpt): a text that names the subject and says "merged into X effective DATE"; the first such statement.

    ``subjects``: (doc_id, subject).
    """
    pattern = r"(?i)\bmerged (?:with and )?into ([A-Z][\w&.,’' -]{1,80}?),? (?:effective|with effect from|on) (?:as of )?([A-Z][a-z]+ \d{1,2}, ?\d{4})"
    rows = docs.where(F.col(text).rlike(pattern)).select("doc_id", F.col(text).alias("_t")).join(subjects, "doc_id").where(F.contains(F.lower("_t"), F.lower(F.trim("subject"))) & (F.trim("subject") != ""))
    g = lambda i: F.regexp_extract("_t", pattern, i)
    return rows.select("doc_id", "subject", F.trim(g(1)).alias("survivor"), F.date_format(F.try_to_date(F.initcap(g(2)), "MMMM d, yyyy"), "yyyy-MM-dd").alias("event_day"), g(0).alias("excerpt"))


def verdict(in_text_region: Column, n_seen: Column, weight: Column, threshold: float, n_spellings: Column, recognized: Column, n_events: Column, matches: Column) -> Column:
    """Why a passage did or didn't yield its event: the first of seven reasons that holds."""
    return (
        F.when(~in_text_region, "NOT_IN_REGION")
        .when(~recognized & (n_seen == 0), "ENTITY_NOT_SEEN")
        .when(~recognized & (weight >= threshold) & (n_spellings > 1), "ENTITY_SPLIT_VOTE")
        .when(~recognized, "ENTITY_BELOW_THRESHOLD")
        .when(n_events == 0, "EVENT_GRAMMAR_MISS")
        .when(~matches, "EVENT_TYPE_MISMATCH")
        .otherwise("FOUND")
    )
