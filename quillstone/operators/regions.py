"""Positions of patterns in texts, and the windows, regions, sections and phrases that follow from them.

Positions come from what a split leaves between the matches, so that all stays in the JVM. Texts are made ASCII
first, one sign for each other character, so that positions hold in the original and word ends mean the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import fold_name
from quillstone.session import Scratch

# Kinds of signals for mergers and acquisitions, on lower-case text
SIGNALS = {
    "ACQUIRE": r"\bacquir(?:ed|es|ing|e)\b", "ACQUISITION": r"\bacquisitions?\b", "BUSINESS_COMBINATION": r"\bbusiness combinations?\b", "MERGER": r"\bmerg(?:ers|er|ed|ing)\b", "PURCHASE_PRICE": r"\bpurchase price(?: allocation)?\b",
    "DIVESTITURE": r"\bdivest(?:ed|itures|iture|ing|ments|ment)?\b", "SALE": r"\b(?:completed|completion of|entered into)\b.{0,80}\bsale of\b", "SOLD": r"\bsold\b",
}
SECTION = r"(?m)^\s*Item\s+\d\.\d{2}\.?\s"
BEFORE, AFTER, GAP, LARGEST, OVERLAP = 1_400, 1_800, 250, 12_000, 500


def ascii_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def hits(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, kind, start, end, n_chars) of every match; start counts from 0. A long text spreads over no more rows than it has matches."""
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("_t"))

    def found(kind: str, p: str) -> Column:
        m = F.regexp_extract_all("_t", F.lit(p), 0)
        return F.struct(F.lit(kind).alias("kind"), F.arrays_zip(F.transform(F.slice(F.split("_t", p, -1), F.lit(1), F.size(m)), F.length).alias("g"), F.transform(m, F.length).alias("l")).alias("at"))

    every = F.explode(F.array(*(F.when(F.col("_t").rlike(p), found(kind, p)) for kind, p in patterns.items()))).alias("x")  # one scan for all kinds
    out = rows.select("doc_id", F.length("_t").alias("n_chars"), every).where("x is not null").select("doc_id", "n_chars", F.col("x.kind").alias("kind"), F.posexplode("x.at").alias("i", "y"))
    out = out.select("doc_id", "kind", "n_chars", "i", F.col("y.g").alias("g"), F.col("y.l").alias("l"))
    w = Window.partitionBy("doc_id", "kind").orderBy("i")
    end = F.sum(F.col("g") + F.col("l")).over(w)
    return out.select("doc_id", "kind", (end - F.col("l")).cast("int").alias("start"), end.cast("int").alias("end"), "n_chars")


def merged_windows(hit_rows: DataFrame, before: int = BEFORE, after: int = AFTER, gap: int = GAP) -> DataFrame:
    """(doc_id, start, end): windows around hits, fused where they lie at most ``gap`` apart."""
    v = hit_rows.select("doc_id", F.greatest(F.lit(0), F.col("start") - before).alias("s"), F.least("n_chars", F.col("end") + after).alias("e")).distinct()
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0)).withColumn("k", F.sum("new").over(w))
    return v.groupBy("doc_id", "k").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("k")


def split_regions(windows: DataFrame, largest: int = LARGEST, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, region_number, start, end): windows cut into overlapping pieces of at most ``largest`` characters."""
    step = max(1, largest - overlap)
    last = F.greatest(F.ceil((F.col("end") - F.col("start") - largest) / step).cast("int"), F.lit(0))
    cut = windows.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.select("doc_id", (F.col("start") + F.col("i") * step).alias("start"), F.least("end", F.col("start") + F.col("i") * step + largest).alias("end"))
    return cut.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")).alias("region_number"), "start", "end")


def region_hits(regions: DataFrame, hit_rows: DataFrame) -> DataFrame:
    """(doc_id, region_number, start, end, n_hits, kinds): overlap join on the document; regions without a hit are left out."""
    both = regions.join(hit_rows.select("doc_id", "kind", F.col("start").alias("hs"), F.col("end").alias("he")), "doc_id").where((F.col("hs") < F.col("end")) & (F.col("he") > F.col("start")))
    return both.groupBy("doc_id", "region_number", "start", "end").agg(F.count(F.lit(1)).alias("n_hits"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def sections(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, item, start, end, body): from each section's heading to the next."""
    heads = hits(docs, text, {"ITEM": SECTION})
    w = Window.partitionBy("doc_id").orderBy("start")
    cut = heads.select("doc_id", "start", F.col("end").alias("body_start"), F.coalesce(F.lead("start").over(w), F.col("n_chars")).alias("body_end"))
    both = cut.join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id")
    head, body = F.expr("substring(_t, start + 1, body_start - start)"), F.expr("substring(_t, body_start + 1, body_end - body_start)")
    return both.select("doc_id", F.regexp_extract(head, r"(\d\.\d{2})", 1).alias("item"), F.col("body_start").alias("start"), F.col("body_end").alias("end"), F.trim(body).alias("body"))


def sentences(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, k, sentence) of every text, split after full stops, exclamation and question marks before a blank, and at line ends."""
    return docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(F.split(text, r"[.!?]+\s+|[\r\n]+", -1)).alias("k", "s")).select("doc_id", "k", F.trim("s").alias("sentence")).where("sentence <> ''")


# What marks a merger as proposed or completed
PROPOSED = ("will merge", "will be merged", "will continue", "will be converted", "will become", "to merge", "would merge", "upon the terms and subject to")
COMPLETED = ("merged with and into", "was converted", "completed its acquisition", "completed the previously announced", "becoming a wholly owned subsidiary", "continuing as the surviving", "surviving the merger as")


def tense(fragment: Column) -> Column:
    """PROPOSED, COMPLETED or UNKNOWN of a fragment; a completed verb outweighs a proposing one unless "will" stands there too."""
    f = F.lower(fragment)
    has = lambda words: F.greatest(*(F.contains(f, F.lit(w)) for w in words))
    padded = F.concat(F.lit(" "), f, F.lit(" "))
    done = (F.contains(padded, F.lit(" merged with and into ")) & ~F.contains(f, F.lit("will "))) | F.contains(padded, F.lit(" was converted "))
    return F.when(has(PROPOSED), F.when(done, "COMPLETED").otherwise("PROPOSED")).when(has(COMPLETED), "COMPLETED").otherwise("UNKNOWN")


MOST_KEYS = 500_000  # keys that may be broadcast, some 40 MB; more of them are met by an exchange


def phrase_hits(docs: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """(doc_id, position, n_words, name_id, name) of names standing in texts as whole words; of hits that overlap the longest stays, the first among equals.

    ``names``: (name_id, name), folded, two words at least. A text's places are first met with the distinct keys of the names'
    first two words, broadcast up to ``MOST_KEYS`` of them, so that only places where a name may begin are exchanged; names of
    any length are then compared with as many words of the text. Overlaps are settled within each run of overlapping hits.
    """
    scratch = Scratch(docs.sparkSession)
    two = lambda at: F.xxhash64(F.element_at("w", at), F.element_at("w", at + 1))
    keyed = names.withColumn("w", F.split("name", " ")).where(F.size("w") >= 2).select("name_id", "name", F.size("w").alias("n_words"), two(F.lit(1)).alias("two"))
    keys = keyed.select("two").distinct()
    if keys.count() <= MOST_KEYS:
        keys = F.broadcast(keys)
    folded = scratch.write(docs.where(F.col(text).isNotNull()).select("doc_id", fold_name(F.col(text)).alias("t")))  # folding is dear: once, not again in a filter or for the second reading
    words = folded.where("t is not null").select("doc_id", F.split("t", " ").alias("w")).where(F.size("w") >= 2)
    pairs = words.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), two)).alias("p", "two")).join(keys, "two", "left_semi")
    maybe = pairs.join(keyed, "two").select("doc_id", (F.col("p") + 1).alias("position"), "n_words", "name_id", "name")
    found = maybe.join(words, "doc_id").where(F.array_join(F.slice("w", F.col("position"), F.col("n_words")), " ") == F.col("name")).drop("w")
    return _longest(found)


def _longest(found: DataFrame) -> DataFrame:
    """Hits that no longer one overlaps, nor an equally long one before; a hit that loses to a kept one hides nothing."""
    order = Window.partitionBy("doc_id").orderBy("position", "n_words", "name_id")
    reach = F.max(F.col("position") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("position") < reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    hit = F.struct((-F.length("name")).alias("order"), "position", "name_id", "n_words", "name")
    by_run = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    apart = lambda x, y: (x["position"] >= y["position"] + y["n_words"]) | (y["position"] >= x["position"] + x["n_words"])
    kept = F.aggregate("hits", F.slice("hits", 1, 1), lambda got, x: F.when(F.forall(got, lambda y: apart(x, y)), F.concat(got, F.array(x))).otherwise(got))
    return by_run.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.position", "x.n_words", "x.name_id", "x.name")
