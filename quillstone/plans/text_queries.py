"""Regions, sections, extraction, evaluation and coverage over whole documents, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import evaluation as E
from quillstone.operators import extraction as X
from quillstone.operators import passages as P
from quillstone.operators import regions as R
from quillstone.operators import registry
from quillstone.plans.name_queries import sql_fold
from quillstone.session import Scratch
from quillstone.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", R.ascii_text(F.col("text")).alias("text"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return R.hits(_docs(spark, d).withColumn("text", F.lower("text")), "text", R.SIGNALS)


def signal_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "kind", "start", "end")


def signal_windows_merged(spark: SparkSession, d: str) -> DataFrame:
    return R.merged_windows(_hits(spark, d))


def region_split(spark: SparkSession, d: str) -> DataFrame:
    found = Scratch(spark).write(_hits(spark, d))
    return R.region_hits(R.split_regions(R.merged_windows(found, 300, 400, 100), 1_000, 200), found)


def section_slices(spark: SparkSession, d: str) -> DataFrame:
    return R.sections(_docs(spark, d), "text").select("doc_id", "item", "start", "end", F.md5("body").alias("body_md5"))


def sentence_tense(spark: SparkSession, d: str) -> DataFrame:
    s = R.sentences(_docs(spark, d), "text")
    return s.groupBy(R.tense(F.col("sentence")).alias("tense")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def explicit_changes(spark: SparkSession, d: str) -> DataFrame:
    """The first conversion that a document states, with forms and the day it takes effect."""
    p = r"converted from an? ([A-Za-z .-]{2,40}?) corporation to an? ([A-Za-z .-]{2,40}?) limited liability company effective ([A-Z][a-z]+ \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2})"
    g = lambda i: F.regexp_extract("text", p, i)
    return _docs(spark, d).where(F.col("text").rlike(p)).select("doc_id", g(1).alias("from_place"), g(2).alias("to_place"), g(3).alias("effective"))


def financing_only(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first 2200 characters speak of financing and not of a merger agreement."""
    head = F.lower(F.substring("text", 1, 2200))
    finance = head.rlike("credit agreement|senior notes|underwriting agreement|partial financing of the proposed acquisition|term loan|credit facility")
    return _docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", (finance & ~head.rlike("agreement and plan of merger|business combination agreement")).alias("financing_only"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """The pages of official sites as they show their text; ``markup_text`` reads the texts of all sources."""
    return table(spark, d, "documents", "doc_id", "text", "source").where("text is not null and source = 'official_site'").select("doc_id", F.md5(T.strip_html(F.col("text"))).alias("text_md5"))


def markup_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a page shows it, whatever its source, in lines and in one line, and its title."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.md5(T.strip_html(F.col("text"))).alias("text_md5"), F.md5(T.visible_text(F.col("text"))).alias("visible_md5"), T.html_title(F.col("text")).alias("title"))


def company_passages(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of an issuer's documents that name the issuer, with one sentence before and after."""
    docs = table(spark, d, "documents", "doc_id", "cik", "text")
    names = docs.join(table(spark, d, "study_companies", "cik", "company"), "cik").select("doc_id", F.lit("issuer").alias("name_id"), F.col("company").alias("name"))
    return P.name_passages(docs.select("doc_id", R.ascii_text(F.col("text")).alias("text")), "text", names.distinct()).select("doc_id", "first", "last", F.md5("passage").alias("passage_md5"))


def document_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and registrable domains built from titles as addresses."""
    rows = table(spark, d, "documents", "doc_id", "title", "source").where("title is not null")
    url = F.concat(F.lit("https://www."), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit(".co.uk/"), F.col("source"))
    rows = rows.select("doc_id", T.url_host(url).alias("host"))
    return rows.select("doc_id", "host", T.registrable_domain(F.col("host")).alias("domain"))


def certificate_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of merger certificates, in texts made from suppliers and customers."""
    s = table(spark, d, "supplier", "s_suppkey", "s_name").join(table(spark, d, "customer", "c_custkey", "c_name"), F.col("s_suppkey") == F.col("c_custkey"))
    made = s.select("s_suppkey", F.concat(F.lit("SECOND: "), F.translate("s_name", "#", " "), F.lit(" Corp. shall be merged with and into "), F.translate("c_name", "#", " "), F.lit(" Inc.\nTHIRD: The name of the surviving corporation is "), F.translate("c_name", "#", " "), F.lit(" Inc., a Delaware corporation.\nThe merger shall become effective on March "), (F.col("s_suppkey") % 28 + 1).cast("string"), F.lit(", 2011.")).alias("t"))
    g = lambda p, i=1: F.nullif(F.regexp_extract("t", p, i), F.lit(""))
    merge = r"([A-Z][A-Za-z0-9&., -]+?) (?:will|shall) be merged with and into ([A-Z][A-Za-z0-9&. -]+)"
    return made.select("s_suppkey", g(merge, 1).alias("merging"), F.trim(g(merge, 2)).alias("into_name"), g(r"name of the surviving corporation is ([A-Z][A-Za-z0-9&. -]+?), a").alias("survivor"), F.date_format(F.try_to_date(g(r"effective on ([A-Z][a-z]+ \d{1,2}, \d{4})"), "MMMM d, yyyy"), "yyyy-MM-dd").alias("effective_date"))


def _registry_hits(spark: SparkSession, d: str) -> DataFrame:
    known = registry.entities(table(spark, d, "lei_entities", "record_id", "lei", "legal_name", "legal_jurisdiction", "entity_status"))
    names = known.where("name is not null").groupBy("name").agg(F.min("lei").alias("name_id"))
    return R.phrase_hits(table(spark, d, "documents", "doc_id", "text"), "text", names)


def gazetteer_hits(spark: SparkSession, d: str) -> DataFrame:
    return _registry_hits(spark, d).select("doc_id", "position", "name_id")


def _all_mentions(spark: SparkSession, d: str) -> DataFrame:
    """What the text's own grammar finds and what the registry knows."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return Scratch(spark).write(X.mentions(docs, "text").unionByName(X.registry_mentions(docs, "text", _registry_hits(spark, d))))


def organization_mentions(spark: SparkSession, d: str) -> DataFrame:
    return X.mentions(table(spark, d, "documents", "doc_id", "text"), "text")


def organization_vote(spark: SparkSession, d: str) -> DataFrame:
    found = _all_mentions(spark, d)
    return X.fuse(found)


def alias_vote(spark: SparkSession, d: str) -> DataFrame:
    found = _all_mentions(spark, d)
    return X.fuse_aliases(found, X.fuse(found))


def deal_events(spark: SparkSession, d: str) -> DataFrame:
    return X.deal_events(table(spark, d, "documents", "doc_id", "text"), "text")


def completed_events(spark: SparkSession, d: str) -> DataFrame:
    return X.completed_only(deal_events(spark, d)).groupBy("event_type", "rule").agg(F.count(F.lit(1)).alias("n"))


def ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    """Names of subsidiary lists by the weighted vote of the forms that hold them."""
    rows = table(spark, d, "edgar_subsidiaries", "cik", "form_type", "subsidiary_name").select(F.col("cik").alias("doc_id"), F.col("form_type").alias("recognizer"), T.fold_name(F.col("subsidiary_name")).alias("name")).where("name is not null and doc_id is not null")
    return X.fuse(rows, {"10-K": 1.0, "10-K/A": 0.5, "20-F": 0.75, "20-F/A": 0.25}, 1.0).select(F.col("doc_id").alias("cik"), "name", "votes")


def alias_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The way of writing each subsidiary that most rows have, the last in order among equals."""
    rows = table(spark, d, "edgar_subsidiaries", "cik", "subsidiary_name").select("cik", T.fold_name(F.col("subsidiary_name")).alias("k"), F.trim("subsidiary_name").alias("name")).where("k is not null and cik is not null")
    return rows.groupBy("cik", "k", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("cik", "k").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.max("n").alias("n"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "content_labels", "doc_id", "abusive", "reviewer").where("abusive is not null")
    settled = rows.groupBy("doc_id").agg((F.avg("abusive") > 0.5).alias("truth"))
    return rows.join(settled, "doc_id")


def prf_macro_micro(spark: SparkSession, d: str) -> DataFrame:
    """Every reviewer's labels against the majority, all together (micro), and the mean over reviewers (macro)."""
    y = F.col("abusive") == 1
    per = _labels(spark, d).groupBy("reviewer").agg(F.count_if(y & F.col("truth")).alias("tp"), F.count_if(y & ~F.col("truth")).alias("fp"), F.count_if(~y & F.col("truth")).alias("fn"))
    both = per.unionByName(per.agg(F.lit("micro").alias("reviewer"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    p, r, f = E.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = both.select("reviewer", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    none = F.lit(None).cast("bigint")
    macro = scored.where("reviewer <> 'micro'").agg(F.lit("macro").alias("reviewer"), none.alias("tp"), none.alias("fp"), none.alias("fn"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    return scored.unionByName(macro).select("reviewer", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def wilson_recall(spark: SparkSession, d: str) -> DataFrame:
    per = _labels(spark, d).groupBy("reviewer").agg(F.count_if("truth").cast("double").alias("n"), F.count_if(F.col("truth") & (F.col("abusive") == 1)).cast("double").alias("hits"))
    low, high = E.wilson(F.col("hits"), F.col("n"))
    return per.select("reviewer", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


STAGES = ["cik_resolved", "text_present", "locator_captured", "section_found", "title_given"]


def _funnel(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "cik", "text", "title", "form_type")
    t = F.col("text")
    return docs.select("doc_id", "cik", F.col("cik").isNotNull().alias("cik_resolved"), F.coalesce(F.length(t) > 0, F.lit(False)).alias("text_present"), F.lower(t).rlike("acqui|merg|divest").alias("locator_captured"), F.when(F.col("form_type").isNotNull(), t.rlike(r"Item\s+\d\.\d{2}")).alias("section_found"), F.col("title").isNotNull().alias("title_given"))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.stage_counts(_funnel(spark, d), STAGES)


def deepest_stage(spark: SparkSession, d: str) -> DataFrame:
    return _funnel(spark, d).groupBy(E.deepest_stage(STAGES).alias("deepest")).agg(F.count(F.lit(1)).alias("n"))


def pipeline_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.any_stage(_funnel(spark, d), "cik", STAGES)


def saturation_curve(spark: SparkSession, d: str) -> DataFrame:
    """Issuers new in each year's documents, and all so far."""
    rows = table(spark, d, "documents", "cik", "published_at").select("cik", F.year("published_at").alias("year"))
    return E.novelty(rows, "year", "cik")


def _filings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "cik", "form_type", "text").where("form_type is not null")
    return docs.select("cik", "form_type", F.year(F.lit("2000-01-01")).alias("y"), E.disposition(F.col("form_type"), F.array_join(F.regexp_extract_all("text", F.lit(r"Item\s+(\d\.\d{2})"), 1), ",")).alias("disposition"))


def filing_disposition(spark: SparkSession, d: str) -> DataFrame:
    return _filings(spark, d).groupBy("form_type", "disposition").agg(F.count(F.lit(1)).alias("n"))


def coverage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _filings(spark, d)
    return rows.groupingSets([("form_type",), ("disposition",), ()], "form_type", "disposition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cik").alias("n_ciks"))


def coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _filings(spark, d).where("cik is not null")
    forms = ["10-K", "20-F", "6-K", "8-K", "EX-21"]
    wide = rows.groupBy("cik").pivot("form_type", forms).count()
    total = wide.agg(F.lit("TOTAL").alias("cik"), *(F.sum(F.col(f"`{f}`")).alias(f) for f in forms))
    both = wide.unionByName(total)
    return both.select("cik", *(F.coalesce(F.col(f"`{f}`"), F.lit(0)).cast("bigint").alias("n_" + f.lower().replace("-", "")) for f in forms))


QUERIES = {f.__name__: f for f in (signal_hits, signal_windows_merged, region_split, section_slices, sentence_tense, explicit_changes, financing_only, html_text, markup_text, company_passages, document_hosts, certificate_fields, gazetteer_hits, organization_mentions, organization_vote, alias_vote, deal_events, completed_events, ensemble_vote, alias_argmax, prf_macro_micro, wilson_recall, stage_counts, deepest_stage, pipeline_rollup, saturation_curve, filing_disposition, coverage_grouping_sets, coverage_pivot)}

_A = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"
_HITS = "WITH t AS (SELECT doc_id, lower(" + _A + ") AS x FROM documents WHERE text IS NOT NULL), hs AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, length(x) AS n_chars, regexp_split_to_array(x, '{p}') AS pa, regexp_extract_all(x, '{p}', 0) AS ma FROM t" for k, p in R.SIGNALS.items()) + """),
hx AS (SELECT doc_id, kind, n_chars, unnest(range(1, len(ma) + 1)) AS i, unnest([length(z) FOR z IN pa[1:len(ma)]]) AS g, unnest([length(z) FOR z IN ma]) AS l FROM hs WHERE len(ma) > 0),
h AS (SELECT doc_id, kind, n_chars, (sum(g + l) OVER w - l)::INT AS s, (sum(g + l) OVER w)::INT AS e FROM hx WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i))"""


def _windows(b: int, a: int, g: int) -> str:
    return f""", v AS (SELECT DISTINCT doc_id, greatest(0, s - {b}) AS s, least(n_chars, e + {a}) AS e FROM h), v2 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v),
v3 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + {g} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM v2), mw AS (SELECT doc_id, min(s)::INT AS s, max(e)::INT AS e FROM v3 GROUP BY doc_id, k)"""


_TENSE = "CASE WHEN " + " OR ".join(f"contains(f, '{w}')" for w in R.PROPOSED) + " THEN CASE WHEN (contains(' ' || f || ' ', ' merged with and into ') AND NOT contains(f, 'will ')) OR contains(' ' || f || ' ', ' was converted ') THEN 'COMPLETED' ELSE 'PROPOSED' END WHEN " + " OR ".join(f"contains(f, '{w}')" for w in R.COMPLETED) + " THEN 'COMPLETED' ELSE 'UNKNOWN' END"
_CONV = r"converted from an? ([A-Za-z .-]{2,40}?) corporation to an? ([A-Za-z .-]{2,40}?) limited liability company effective ([A-Z][a-z]+ \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2})"
_FUNNEL = r"WITH f AS (SELECT doc_id, cik, cik IS NOT NULL AS cik_resolved, coalesce(length(text) > 0, false) AS text_present, regexp_matches(lower(text), 'acqui|merg|divest') AS locator_captured, CASE WHEN form_type IS NOT NULL THEN regexp_matches(text, 'Item\s+\d\.\d{2}') END AS section_found, title IS NOT NULL AS title_given FROM documents)"
_FILINGS = r"""WITH x AS (SELECT cik, form_type, array_to_string(regexp_extract_all(text, 'Item\s+(\d\.\d{2})', 1), ',') AS items FROM documents WHERE form_type IS NOT NULL),
fl AS (SELECT cik, form_type, CASE WHEN form_type IN ('8-K', '8-K/A') THEN CASE WHEN coalesce(trim(items), '') = '' THEN 'skipped_no_item_metadata' WHEN contains(items, '1.01') OR contains(items, '2.01') THEN 'fetched_item_gated' ELSE 'skipped_item_gate' END WHEN form_type IN ('10-K', '10-K/A', '20-F', '20-F/A', '40-F', '40-F/A', '6-K', '6-K/A') THEN 'fetched_via_locator' ELSE 'skipped_unsupported_other' END AS disposition FROM x)"""
_LABELS = "WITH r AS (SELECT doc_id, abusive, reviewer, avg(abusive) OVER (PARTITION BY doc_id) > 0.5 AS truth FROM content_labels WHERE abusive IS NOT NULL)"
_CERT = "WITH m AS (SELECT s_suppkey, 'SECOND: ' || replace(s_name, '#', ' ') || ' Corp. shall be merged with and into ' || replace(c_name, '#', ' ') || ' Inc.' || chr(10) || 'THIRD: The name of the surviving corporation is ' || replace(c_name, '#', ' ') || ' Inc., a Delaware corporation.' || chr(10) || 'The merger shall become effective on March ' || (s_suppkey % 28 + 1) || ', 2011.' AS t FROM supplier JOIN customer ON s_suppkey = c_custkey)"
_MERGE = "([A-Z][A-Za-z0-9&., -]+?) (?:will|shall) be merged with and into ([A-Z][A-Za-z0-9&. -]+)"
_FORM_W = "CASE form_type WHEN '10-K' THEN 1.0 WHEN '10-K/A' THEN 0.5 WHEN '20-F' THEN 0.75 WHEN '20-F/A' THEN 0.25 ELSE 1.0 END::DOUBLE"



def _undone(x: str) -> str:
    for entity, char in {**T.ENTITIES, chr(160): " "}.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_PAGES = f"""WITH u AS (SELECT doc_id, source, text, regexp_replace(text, '{T.UNSEEN_MARKUP}', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, source, {_undone("regexp_replace(regexp_replace(x, '" + T.LINE_MARKUP + "', chr(10), 'g'), '<[^>]+>', ' ', 'g')")} AS s, {_undone("regexp_replace(x, '<[^>]+>', ' ', 'g')")} AS o, {_undone("regexp_replace(regexp_replace(regexp_extract(text, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '" + T.UNSEEN_MARKUP + "', ' ', 'g'), '<[^>]+>', ' ', 'g')")} AS h FROM u),
pg AS (SELECT doc_id, source, md5(regexp_replace(regexp_replace(regexp_replace(s, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')) AS text_md5, md5(trim(regexp_replace(o, '[\\s\\x0b]+', ' ', 'g'), ' ')) AS visible_md5, nullif(trim(regexp_replace(h, '[\\s\\x0b]+', ' ', 'g'), ' '), '') AS title FROM v)"""

ORACLE = {
    "signal_hits": _HITS + ' SELECT doc_id, kind, s AS "start", e AS "end" FROM h',
    "signal_windows_merged": _HITS + _windows(R.BEFORE, R.AFTER, R.GAP) + ' SELECT doc_id, s AS "start", e AS "end" FROM mw',
    "region_split": _HITS + _windows(300, 400, 100) + """, ct AS (SELECT doc_id, unnest(range(0, greatest(ceil((e - s - 1000) / 800.0)::INT, 0) + 1))::INT AS i, s, e FROM mw), cu AS (SELECT doc_id, s + i * 800 AS s, least(e, s + i * 800 + 1000) AS e FROM ct),
rg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, e)::INT AS region_number, s, e FROM cu)
SELECT rg.doc_id, region_number, rg.s AS "start", rg.e AS "end", count(*) AS n_hits, string_agg(DISTINCT h.kind, ',' ORDER BY h.kind) AS kinds FROM rg JOIN h ON h.doc_id = rg.doc_id AND h.s < rg.e AND h.e > rg.s GROUP BY 1, 2, 3, 4""",
    "section_slices": f"""WITH t AS (SELECT doc_id, {_A} AS x FROM documents WHERE text IS NOT NULL), hs AS (SELECT doc_id, x, regexp_split_to_array(x, '{R.SECTION}') AS pa, regexp_extract_all(x, '{R.SECTION}', 0) AS ma FROM t),
hx AS (SELECT doc_id, x, unnest(range(1, len(ma) + 1)) AS i, unnest([length(z) FOR z IN pa[1:len(ma)]]) AS g, unnest(ma) AS m FROM hs WHERE len(ma) > 0),
h AS (SELECT doc_id, x, m, (sum(g + length(m)) OVER w - length(m))::INT AS s, (sum(g + length(m)) OVER w)::INT AS e FROM hx WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), length(x))::INT AS z FROM h)
SELECT doc_id, regexp_extract(m, '(\\d\\.\\d{{2}})', 1) AS item, e AS "start", z AS "end", md5(trim(substr(x, e + 1, z - e), ' ')) AS body_md5 FROM n""",
    "sentence_tense": f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array({_A}, '[.!?]+\\s+|[\\r\\n]+')) AS z FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, lower(trim(z, ' ')) AS f FROM s WHERE trim(z, ' ') <> '') SELECT {_TENSE} AS tense, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM q GROUP BY 1""",
    "explicit_changes": f"WITH t AS (SELECT doc_id, {_A} AS x FROM documents) SELECT doc_id, regexp_extract(x, '{_CONV}', 1) AS from_place, regexp_extract(x, '{_CONV}', 2) AS to_place, regexp_extract(x, '{_CONV}', 3) AS effective FROM t WHERE regexp_matches(x, '{_CONV}')",
    "financing_only": f"WITH t AS (SELECT doc_id, lower(left({_A}, 2200)) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_matches(h, 'credit agreement|senior notes|underwriting agreement|partial financing of the proposed acquisition|term loan|credit facility') AND NOT regexp_matches(h, 'agreement and plan of merger|business combination agreement') AS financing_only FROM t",
    "html_text": _PAGES + " SELECT doc_id, text_md5 FROM pg WHERE source = 'official_site'",
    "markup_text": _PAGES + " SELECT doc_id, text_md5, visible_md5, title FROM pg",
    "company_passages": f"""WITH t AS (SELECT DISTINCT doc_id, {_A} AS x, lower(trim(company)) AS n FROM documents JOIN study_companies USING (cik) WHERE text IS NOT NULL AND trim(company) <> ''),
s AS (SELECT doc_id, n, [z FOR z IN string_split(regexp_replace(x, '{P.SENTENCE_END}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) IF trim(z, ' ') <> ''] AS s FROM t),
h AS (SELECT doc_id, len(s) AS m, unnest([i FOR i IN range(1, len(s) + 1) IF contains(lower(s[i]), n)]) AS i FROM s),
w AS (SELECT *, max(least(m, i + 1)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
k AS (SELECT *, sum(CASE WHEN greatest(1, i - 1) <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM w),
g AS (SELECT doc_id, min(greatest(1, i - 1))::INT AS f, max(least(m, i + 1))::INT AS l FROM k GROUP BY doc_id, k)
SELECT g.doc_id, f AS "first", l AS "last", md5(array_to_string([trim(z, ' ') FOR z IN s.s[f:l]], ' ')) AS passage_md5 FROM g JOIN s USING (doc_id)""",
    "document_hosts": r"""WITH t AS (SELECT doc_id, 'www.' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '.co.uk' AS h FROM documents WHERE title IS NOT NULL), u AS (SELECT doc_id, CASE WHEN regexp_matches(h, '^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]{1,62}$') AND length(h) <= 253 THEN h END AS host FROM t)
SELECT doc_id, host, regexp_replace(host, '^www\.', '') AS domain FROM u""",
    "certificate_fields": _CERT + f""" SELECT s_suppkey, regexp_extract(t, '{_MERGE}', 1) AS merging, trim(regexp_extract(t, '{_MERGE}', 2)) AS into_name, regexp_extract(t, 'name of the surviving corporation is ([A-Z][A-Za-z0-9&. -]+?), a', 1) AS survivor, strftime(strptime(regexp_extract(t, 'effective on ([A-Z][a-z]+ \\d{{1,2}}, \\d{{4}})', 1), '%B %d, %Y'), '%Y-%m-%d') AS effective_date FROM m""",
    "gazetteer_hits": f"""WITH k AS (SELECT {sql_fold('legal_name')} AS name, min(lei) AS name_id FROM (SELECT upper(trim(lei)) AS lei, trim(legal_name) AS legal_name FROM lei_entities WHERE trim(lei) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(lei)) ORDER BY record_id DESC) = 1) GROUP BY 1),
k2 AS (SELECT *, len(string_split(name, ' ')) AS n, array_to_string(string_split(name, ' ')[1:2], ' ') AS two FROM k WHERE len(string_split(name, ' ')) >= 2), w AS (SELECT doc_id, string_split({sql_fold('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2), f AS (SELECT doc_id, i AS position, n, name_id, name FROM p JOIN k2 ON array_to_string(w[i:i + 1], ' ') = two AND array_to_string(w[i:i + n - 1], ' ') = name),
g AS (SELECT *, max(position + n) OVER (PARTITION BY doc_id ORDER BY position, n, name_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f), g2 AS (SELECT *, sum(CASE WHEN position < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY position, n, name_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
g3 AS (SELECT doc_id, run, list_sort(list(struct_pack(o := -length(name), p := position, k := name_id, n := n))) AS hs FROM g2 GROUP BY 1, 2),
g4 AS (SELECT doc_id, unnest(list_reduce(hs, lambda got, x: CASE WHEN len([y FOR y IN got IF x[1].p < y.p + y.n AND y.p < x[1].p + x[1].n]) = 0 THEN list_concat(got, x) ELSE got END, [])) AS z FROM (SELECT doc_id, [[h] FOR h IN hs] AS hs FROM g3)) SELECT doc_id, z.p::INT AS position, z.k AS name_id FROM g4""",
    "ensemble_vote": f"WITH v AS (SELECT DISTINCT cik, form_type, {sql_fold('subsidiary_name')} AS name FROM edgar_subsidiaries) SELECT cik, name, sum({_FORM_W}) AS votes FROM v WHERE cik IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2 HAVING sum({_FORM_W}) >= 1.0",
    "alias_argmax": f"WITH v AS (SELECT cik, {sql_fold('subsidiary_name')} AS k, trim(subsidiary_name) AS name, count(*) AS n FROM edgar_subsidiaries GROUP BY 1, 2, 3) SELECT cik, k, arg_max(name, (n, name)) AS name, max(n) AS n FROM v WHERE k IS NOT NULL AND cik IS NOT NULL GROUP BY 1, 2",
    "prf_macro_micro": _LABELS + """, p AS (SELECT reviewer, count_if(abusive = 1 AND truth) AS tp, count_if(abusive = 1 AND NOT truth) AS fp, count_if(abusive <> 1 AND truth) AS fn FROM r GROUP BY 1), b AS (SELECT * FROM p UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM p),
z AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM b), y AS (SELECT reviewer, tp, fp, fn, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM z)
SELECT reviewer, tp, fp, fn, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1 FROM y UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(p), 9), round(avg(r), 9), round(avg(f), 9) FROM y WHERE reviewer <> 'micro'""",
    "wilson_recall": _LABELS + """, p AS (SELECT reviewer, count_if(truth)::DOUBLE AS n, count_if(truth AND abusive = 1)::DOUBLE AS hits FROM r GROUP BY 1), z AS (SELECT *, 1.96::DOUBLE AS z, hits / n AS q FROM p)
SELECT reviewer, hits, n, round(CASE WHEN n > 0 THEN greatest(0.0, (q + z * z / (2 * n) - sqrt(q * (1 - q) / n + z * z / (4 * n * n)) * z) / (1 + z * z / n)) ELSE 0.0 END, 9) AS low, round(CASE WHEN n > 0 THEN least(1.0, (q + z * z / (2 * n) + sqrt(q * (1 - q) / n + z * z / (4 * n * n)) * z) / (1 + z * z / n)) ELSE 1.0 END, 9) AS high FROM z""",
    "stage_counts": _FUNNEL + " " + " UNION ALL ".join(f"SELECT '{s}' AS stage, count_if({s}) AS n_true, count_if(NOT {s}) AS n_false, count_if({s} IS NULL) AS n_unknown FROM f" for s in STAGES),
    "deepest_stage": _FUNNEL + " SELECT CASE " + " ".join("WHEN " + " AND ".join(f"coalesce({s}, false)" for s in STAGES[:i]) + f" THEN '{STAGES[i - 1]}'" for i in range(len(STAGES), 0, -1)) + " ELSE 'NONE' END AS deepest, count(*) AS n FROM f GROUP BY 1",
    "pipeline_rollup": _FUNNEL + " SELECT cik, " + ", ".join(f"bool_or({s}) AS {s}" for s in STAGES) + " FROM f GROUP BY 1",
    "saturation_curve": """WITH r AS (SELECT cik, year(published_at)::INT AS y FROM documents WHERE published_at IS NOT NULL), f AS (SELECT cik, min(y) AS y FROM r WHERE cik IS NOT NULL GROUP BY 1), n AS (SELECT y, count(*) AS n FROM f GROUP BY 1), s AS (SELECT DISTINCT y FROM r), z AS (SELECT s.y, coalesce(n.n, 0) AS n_new FROM s LEFT JOIN n USING (y))
SELECT y AS "year", n_new, (sum(n_new) OVER (ORDER BY y))::BIGINT AS n_so_far FROM z""",
    "filing_disposition": _FILINGS + " SELECT form_type, disposition, count(*) AS n FROM fl GROUP BY 1, 2",
    "coverage_grouping_sets": _FILINGS + " SELECT form_type, disposition, count(*) AS n, count(DISTINCT cik) AS n_ciks FROM fl GROUP BY GROUPING SETS ((form_type), (disposition), ())",
    "coverage_pivot": _FILINGS + ", p AS (SELECT cik, " + ", ".join(f"count_if(form_type = '{f}') AS n_{f.lower().replace('-', '')}" for f in ("10-K", "20-F", "6-K", "8-K", "EX-21")) + " FROM fl WHERE cik IS NOT NULL GROUP BY 1) SELECT * FROM p UNION ALL SELECT 'TOTAL', sum(n_10k)::BIGINT, sum(n_20f)::BIGINT, sum(n_6k)::BIGINT, sum(n_8k)::BIGINT, sum(n_ex21)::BIGINT FROM p",
}
