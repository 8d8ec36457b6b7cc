"""Normalization and comparison of names, addresses and jurisdictions over whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.tables import table


def fold_name_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lei_entities", "record_id", "legal_name").select("record_id", T.fold_ascii(F.col("legal_name")).alias("folded"))


def fold_name_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lei_entities", "record_id", "legal_address_city").select("record_id", T.fold_name(F.col("legal_address_city")).alias("folded"))


def suffix_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lei_entities", "record_id", "legal_name").select("record_id", T.strip_suffixes(T.fold_name(F.col("legal_name"))).alias("base_name"))


def resolver_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_candidates", "candidate_id", "legal_name").select("candidate_id", T.resolver_name(F.col("legal_name")).alias("compared"))


def identity_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edgar_subsidiaries", "row_id", "subsidiary_name").select("row_id", T.identity_key(F.col("subsidiary_name")).alias("identity"))


def address_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_candidates", "candidate_id", "legal_address").where("legal_address is not null")
    return rows.select("candidate_id", T.address_key(F.concat_ws(" ", F.array_join("legal_address.lines", " "), "legal_address.city", "legal_address.country")).alias("address_key"))


def jurisdiction_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_candidates", "candidate_id", "jurisdiction").select("candidate_id", T.jurisdiction_code(F.col("jurisdiction")).alias("code"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    """Records with raw, normalized and base names, and the entity key: what resolution adds, nothing taken away."""
    rows = table(spark, d, "entity_candidates", "candidate_id", "legal_name", "other_names", "jurisdiction")
    name, place = T.fold_name(F.col("legal_name")), T.jurisdiction_code(F.col("jurisdiction"))
    rows = rows.withColumns({"name_normalized": name, "base_name": T.strip_suffixes(name), "place": place, "former": F.filter(F.transform("other_names", T.fold_name), lambda x: x.isNotNull())})
    return rows.withColumn("entity_key", T.stable_id("ent", F.col("name_normalized"), F.col("place")))


def normalize_entities(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("candidate_id", "legal_name", "name_normalized", "base_name", "place", "entity_key", F.coalesce(F.size("former"), F.lit(0)).cast("bigint").alias("n_former"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Keys held by several records. A key with very many rows is aggregated before the exchange; only counts and ends come out."""
    keyed = _normalized(spark, d).groupBy("entity_key").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id"), F.max("candidate_id").alias("last_id"))
    return keyed.where("n > 1")


def relationship_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationships", "id", "child_lei", "parent_lei", "relationship_type")
    return rows.select("id", T.stable_id("rel", F.col("child_lei"), F.col("relationship_type"), F.col("parent_lei")).alias("rel_key"))


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_packets", "packet_id", "candidate_a", "candidate_b")
    rows = rows.select("packet_id", T.fold_name(F.col("candidate_a.canonical_name")).alias("a"), T.fold_name(F.col("candidate_b.canonical_name")).alias("b"))
    return rows.select("packet_id", T.levenshtein_ratio(F.col("a"), F.col("b")).alias("levenshtein_ratio"), T.token_jaccard(F.col("a"), F.col("b")).alias("token_jaccard"))


def name_similarity_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Registry names against the first word of a studied company, for names that share that word: blocked on it, not crossed."""
    queries = table(spark, d, "study_companies", "company_id", "company").select("company_id", F.split(T.fold_name(F.col("company")), " ")[0].alias("query"))
    names = table(spark, d, "lei_entities", "record_id", "legal_name").select("record_id", T.fold_name(F.col("legal_name")).alias("name")).where("name is not null")
    hits = names.withColumn("query", F.explode(F.array_distinct(F.split("name", " ")))).join(queries, "query")
    return hits.select("company_id", "record_id", T.name_likeness(F.col("query"), F.col("name")).alias("likeness"))


def issuer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents' titles resolved to a studied company by equal identity key; the smallest company id wins."""
    known = table(spark, d, "study_companies", "company_id", "company", "cik").withColumn("k", T.identity_key(F.col("company"))).where("k <> ''").groupBy("k").agg(F.min("company_id").alias("company_id"), F.min_by("cik", "company_id").alias("company_cik"))
    docs = table(spark, d, "documents", "doc_id", "title").withColumn("k", T.identity_key(F.col("title"))).where("k <> ''")
    return docs.join(known, "k").select("doc_id", "company_id", "company_cik")


QUERIES = {f.__name__: f for f in (fold_name_ascii, fold_name_unicode, suffix_strip, resolver_name, identity_key, address_normalize, jurisdiction_alias, normalize_entities, duplicate_groups, relationship_key, pair_similarity, name_similarity_tiers, issuer_lookup)}


def _sql_words(lowered: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(replace({lowered}, '&', ' and '), '[’''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"


def sql_decomposed(c: str) -> str:
    out = f"lower(strip_accents({c}))"
    for joined, letters in {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "™": "tm"}.items():  # strip_accents takes no joined forms apart
        out = f"replace({out}, '{joined}', '{letters}')"
    return out


def sql_fold(c: str) -> str:
    return _sql_words(sql_decomposed(c))


def sql_fold_ascii(c: str) -> str:
    return _sql_words(f"lower({c})")


def sql_base(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '(?:(?:\\s+|^)(?:{'|'.join(T.LEGAL_SUFFIXES)})\\.?)+$', '')), '')"


def _sql_map(values: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def sql_place(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN coalesce({_sql_map(T.JURISDICTIONS, f'''trim(regexp_replace({sql_decomposed(c)}, '[^a-z0-9]+', ' ', 'g'))''')}, trim({c})) END"


def sql_identity(c: str) -> str:
    a = f"regexp_replace(coalesce({c}, ''), '\\s*/[A-Za-z]{{1,6}}\\.?/?\\s*$', '')"
    b = f"trim(regexp_replace(regexp_replace(lower({a}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    e = f"regexp_replace(regexp_replace({b}, '^the\\s+', ''), '\\b({T.IDENTITY_WORDS})\\.?\\b', '', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def sql_id(prefix: str, *parts: str, digits: int = 24) -> str:
    return f"'{prefix}:' || left(sha256(" + " || '|' || ".join(f"coalesce(trim({p}), '')" for p in parts) + f"), {digits})"


_FORMS = "|".join(sorted(T.RESOLVER_FORMS, key=len, reverse=True))
_NORM = f"""WITH n AS (SELECT candidate_id, legal_name, other_names, {sql_fold("legal_name")} AS name_normalized, {sql_place("jurisdiction")} AS place FROM entity_candidates),
m AS (SELECT *, {sql_base("name_normalized")} AS base_name, {sql_id("ent", "name_normalized", "place")} AS entity_key FROM n)"""
_RATIO = "CASE WHEN length(a) > 0 AND length(b) > 0 THEN 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END"
_JACCARD = "CASE WHEN length(trim(a)) > 0 AND length(trim(b)) > 0 THEN len(list_intersect(list_distinct(regexp_split_to_array(trim(a), '\\s+')), list_distinct(regexp_split_to_array(trim(b), '\\s+'))))::DOUBLE / len(list_distinct(list_concat(regexp_split_to_array(trim(a), '\\s+'), regexp_split_to_array(trim(b), '\\s+')))) END"

ORACLE = {
    "fold_name_ascii": f"SELECT record_id, {sql_fold_ascii('legal_name')} AS folded FROM lei_entities",
    "fold_name_unicode": f"SELECT record_id, {sql_fold('legal_address_city')} AS folded FROM lei_entities",
    "suffix_strip": f"SELECT record_id, {sql_base(sql_fold('legal_name'))} AS base_name FROM lei_entities",
    "resolver_name": f"""SELECT candidate_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(legal_name, '')), '&', ' and '), '\\([^)]*(?:dormant|non[- ]operational)[^)]*\\)', ' ', 'g'), '\\(fka\\s+[^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '(?:(?:^| )(?:{_FORMS}))+$', '')) AS compared FROM entity_candidates""",
    "identity_key": f"SELECT row_id, {sql_identity('subsidiary_name')} AS identity FROM edgar_subsidiaries",
    "address_normalize": f"""WITH w AS (SELECT candidate_id, unnest(string_split(trim(regexp_replace(lower(concat_ws(' ', array_to_string(legal_address.lines, ' '), legal_address.city, legal_address.country)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS t, generate_subscripts(string_split(trim(regexp_replace(lower(concat_ws(' ', array_to_string(legal_address.lines, ' '), legal_address.city, legal_address.country)), '[^a-z0-9]+', ' ', 'g')), ' '), 1) AS i FROM entity_candidates WHERE legal_address IS NOT NULL)
SELECT candidate_id, string_agg(coalesce({_sql_map(T.ADDRESS_WORDS, 't')}, t), ' ' ORDER BY i) AS address_key FROM w GROUP BY candidate_id""",
    "jurisdiction_alias": f"SELECT candidate_id, {sql_place('jurisdiction')} AS code FROM entity_candidates",
    "normalize_entities": _NORM + f""" SELECT candidate_id, legal_name, name_normalized, base_name, place, entity_key, coalesce(len([x FOR x IN other_names IF {sql_fold('x')} IS NOT NULL]), 0)::BIGINT AS n_former FROM m""",
    "duplicate_groups": _NORM + " SELECT entity_key, count(*) AS n, min(candidate_id) AS first_id, max(candidate_id) AS last_id FROM m GROUP BY entity_key HAVING count(*) > 1",
    "relationship_key": f"SELECT id, {sql_id('rel', 'child_lei', 'relationship_type', 'parent_lei')} AS rel_key FROM relationships",
    "pair_similarity": f"WITH p AS (SELECT packet_id, {sql_fold('candidate_a.canonical_name')} AS a, {sql_fold('candidate_b.canonical_name')} AS b FROM eval_packets) SELECT packet_id, {_RATIO} AS levenshtein_ratio, {_JACCARD} AS token_jaccard FROM p",
    "name_similarity_tiers": f"""WITH q AS (SELECT company_id, split_part({sql_fold('company')}, ' ', 1) AS query FROM study_companies), n AS (SELECT record_id, {sql_fold('legal_name')} AS name FROM lei_entities)
SELECT company_id, record_id, CASE WHEN name = query THEN 1.0 WHEN starts_with(name || ' ', query || ' ') THEN 0.95 ELSE 0.9 END::DOUBLE AS likeness FROM n JOIN q ON contains(' ' || name || ' ', ' ' || query || ' ')""",
    "issuer_lookup": f"""WITH k AS (SELECT {sql_identity('company')} AS k, min(company_id) AS company_id, arg_min(cik, company_id) AS company_cik FROM study_companies GROUP BY 1)
SELECT doc_id, company_id, company_cik FROM documents JOIN k ON {sql_identity('title')} = k.k WHERE k.k <> ''""",
}
