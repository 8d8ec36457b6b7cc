"""Supplied evidence: tables, JSON, vendor records, registration data, certificates, search results. Nothing is fetched."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.text import plain_bool, squeeze, url_host

# Marks of masked registration data
REDACTED = ("redacted", "privacy", "gdpr", "not disclosed", "data protected", "withheld", "masked", "on behalf of")
CSV_COLUMNS = ("entity_lei", "entity_name", "domain", "capability", "provider", "availability", "observed_value", "supports_attribution", "reference")
OBSERVATION = "entity string, domain string, provider string, capability string, availability string, observed_value string, supports boolean, reference string"


def csv_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observations and the rows that can't be used (with the reason), from CSV with a header; blanks are null, columns may come in any order."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in ("domain", "capability") if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    blank = {c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string") for c in CSV_COLUMNS}
    rows = raw.select(*(v.alias(c) for c, v in blank.items()))
    said, flag = F.col("supports_attribution"), plain_bool(F.col("supports_attribution"))
    error = F.when(F.col("domain").isNull(), "domain missing").when(F.col("capability").isNull(), "capability missing").when(said.isNotNull() & flag.isNull(), "supports_attribution unreadable").when(F.coalesce("entity_lei", "entity_name").isNull(), "entity missing")
    rows = rows.withColumn("error", error)
    good = rows.where("error is null").select(F.coalesce("entity_lei", "entity_name").alias("entity"), F.lower("domain").alias("domain"), F.coalesce("provider", F.lit("UNKNOWN")).alias("provider"), F.upper("capability").alias("capability"), F.upper(F.coalesce("availability", F.lit("PROVIDED"))).alias("availability"), "observed_value", flag.alias("supports"), "reference")
    return good, rows.where("error is not null")


_OBS = "STRUCT<capability: STRING, provider: STRING, source: STRING, availability: STRING, observed_value: STRING, value: STRING, supports_attribution: BOOLEAN, reference: STRING>"
SUPPLIED = f"STRUCT<entities: ARRAY<STRUCT<entity_lei: STRING, entity_name: STRING>>, subjects: ARRAY<STRUCT<entity_lei: STRING, entity_name: STRING, domain: STRING, observations: ARRAY<{_OBS}>>>>"


def json_evidence(documents: DataFrame) -> DataFrame:
    """Observations of supplied JSON documents (record): subjects and their observations, unfolded twice."""
    s = documents.select(F.explode(F.from_json("record", SUPPLIED)["subjects"]).alias("s")).select("s.*").select(F.coalesce("entity_lei", "entity_name").alias("entity"), F.lower("domain").alias("domain"), F.explode("observations").alias("o"))
    return s.select("entity", "domain", F.coalesce("o.provider", "o.source", F.lit("UNKNOWN")).alias("provider"), F.upper("o.capability").alias("capability"), F.upper(F.coalesce("o.availability", F.lit("PROVIDED"))).alias("availability"), F.coalesce("o.observed_value", "o.value").alias("observed_value"), F.col("o.supports_attribution").alias("supports"), F.col("o.reference").alias("reference"))


def at_path(record: str, path: str) -> Column:
    """A value of a JSON text by dotted path; a key that itself holds the dots wins over nesting."""
    return F.nullif(F.trim(F.coalesce(F.get_json_object(record, f"$['{path}']"), F.get_json_object(record, f"$.{path}"))), F.lit(""))


DEFAULT_MAPPING = {"domain": "domain", "ip": "ip", "asn": "asn", "asn_org": "asn_org", "tls_org": "tls.subject_org"}


def vendor_records(records: DataFrame, mapping: dict[str, str] | None = None, expected: str | None = None, prefix: str = "supplied") -> DataFrame:
    """Observations of vendor records (record) with fields where ``mapping`` says: owner of the network, and certificate."""
    m = DEFAULT_MAPPING | (mapping or {})
    r = records.select(*(at_path("record", p).alias(f) for f, p in m.items()))
    entity, none = F.lit(expected), F.lit(None).cast("string")
    likely = lambda c: plausible_name(c, entity) if expected else F.lit(None).cast("boolean")
    net = r.where("ip is not null or asn is not null").select(entity.alias("entity"), F.lower("domain").alias("domain"), F.lit(f"{prefix}-ip-asn").alias("provider"), F.lit("IP_ASN_OWNERSHIP").alias("capability"), _availability(F.col("asn_org")).alias("availability"), F.col("asn_org").alias("observed_value"), F.when(F.col("asn_org").isNotNull(), likely(F.col("asn_org"))).alias("supports"), F.coalesce(asn_number(F.col("asn")), "ip").alias("reference"))
    tls = r.where("domain is not null").select(entity.alias("entity"), F.lower("domain").alias("domain"), F.lit(f"{prefix}-tls").alias("provider"), F.lit("TLS_CERTIFICATE").alias("capability"), _availability(F.col("tls_org")).alias("availability"), F.col("tls_org").alias("observed_value"), F.when(F.col("tls_org").isNotNull(), likely(F.col("tls_org"))).alias("supports"), none.alias("reference"))
    return net.unionByName(tls)


def is_redacted(text: Column) -> Column:
    return F.exists(F.array(*(F.lit(m) for m in REDACTED)), lambda m: F.contains(F.lower(text), m))


def _availability(value: Column) -> Column:
    return F.when(value.isNull(), "MISSING").when(is_redacted(value), "INCONCLUSIVE").otherwise("PROVIDED")


def plausible_name(a: Column, b: Column) -> Column:
    """Folded names are equal or one holds the other; null if either is."""
    x, y = (squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")) for c in (a, b))
    return F.when(x.isNotNull() & y.isNotNull(), (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))


def asn_number(text: Column) -> Column:
    """``AS`` and the number, from 13335, AS13335 or "AS 13335"; null otherwise."""
    n = F.regexp_extract(F.upper(F.trim(text)), r"^(?:ASN?\s*)?0*(\d{1,10})$", 1)
    return F.when(n != "", F.concat(F.lit("AS"), n))


def ip_address(text: Column) -> Column:
    """Canonical form of an IPv4 or IPv6 address; null when it is none. In Arrow batches."""

    @F.pandas_udf(StringType())
    def canonical(s: pd.Series) -> pd.Series:
        import ipaddress

        def one(v):
            try:
                return str(ipaddress.ip_address(v.strip()))
            except ValueError:
                return None

        return s.map(one, na_action="ignore")

    return canonical(text)


# Keys of registration text that hold the registrant, the first with a value wins
WHOIS_ORGANIZATION = (r"Registrant\s+Organization", r"Registrant\s+Org", r"org(?:anisation|anization)?", r"Admin\s+Organization")


def whois(texts: DataFrame, expected: Column | None = None) -> DataFrame:
    """(domain, availability, observed_value, supports) of registration texts (domain, text): masked data is inconclusive, none is missing."""
    key = lambda p: F.regexp_extract("text", rf"(?im)^\s*{p}\s*:\s*(\S.*?)\s*$", 1)
    value = lambda p: F.when(~key(p).isin("", ".", "-", "N/A", "n/a"), key(p))
    found = F.coalesce(*(value(p) for p in WHOIS_ORGANIZATION), value(r"Registrant\s+Name"))
    masked = is_redacted(F.coalesce(found, F.col("text")))
    return texts.select(F.lower("domain").alias("domain"), F.when(masked, "INCONCLUSIVE").when(found.isNull(), "MISSING").otherwise("PROVIDED").alias("availability"), F.when(~masked, found).alias("observed_value"), (F.when(~masked & found.isNotNull(), plausible_name(found, expected)) if expected is not None else F.lit(None).cast("boolean")).alias("supports"))


def _card(entity: dict) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    card = entity.get("vcardArray")
    for item in card[1] if isinstance(card, list) and len(card) == 2 and isinstance(card[1], list) else []:
        if isinstance(item, list) and len(item) >= 4:
            flat = item[3] if isinstance(item[3], str) else " ".join(x for x in item[3] if isinstance(x, str)) if isinstance(item[3], list) else ""
            if flat.strip():
                out.setdefault(str(item[0]).lower(), []).append(" ".join(flat.split()))
    return out


def parse_registration(text: str | None) -> tuple | None:
    """(domain, organization, address, registered, expires, status) of an RDAP document; null when it isn't one."""
    try:
        doc = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    roles = lambda e: {str(r).lower() for r in ([e.get("roles")] if isinstance(e.get("roles"), str) else e.get("roles") or [])}
    owners = [_card(e) for e in doc.get("entities") or [] if isinstance(e, dict) and "registrant" in roles(e)]
    first = lambda *keys: next((v for c in owners for k in keys for v in c.get(k, [])), None)
    dates = {str(e.get("eventAction")): e.get("eventDate") for e in doc.get("events") or [] if isinstance(e, dict)}
    name = first("org", "fn")
    status = "MISSING" if not name else "INCONCLUSIVE" if any(m in name.lower() for m in REDACTED) else "PROVIDED"
    return str(doc.get("ldhName") or doc.get("unicodeName") or "").rstrip(".").lower() or None, name, first("adr"), dates.get("registration"), dates.get("expiration"), status


def registrations(documents: DataFrame) -> DataFrame:
    """(domain, organization, address, registered, expires, availability) of RDAP documents (record); what isn't one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in map(parse_registration, b.column(0).to_pylist()) if r]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*rows) if rows else [[]] * 6)], ["domain", "organization", "address", "registered", "expires", "availability"])

    return documents.select("record").mapInArrow(run, "domain string, organization string, address string, registered string, expires string, availability string")


class _Results(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.href, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and "result__a" in (a.get("class") or ""):
            self.href, self.text = a.get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())))
            self.href = None


def unwrapped(url: str | None) -> str | None:
    """The address behind a redirecting link of a results page; null when it isn't a web address."""
    parts = urlsplit(("https:" + url) if (url or "").startswith("//") else url or "")
    inner = parse_qs(parts.query).get("uddg")
    target = unquote(inner[0]) if inner else url
    return target if target and urlsplit(target).scheme in ("http", "https") else None


def parse_results(html: str | None, limit: int = 5) -> list[tuple[str, str]]:
    """(address, title) of a results page, the first of each address, ``limit`` at most."""
    p = _Results()
    p.feed(html or "")
    out: dict[str, str] = {}
    for href, title in p.found:
        if (u := unwrapped(href)) and u not in out:
            out[u] = title
    return list(out.items())[:limit]


def parse_feed(xml: str | None, limit: int = 5) -> list[tuple[str, str]]:
    """(address, title) of the items of a results feed."""
    from html import unescape

    out: dict[str, str] = {}
    for item in re.findall(r"<item>(.*?)</item>", xml or "", re.S):
        link, title = (re.search(rf"<{t}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>", item, re.S) for t in ("link", "title"))
        if link and unwrapped(unescape(link.group(1).strip())):
            out.setdefault(unescape(link.group(1).strip()), unescape(title.group(1).strip()) if title else "")
    return list(out.items())[:limit]


def search_results(pages: DataFrame, limit: int = 5) -> DataFrame:
    """(query, rank, url, host, title) of saved result pages (query, body), pages or feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, i, u, t) for q, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (u, t) in enumerate(parse_feed(body, limit) if "<rss" in (body or "")[:500] else parse_results(body, limit), 1)]
            c = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), pa.string()), pa.array(list(c[1]), pa.int32()), pa.array(list(c[2]), pa.string()), pa.array(list(c[3]), pa.string())], ["query", "rank", "url", "title"])

    out = pages.select("query", "body").mapInArrow(run, "query string, rank int, url string, title string")
    return out.select("query", "rank", "url", url_host(F.col("url")).alias("host"), "title")


# Marks beside a legal name by which a page declares its operator, and hosts that only refer to others
DECLARATIONS = ("copyright", "all rights reserved", "operated by", "privacy policy", "terms of use", "legal notice", "imprint", "impressum")
REFERENCE_HOSTS = ("wikipedia.org", "linkedin.com", "facebook.com", "bloomberg.com", "crunchbase.com", "youtube.com", "x.com", "twitter.com", "sec.gov", "reuters.com")


def official_site(pages: DataFrame, reach: int = 320) -> DataFrame:
    """(url, host, legal_name, is_reference, declared) of pages (url, text, legal_name): a declaration within ``reach`` characters of the name, on a host that isn't a mere reference."""
    host = url_host(F.col("url"))
    reference = F.exists(F.array(*(F.lit(h) for h in REFERENCE_HOSTS)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    fold = lambda c: squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    page, name = fold(F.col("text")), fold(F.col("legal_name"))
    gaps = F.split(page, name, -1)
    near = F.exists(F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.right(g, F.lit(reach))), lambda g: _declares(g)) | F.exists(F.transform(F.slice(gaps, 2, F.size(gaps)), lambda g: F.left(g, F.lit(reach))), lambda g: _declares(g))
    return pages.select("url", host.alias("host"), "legal_name", F.coalesce(reference, F.lit(False)).alias("is_reference"), F.coalesce((F.size(gaps) > 1) & near & ~reference, F.lit(False)).alias("declared"))


def _declares(text: Column) -> Column:
    return F.exists(F.array(*(F.lit(d) for d in DECLARATIONS)), lambda d: F.contains(text, d))
