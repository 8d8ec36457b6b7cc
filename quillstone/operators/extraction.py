"""Organizations, their short names and events in prose, sentence by sentence, and the vote of several recognizers.

Needs offsets within a text, which SQL functions don't give; texts go through Arrow batches whole. A recognizer is a function
from a text to mentions; the set is open. One that is asked for and not there is an error, never silently left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import folded_letters

# Corporate suffixes that end an organization's name in prose
SUFFIXES = ("Incorporated", "Corporation", "Aktiengesellschaft", "Limited", "Company", "L.L.C.", "L.L.P.", "P.L.C.", "L.P.", "S.A.", "S.L.", "B.V.", "N.V.", "K.K.", "G.K.", "GmbH & Co. KG", "Pte. Ltd.", "S.a r.l.", "Corp.", "Inc.", "Ltd.", "Co.", "Ltda.", "Corp", "Inc", "LLC", "LLP", "PLC", "Ltd", "GmbH", "SARL", "SAS", "DAC", "AG", "AB", "LP", "SA")
# What isn't an organization although it looks like one
NOT_ORGANIZATIONS = ("section ", "article ", "item ", "form ", "rule ", "schedule ", "general corporation law", "merger agreement", "credit agreement", "senior notes", "board of directors")
# Weight of each recognizer's vote, and the least sum that counts
WEIGHTS = {"grammar": 0.5, "definitions": 1.25, "registry": 1.5}
THRESHOLD = 1.5


@dataclass(frozen=True)
class Mention:
    name: str
    end: int
    aliases: tuple[str, ...] = ()


_WORD = r"[A-Z][\w&'’-]*"
_ORG = re.compile(rf"\b({_WORD}(?:[ \t]+(?:{_WORD}|of|and|the|for|&|No\.|\d+)){{0,7}}?,?[ \t]+(?:{'|'.join(map(re.escape, SUFFIXES))}))(?![\w])")
_FORM = re.compile(rf"\b({_WORD}(?:[ \t]+{_WORD}){{0,5}}),[ ]+an?[ ]+(?:[A-Za-z-]+[ ]+){{0,3}}(?:corporation|company|partnership|entity)\b")
_DEFINED = re.compile(r"[\"“”]\s*(?:the\s+)?([^\"“”]{2,60}?)\s*[\"“”]", re.I)
_AFTER = re.compile(r"\s*(?:,[^()]{0,150})?\(([^()]{1,220})\)")


def _tidy(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip(" ,;")


def _named_by(text: str, end: int) -> tuple[str, ...]:
    m = _AFTER.match(text, end, min(len(text), end + 260))
    return tuple(_tidy(x) for x in _DEFINED.findall(m.group(1))) if m else ()


def is_organization(name: str) -> bool:
    low = name.lower().strip()
    return low not in ("the company", "company", "the corporation", "corporation") and not low.endswith((" the company", " the corporation")) and not any(x in low for x in NOT_ORGANIZATIONS)


def by_grammar(text: str) -> Iterator[Mention]:
    """Capitalized words up to a corporate suffix, or before the statement of a legal form."""
    for pattern in (_ORG, _FORM):
        for m in pattern.finditer(text):
            name = _tidy(m.group(1))
            if name not in SUFFIXES:
                yield Mention(name, m.end(1), _named_by(text, m.end(1)))


def by_definitions(text: str) -> Iterator[Mention]:
    """Only mentions that the text itself gives a short name."""
    return (m for m in by_grammar(text) if m.aliases)


RECOGNIZERS: dict[str, Callable[[str], Iterator[Mention]]] = {"grammar": by_grammar, "definitions": by_definitions}


def mentions(docs: DataFrame, text: str, recognizers: tuple[str, ...] = ("grammar", "definitions")) -> DataFrame:
    """(doc_id, recognizer, name, alias) with repeated mentions once; alias is null where none is given. An unknown recognizer raises."""
    use = {n: RECOGNIZERS[n] for n in recognizers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, f in use.items():
                    seen = {(m.name, a) for m in f(t or "") if is_organization(m.name) for a in (m.aliases or (None,))}
                    out += [(doc, n, name, a) for name, a in sorted(seen, key=lambda x: (x[0], x[1] or ""))]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "recognizer", "name", "alias"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, recognizer string, name string, alias string")


_TOKEN = re.compile(r"&|[a-z0-9](?:[’'`]*[a-z0-9])*")
_DOTTED = tuple(x for x in SUFFIXES if x.endswith("."))


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``fold_name`` stand in the text itself."""
    if text.isascii():
        return [m.span() for m in _TOKEN.finditer(text.lower())]
    letters, origin = [], []
    for i, c in enumerate(text):
        for f in c.lower() if c.isascii() else folded_letters(c):
            letters.append(f)
            origin.append(i)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _TOKEN.finditer("".join(letters))]


def registry_mentions(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """Registry names standing in texts as mentions of the recognizer ``registry``, as the text writes them, along with their short names.

    ``found``: (doc_id, position, n_words) of names in the folded words of a text, as ``regions.phrase_hits`` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple] = set()
            for doc, t, hits in zip(*(c.to_pylist() for c in b.columns)):
                at = _word_spans(t)
                for h in hits:
                    start, end = at[h["position"] - 1][0], at[h["position"] + h["n_words"] - 2][1]
                    if t[start : end + 1].endswith(_DOTTED):
                        end += 1
                    if is_organization(name := _tidy(t[start:end])):
                        out |= {(doc, "registry", name, a) for a in _named_by(t, end) or (None,)}
            cols = list(zip(*sorted(out, key=lambda x: (x[0], x[2], x[3] or "")))) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "recognizer", "name", "alias"])

    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("position", "n_words")).alias("hits"))
    return docs.select("doc_id", text).join(by_doc, "doc_id").mapInArrow(run, "doc_id bigint, recognizer string, name string, alias string")


def fuse(votes: DataFrame, weights: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, name, votes): names whose recognizers' weights reach ``threshold``; an unknown recognizer counts 1. ``votes``: (doc_id, recognizer, name)."""
    w = F.create_map(*(F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv))
    once = votes.select("doc_id", "recognizer", "name").distinct()
    return once.groupBy("doc_id", "name").agg(F.sum(F.coalesce(F.element_at(w, F.col("recognizer")), F.lit(1.0))).alias("votes")).where(F.col("votes") >= threshold)


def fuse_aliases(votes: DataFrame, fused: DataFrame, weights: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, alias, name): each short name's organization by the highest vote, the last by name among equals, if that one or its vote counts."""
    w = F.create_map(*(F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv))
    once = votes.where("alias is not null").select("doc_id", "recognizer", "name", "alias").distinct()
    sums = once.groupBy("doc_id", "alias", "name").agg(F.sum(F.coalesce(F.element_at(w, F.col("recognizer")), F.lit(1.0))).alias("v"))
    best = sums.groupBy("doc_id", "alias").agg(F.max(F.struct("v", "name")).alias("b")).select("doc_id", "alias", "b.v", "b.name")
    known = fused.select("doc_id", "name", F.lit(True).alias("ok"))
    return best.join(known, ["doc_id", "name"], "left").where(F.coalesce("ok", F.lit(False)) | (F.col("v") >= threshold)).select("doc_id", "alias", "name")


# Rules of events: (rule, type, status, pattern). S and O are the places of subject and object, each a known name, short name or "we".
RULES = (
    ("MERGER_AGREEMENT", "AGREED_TO_ACQUIRE", "COMPLETED", r"S(?: \([^)]*\))?,? entered into an? (?:\w+ ){0,2}(?:agreement and plan of merger|transaction agreement|business combination agreement)(?: \w+){0,3}? (?:with|among) O"),
    ("AGREEMENT_NARRATIVE", "AGREED_TO_ACQUIRE", "COMPLETED", r"S entered into an? (?:[\w-]+ ){0,2}agreement (?:[\w-]+ ){0,4}to (?:acquire|purchase) (?:(?:100 ?%|all) of the [\w ]+? of )?O"),
    ("ANNOUNCED_PURCHASE", "AGREED_TO_ACQUIRE", "COMPLETED", r"S (?:today )?announced that it will (?:buy|acquire|purchase) O"),
    ("COMPLETED_ACQUISITION", "ACQUIRED", "COMPLETED", r"S(?: \([^)]*\))? completed (?:its|the) (?:previously[ -]announced )?acquisition (?:\([^)]*\) )?of O"),
    ("ACQUISITION_NARRATIVE", "ACQUIRED", "COMPLETED", r"S (?:has |have )?acquired (?:(?:\d[\d.,]* ?(?:%|per cent)|all) of (?:the )?(?:[\w-]+ ){0,4}of )?O"),
    ("MERGED_WITH_INTO", "MERGED_INTO", "TENSE", r"S (?:will be |will |was )?merged? with and into O"),
    ("SUBSIDIARY_RELATION", "SUBSIDIARY_OF", "TENSE", r"S (?:surviving|continuing|survived)[^.;]{0,160}?(?:wholly|direct|indirect)[\w -]*subsidiary of O"),
    ("ASSET_SALE_DIVESTITURE", "DIVESTED_BUSINESS", "TENSE", r"S (?:agreed to sell|sold|divested)[^.;]{2,120}? to O"),
    ("CORPORATE_CONVERSION", "CONVERTED_TO", "TENSE", r"S converted from an? [\w .-]{2,40}? to an? (?P<form>[\w .-]{2,40}? (?:corporation|company|partnership))"),
    ("RENAMING", "RENAMED_TO", "COMPLETED", r"S changed its name (?:from O )?to (?P<new>[A-Z\x02][^.;]{2,80})"),
)
SELF = ("we", "the registrant", "the company")


_ANCHOR = re.compile(r"acqui|agreement|announced that|with and into|subsidiary of|converted from|changed its name|agreed to sell|\bsold\b|divested", re.I)
_COMPILED = [(rule, kind, status, re.compile(re.sub(r"\bS\b", lambda _: "(?:[Tt]he )?\x02(?P<s>\\d+)\x03", re.sub(r"\bO\b", lambda _: "(?:[Tt]he )?\x02(?P<o>\\d+)\x03", pattern, count=1), count=1))) for rule, kind, status, pattern in RULES]


def _events(text: str) -> Iterator[tuple]:
    """Names, short names and words for the registrant become numbered marks; the rules then run over the marked text."""
    if not _ANCHOR.search(text):
        return
    found = {m.name: m for m in by_grammar(text) if is_organization(m.name)}
    known = {n: n for n in found} | {a: n for n, m in found.items() for a in m.aliases}
    words = sorted(known, key=len, reverse=True)
    who = "|".join([*(re.escape(k) for k in words), *(f"(?i:{re.escape(s)})" for s in SELF)])
    owners: list[str] = []

    def mark(m: re.Match) -> str:
        owners.append(known.get(m.group(0), "REGISTRANT_SELF_REFERENCE"))
        return f"\x02{len(owners) - 1}\x03"

    marked = re.sub(rf"(?<!\w)(?:{who})(?!\w)", mark, text.replace("\x02", " ").replace("\x03", " "))
    name = lambda i: owners[int(i)] if i else None
    undone = lambda t: _tidy(re.sub(r"\x02(\d+)\x03", lambda m: owners[int(m.group(1))], t))
    for rule, kind, status, p in _COMPILED:
        for m in p.finditer(marked):
            g = m.groupdict()
            subject, other = name(g.get("s")), g.get("form") or g.get("new") or name(g.get("o"))
            if not subject or not other or subject == other:
                continue
            state = status if status != "TENSE" else "PROPOSED" if re.search(r"\bwill\b|\bwould\b|\bagreed to\b", m.group(0)) else "COMPLETED"
            yield kind, _tidy(subject), undone(other), state, rule


def deal_events(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, event_type, subject, object, status, rule, lifecycle): one row an event; repeated ones once.

    Where a text says that X became a subsidiary of Y, an acquisition of Y by X is turned round. A subsidiary that the same
    text merges away is TRANSIENT.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple] = set()
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = set(_events(t or ""))
                under = {(s, o) for k, s, o, _, _ in rows if k == "SUBSIDIARY_OF"}
                gone = {s for k, s, _, st, _ in rows if k == "MERGED_INTO" and st == "COMPLETED"}
                for k, s, o, st, rule in rows:
                    if k in ("AGREED_TO_ACQUIRE", "ACQUIRED") and (s, o) in under:
                        s, o = o, s
                    out.add((doc, k, s, o, st, rule, "TRANSIENT" if k == "SUBSIDIARY_OF" and st == "COMPLETED" and s in gone else "FINAL"))
            cols = list(zip(*sorted(out))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "event_type", "subject", "object", "status", "rule", "lifecycle"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, event_type string, subject string, object string, status string, rule string, lifecycle string")


def completed_only(events: DataFrame) -> DataFrame:
    return events.where("status = 'COMPLETED' and lifecycle <> 'TRANSIENT'")
