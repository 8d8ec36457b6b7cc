"""Company names, registration numbers, jurisdictions and places as compared across sources."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Legal forms, as (class, ways of writing without dots)
LEGAL_FORMS = {
    "gmbhcokg": "gmbh and co kg|gmbh und co kg|gmbh co kg|gmbhcokg",
    "gmbh": "gesellschaft mit beschraenkter haftung|gesellschaft mit beschrankter haftung|g m b h|gmbh|mbh",
    "ag": "aktiengesellschaft|ag",
    "sarl": "societe a responsabilite limitee|s a r l|sa rl|s arl|sarl",
    "sas": "societe par actions simplifiee|s a s|sas",
    "sa": "societe anonyme|sociedad anonima|s a|sa",
    "sl": "sociedad limitada|s l|sl",
    "bv": "besloten vennootschap|b v|bv",
    "nv": "naamloze vennootschap|n v|nv",
    "ab": "aktiebolag publ|ab publ|aktiebolag|ab",
    "kk": "kabushiki kaisha|k k|kk",
    "gk": "godo kaisha|g k|gk",
    "ltda": "limitada|ltda",
    "dac": "designated activity company|d a c|dac",
    "plc": "public limited company|p l c|plc",
    "llp": "limited liability partnership|l l p|llp",
    "llc": "limited liability company|l l c|llc",
    "lp": "limited partnership|l p|lp",
    "pteltd": "pte ltd|private limited|pte limited|pvt ltd",
    "coltd": "co ltd|company limited|co limited",
    "ltd": "limited|ltd",
    "inc": "incorporated|inc",
    "corp": "corporation|corp",
}
# Business words, as (word, other ways of writing)
BUSINESS_WORDS = {
    "services": "service svcs svc servs", "international": "intl", "partners": "partner ptnrs", "technologies": "technology tech techs technol", "networks": "network netwks", "holdings": "holding hldgs hldg",
    "capital": "cap", "trading": "trdg trad", "realestate": "", "logistics": "logistic logist", "systems": "system sys", "insurance": "ins insur", "finance": "fin financial", "materials": "material matls",
    "industries": "industry inds ind", "ventures": "venture", "media": "", "marine": "", "pharma": "pharmaceuticals pharmaceutical", "robotics": "robotic", "foods": "food", "energy": "energies", "retail": "",
    "security": "securities sec", "rnd": "", "group": "grp", "corporation": "", "telecom": "telecommunications", "semiconductors": "semiconductor", "management": "mgmt", "manufacturing": "mfg", "solutions": "solution", "investments": "investment", "properties": "property", "consulting": "", "global": "", "enterprises": "enterprise", "resources": "resource", "products": "product", "development": "", "company": "co",
}
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
# Jurisdictions by their ways of writing
PLACES = {
    "DE": "germany deutschland federalrepublicofgermany", "GB": "gb uk unitedkingdom englandandwales england greatbritain scotland wales", "FR": "fr france frenchrepublic republiquefrancaise", "NL": "nl netherlands thenetherlands holland nederland",
    "LU": "lu luxembourg grandduchyofluxembourg luxemburg", "IE": "ie ireland republicofireland eire", "JP": "jp japan nippon", "ES": "es spain espana kingdomofspain", "SG": "sg singapore republicofsingapore", "SE": "se sweden sverige kingdomofsweden",
    "BR": "br brazil brasil federativerepublicofbrazil", "US": "us usa unitedstates unitedstatesofamerica", "CA": "canada", "US-DE": "usde delaware delawareusa stateofdelaware delus", "US-NY": "usny newyork stateofnewyork ny newyorkusa", "US-CA": "usca california calif stateofcalifornia californiausa",
    "CA-ON": "caon ontario ontariocanada on", "CA?": "ca", "DE?": "de", "CH": "ch switzerland", "IT": "it italy italia", "BE": "be belgium", "AT": "at austria osterreich", "DK": "dk denmark", "NO": "no norway", "FI": "fi finland", "CN": "cn china", "HK": "hk hongkong", "IN": "in india", "AU": "au australia", "MX": "mx mexico", "KR": "kr southkorea korea", "PL": "pl poland", "PT": "pt portugal",
}

_WORD = {w: k for k, v in BUSINESS_WORDS.items() for w in (k, *v.split())}
_PLACE = {w: k for k, v in PLACES.items() for w in v.split()}
_FORM = {w: (i, k) for i, (k, v) in reversed(list(enumerate(LEGAL_FORMS.items()))) for w in v.split("|")}
_LONGEST = max(len(w.split()) for w in _FORM)


def fold(text: str) -> str:
    """Lower case without accents; ß as ss, æ and ø as ae and o."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("æ", "ae").replace("ø", "o").replace("Ø", "O").replace("Æ", "AE"))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


@lru_cache(100_000)
def parse_name(name: str) -> tuple[tuple[str, ...], str, str, str]:
    """(brand words in order, business words, ordinal, legal form); empty strings where there are none."""
    t = fold(name).replace("’", "'")
    if "/" in t or "(" in t or "*" in t:
        t = re.sub(r"/\s*[a-z]{2,3}\s*/|\(dormant[^)]*\)|\((?:fka|formerly)[^)]*\)|\*", " ", t)
    if "&" in t or "research" in t:
        t = re.sub(r"\br\s*&\s*d\b|research (?:and|&) development", " rnd ", t)
    if "real" in t or "e." in t or " re " in t or " r e " in t:
        t = re.sub(r"real[ -]estate|\br\.? ?e\.(?=[ ,])|(?<= )r ?e(?= )", " realestate ", t)
    if " main" in t or " head" in t:
        t = re.sub(r"\s-\s(?:main|head office)\s*$", " ", t)
    t = t.replace("&", " and ").replace(".", " ").replace("int'l", "intl").replace("'", "")
    t = " " + re.sub(r"[^a-z0-9]+", " ", t).strip() + " "
    t = re.sub(r"^ the ", " ", t)
    words, form = t.split(), ""
    found = [(*_FORM[tail], n) for n in range(1, min(_LONGEST, len(words)) + 1) if (tail := " ".join(words[-n:])) in _FORM]
    if found:
        _, form, n = min(found)
        words = words[:-n]
    brand, business, ordinal = [], [], ""
    for i, w in enumerate(words):
        if w in ("no", "nr", "number", "and", "of") and brand:
            continue
        if w.isdigit():
            ordinal = w.lstrip("0") or "0"
        elif w in ROMAN and i >= 2:
            ordinal = ROMAN[w]
        elif w in _WORD and brand:
            business.append(_WORD[w])
        else:
            brand.append(w)
    return tuple(brand), " ".join(business), ordinal, form


def place_code(text: str | None) -> str:
    """Code of a jurisdiction: a country, a state as US-DE, ``CA?`` and ``DE?`` where Canada or California, Germany or Delaware may be meant, '' unknown."""
    if not text:
        return ""
    t = re.sub(r"[^a-z]+", "", fold(text))
    return _PLACE.get(t, text.strip().upper() if re.fullmatch(r"\s*[A-Za-z]{2}(-[A-Za-z0-9]{1,3})?\s*", text) else "")


def registration_key(text: str | None) -> str:
    """Letters and digits of a registration number without a leading "No." and leading zeros; '' when it only fills the field."""
    if not text:
        return ""
    t = re.sub(r"[^A-Z0-9]+", "", re.sub(r"^\s*(NO|NR|NUMBER)\b\.?", "", text.upper()))
    digits = re.sub(r"\D", "", t)
    if len(digits) < 4 or len(set(digits)) == 1:
        return ""
    return re.sub(r"\d.*", "", t) + digits.lstrip("0")
