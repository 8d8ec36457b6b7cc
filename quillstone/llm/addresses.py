"""Address records that name the same place, however written: numbers first, in SQL.

An address becomes pieces, in lower case without accents; what lies inside a building (floor, suite, room, its name, care-of lines)
is dropped. The first piece with a number at either end is the street's: its digit tokens, sorted, its kind and compass direction,
and what is left, its name, run together; another piece is the town's. Distinct forms are blocked on their digit tokens, kind
and direction plus one rare word: the street's name, the town or the postal code, where a word that is frequent in its block is
made rarer by a third of the other one (two slips leave one third of three as it was); or, where no word is left whole, on an end
of the street's name and one of the town. Of two forms that meet, the words in
common are taken by ``array_intersect``, the others are compared by Levenshtein, and the overlap, weighted by the words' rarity
in the corpus, decides. Without a town on one side the postal code decides, else that no other town competes for the same number
and street.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import decomposed
from quillstone.llm.names import PLACES
from quillstone.session import Scratch

# Kinds of streets by their ways of writing, as words and as endings of a compound
KINDS = {
    "street": "street st str", "avenue": "avenue ave av aven", "boulevard": "boulevard blvd bd bld boul bvd", "road": "road rd", "lane": "lane ln la", "drive": "drive dr drv", "square": "square sq sqr", "place": "place pl plc", "court": "court ct crt", "way": "way wy",
    "terrace": "terrace ter terr", "close": "close cl", "crescent": "crescent cres cr", "highway": "highway hwy", "parkway": "parkway pkwy", "circle": "circle cir", "row": "row", "rue": "rue r", "allee": "allee all allees", "route": "route rte", "ruelle": "ruelle rlle", "quai": "quai", "impasse": "impasse imp",
    "chemin": "chemin che ch", "cours": "cours crs", "passage": "passage pass", "strasse": "strasse", "platz": "platz", "gasse": "gasse", "ring": "ring", "damm": "damm", "weg": "weg", "ufer": "ufer", "straat": "straat", "laan": "laan", "plein": "plein", "gracht": "gracht", "kade": "kade", "calle": "calle c", "via": "via", "rua": "rua", "plaza": "plaza", "paseo": "paseo",
}
ENDINGS = {"strasse": "strasse str", "platz": "platz pl", "allee": "allee", "gasse": "gasse", "ring": "ring", "damm": "damm", "weg": "weg", "ufer": "ufer", "straat": "straat", "laan": "laan", "plein": "plein", "gracht": "gracht", "kade": "kade"}
DIRECTIONS = {"n": "n", "north": "n", "nord": "n", "s": "s", "south": "s", "sud": "s", "e": "e", "east": "e", "est": "e", "w": "w", "west": "w", "ouest": "w", "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw"}
INSIDE = r"(?:floor|fl|flr|suite|ste|unit|room|rm|apartment|apt|level|lvl|building|bldg|tower|block|wing|etage|stock|og|bureau|office|desk|mailbox|box|po box|p o box)"
BUILDINGS = "house centre center tower towers building buildings hall mansion mansions works exchange chambers court plaza park quarter campus gate point wharf".split()
SMALL_WORDS = {"de", "du", "des", "d", "la", "le", "les", "l", "del", "della", "di", "da", "do", "dos", "der", "den", "dem", "van", "von", "zum", "zur", "am", "an", "the", "of"}
TOWN_WORDS = {"saint": "st", "sankt": "st", "sint": "st", "mount": "mt", "fort": "ft", "upper": "upr", "lower": "lwr"}

KIND_OF = {w: k for k, v in KINDS.items() for w in v.split()}
ENDING_OF = {w: k for k, v in ENDINGS.items() for w in v.split()}
NATION_OF = {w: k[:2] for k, v in PLACES.items() for w in v.split()}
AMBIGUOUS = ("r", "c", "la", "ch", "all")  # short for kinds of streets only before a small word
FIELDS = ("digits", "street", "kind", "direction", "town", "postal", "nation")

_any = lambda words: "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))
NUMBER = r"\d{1,5}[a-z]?(?:/\d+)?"
# Each piece stands between bars of its own: patterns of whole pieces never share one
INSIDE_PIECE = rf"\|(?:{INSIDE}\b[^|]*|[^|]*\b\d+ ?(?:st|nd|rd|th|eme|er|e)? (?:floor|fl|flr|etage|stock)|(?:c ?/ ?o|attn|attention|care of|z ?hd|att)\b[^|]*|(?:[^|0-9]* )?(?:{_any([w for w in BUILDINGS if w not in KIND_OF])}))\|"
INSIDE_END = rf" (?:{INSIDE} ?(?:no )?[0-9]+ ?[a-z]?|\d+(?:st|nd|rd|th) (?:floor|fl))\|"
STREET_PIECE = rf"\|({NUMBER} [^|]*[a-z][^|]*|[^|0-9][^|]* {NUMBER})\|"
COMPOUND = rf"^(.{{3,}}?)({_any(ENDING_OF)})$"
LONE_NUMBER = r"\|(\d{1,5}[a-z]?)\|\|"  # "397, boulevard de X"
NUMBER_AFTER = r"\|([^|0-9]+)\|\|(\d{1,5}[a-z]?)\|"  # "X Street, 212"


def _map(values: dict[str, str]) -> Column:
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in values.items())))


def _pieces(text: Column) -> Column:
    """Pieces of a text with bars between them, each as ``|piece|``; '' for none."""
    t = F.replace(F.replace(F.replace(decomposed(F.coalesce(text, F.lit(""))), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o")), F.lit("ß"), F.lit("ss"))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9/,|]+", " "), " *[,|][ ,|]*", "||"))
    return F.regexp_replace(F.concat(F.lit("|"), t, F.lit("|")), r"\|\|\|+", "||")


def _plain(words: Column) -> Column:
    """Run together, with ae, oe and ue for a, o and u."""
    return F.regexp_replace(F.replace(words, F.lit(" "), F.lit("")), "([aou])e", "$1")


def _strip_bars(pieces: Column) -> Column:
    """Without an empty piece at either end."""
    return F.regexp_replace(F.regexp_replace(pieces, r"^\|\|(.)", "|$1"), r"(.)\|\|$", "$1|")


def parsed_addresses(rows: DataFrame, id_column: str, address: str) -> DataFrame:
    """(address_id, digits, street, kind, direction, town, postal, nation) of rows with an address; '' for what isn't there."""
    a, c = F.col(address), F.col
    t = rows.where(a.isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("address_id"), _strip_bars(_pieces(F.array_join(a["lines"], "|"))).alias("lines"), _strip_bars(_pieces(a["city"])).alias("city"),
        F.regexp_replace(decomposed(F.coalesce(a["country"], F.lit(""))), "[^a-z]+", "").alias("country"), F.regexp_replace(decomposed(F.coalesce(a["postal_code"], F.lit(""))), "[^a-z0-9]+", "").alias("code"),
    )
    t = t.withColumn("lines", F.regexp_replace(F.regexp_replace(F.regexp_replace("lines", INSIDE_PIECE, ""), INSIDE_END, "|"), INSIDE_PIECE, ""))
    t = t.withColumn("lines", F.regexp_replace(F.regexp_replace("lines", NUMBER_AFTER, "|$1 $2|"), LONE_NUMBER, "|$1 "))
    t = t.withColumn("s", F.regexp_extract("lines", STREET_PIECE, 1))
    t = t.withColumn("rest", F.filter(F.split(F.concat("city", F.when(c("s") == "", c("lines")).otherwise(F.replace("lines", F.concat(F.lit("|"), c("s"), F.lit("|")), F.lit("")))), r"\|+"), lambda p: p != ""))
    t = t.withColumn("number", F.coalesce(F.nullif(F.regexp_extract("s", f"^({NUMBER}) ", 1), F.lit("")), F.regexp_extract("s", f" ({NUMBER})$", 1)))
    t = t.withColumn("n", F.trim(F.when(F.startswith("s", F.concat("number", F.lit(" "))), F.substr("s", F.length("number") + 1)).otherwise(F.substr("s", F.lit(1), F.length("s") - F.length("number")))))

    def direction(name: str, before: Column | None) -> tuple[Column, Column]:
        first, last = F.regexp_extract(name, rf"^({_any(DIRECTIONS)}) .", 1), F.regexp_extract(name, rf". ({_any(DIRECTIONS)})$", 1)
        free = F.lit(True) if before is None else before == ""
        return F.when(free & (first != ""), first).when(free, last).otherwise(F.lit("")), F.when(free & (first != ""), F.substr(name, F.length(first) + 2)).when(free & (last != ""), F.substr(name, F.lit(1), F.length(name) - F.length(last) - 1)).otherwise(F.col(name))

    way, name = direction("n", None)
    t = t.withColumns({"d1": way, "n": name})
    last, first = F.regexp_extract("n", rf". ({_any(KIND_OF)})$", 1), F.regexp_extract("n", rf"^({_any([w for w in KIND_OF if w not in AMBIGUOUS])}) .|^({_any(AMBIGUOUS)}) (?:{_any(SMALL_WORDS)}) ", 0)
    head = F.regexp_extract(first, "^[a-z]+", 0)
    stem = F.when(~F.contains("n", F.lit(" ")), F.regexp_extract("n", COMPOUND, 1)).otherwise("")
    t = t.withColumns({"k": F.when(last != "", F.element_at(_map(KIND_OF), last)).when(head != "", F.element_at(_map(KIND_OF), head)).when(stem != "", F.element_at(_map(ENDING_OF), F.regexp_extract("n", COMPOUND, 2))).otherwise(F.lit("")),
                       "n": F.when(last != "", F.substr("n", F.lit(1), F.length("n") - F.length(last) - 1)).when(head != "", F.substr("n", F.length(head) + 2)).when(stem != "", stem).otherwise(c("n"))})
    way, name = direction("n", c("d1"))
    t = t.withColumns({"d2": way, "n": name})
    long = F.replace(F.regexp_replace(F.concat(F.lit(" "), F.replace("n", F.lit(" "), F.lit("  ")), F.lit(" ")), f" (?:{_any(SMALL_WORDS)}) ", ""), F.lit(" "), F.lit(""))
    street = F.when(long == "", F.replace("n", F.lit(" "), F.lit(""))).otherwise(long)

    letters = lambda p: F.regexp_replace(p, "[^a-z]+", "")
    has_digit = lambda p: p.rlike("[0-9]")
    place = lambda p: F.coalesce(F.element_at(_map(NATION_OF), letters(p)), F.lit(""))
    bare = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.replace(p, F.lit(" "), F.lit("  ")), F.lit(" ")), " [^ ]*[0-9][^ ]* ", " "), " +", " "))
    t = t.withColumn("towns", F.filter(F.transform("rest", lambda p: F.when(has_digit(p) | ((F.length(letters(p)) > 3) & (place(p) == "") & ~p.rlike(rf"(?:^| )(?:{_any(BUILDINGS[:6])})$")), bare(p)).otherwise("")), lambda x: x != ""))
    own = bare(F.regexp_extract("city", r"^\|([^|]*)\|", 1))  # a country's name in the town's place is the town
    town = F.coalesce(F.try_element_at("towns", F.lit(1)), F.when((F.length(letters(own)) > 3) | ((F.length(letters(own)) == 3) & (place(own) == "")), own), F.lit(""))
    town = F.concat(F.lit(" "), F.replace(F.regexp_replace(town, "(.) city$", "$1"), F.lit(" "), F.lit("  ")), F.lit(" "))
    for word, short in TOWN_WORDS.items():
        town = F.replace(town, F.lit(f" {word} "), F.lit(f" {short} "))
    codes = F.filter(F.transform("rest", lambda p: F.when(has_digit(p), F.array_join(F.filter(F.split(p, " "), has_digit), "")).otherwise("")), lambda x: x != "")
    nations = F.filter(F.transform("rest", lambda p: F.when(~has_digit(p), place(p)).otherwise("")), lambda x: x != "")
    ok = (street != "") & ~street.rlike("^[0-9]+$")
    way = F.coalesce(F.element_at(_map(DIRECTIONS), F.when(c("d1") != "", c("d1")).otherwise(c("d2"))), F.lit(""))
    out = t.select("address_id", F.when(ok, F.array_join(F.array_sort(F.split("number", "/")), "/")).otherwise("").alias("digits"), F.when(ok, _plain(street)).otherwise("").alias("street"), F.when(ok, c("k")).otherwise("").alias("kind"), F.when(ok, way).otherwise("").alias("direction"),
                    _plain(town).alias("town"), F.coalesce(F.nullif(c("code"), F.lit("")), F.try_element_at(codes, F.lit(1)), F.lit("")).alias("postal"), F.coalesce(F.element_at(_map(NATION_OF), c("country")), F.try_element_at(nations, F.lit(1)), F.lit("")).alias("nation"))
    return out.select("address_id", F.explode(F.array(F.struct(*FIELDS))).alias("x")).select("address_id", "x.*")  # so that no filter is written out through all the steps above


def _reached(towns: Column, start: Column) -> Column:
    """Those of ``towns`` that steps within the slip tolerance reach from ``start``, an array of towns."""
    return F.aggregate(towns, start, lambda got, _: F.filter(towns, lambda t: F.exists(got, lambda g: _slips(g, t))))


def _one_place(towns: Column) -> Column:
    """All towns are ways of writing one; there may be none."""
    return F.size(_reached(towns, F.slice(towns, 1, 1))) == F.size(towns)


def _settled(near: DataFrame) -> DataFrame:
    """Pairs of ``near`` that are sure, or one of which lacks the town while nothing else competes for it.

    What competes for a form without a town are the towns of the forms near it, those with an equal postal code first,
    then those with one that is a slip away, then the rest. If they are all ways of writing one town, that is the form's.
    """
    lacks = near.where("town = '' or town_b = ''")
    told = lacks.where("town = ''").select("form", F.col("town_b").alias("t"), "tier").unionByName(lacks.where("town_b = ''").select(F.col("form_b").alias("form"), F.col("town").alias("t"), "tier")).where("t <> ''")
    best = told.groupBy("form").agg(F.collect_set(F.struct("tier", "t")).alias("x")).withColumn("least", F.array_min(F.transform("x", lambda v: v["tier"])))
    towns = best.select("form", F.transform(F.filter("x", lambda v: v["tier"] == F.col("least")), lambda v: v["t"]).alias("towns"))
    none = F.array().cast("array<string>")
    open_ = lacks.where("not sure").join(towns, "form", "left").join(towns.select(F.col("form").alias("form_b"), F.col("towns").alias("towns_b")), "form_b", "left")
    rivals, own = F.array_union(F.coalesce("towns", none), F.coalesce("towns_b", none)), F.greatest("town", "town_b")
    fits = _one_place(F.col("rivals")) & ((F.col("own") == "") | F.exists("rivals", lambda t: _slips(t, F.col("own"))))
    alone = open_.select("form", "form_b", rivals.alias("rivals"), own.alias("own")).where(fits)
    return near.where("sure").select("form", "form_b").unionByName(alone.select("form", "form_b"))


HOT_BLOCK = 1_000  # forms of a block from which on its word isn't rare enough


def _piece(length: Column, i: int) -> tuple[Column, Column]:
    """(start, length) of the i-th third of a word, the later ones longer by a letter."""
    base, first_long = F.floor(length / 3).cast("int"), F.lit(3) - length % 3
    return 1 + i * base + F.greatest(F.lit(0), i - first_long), base + (i >= first_long).cast("int")


# Where a third of a word may stand in one that is 0, 1 or 2 letters longer, by at most two edits, relative to its own place:
# of three thirds two edits leave one as it was, moved by no more than the edits before it and so that those after it suffice
MOVED = (((0,), (-1, 0, 1), (0,)), ((0,), (0, 1), (1,)), ((0,), (1,), (2,)))


def kept_blocks(word: str = "street") -> Column:
    """Hashes of the thirds of a word."""
    n = F.length(word)
    return F.array_distinct(F.array(*(F.xxhash64(n, F.lit(i), F.substring(word, *_piece(n, i))) for i in range(3))))


def sought_blocks(word: str = "street") -> Column:
    """Thirds, as they would stand in this one, of all words that are as long or up to two letters shorter and at most two edits away."""
    n, keys = F.length(word), []
    for shorter, by_piece in enumerate(MOVED):
        m = n - shorter
        for i, moves in enumerate(by_piece):
            start, long = _piece(m, i)
            keys += [F.when((m >= 1) & (start + k >= 1) & (start + k + long <= n + 1), F.xxhash64(m, F.lit(i), F.substring(word, start + k, long))) for k in moves]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _met(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(form, form_b), each once: equal digits, kind and direction and one rare word in common, or, where both street and town have a slip, an end of each, or where a town lacks, an end of the street.

    A word with more than ``HOT_BLOCK`` forms in its block is made rarer by a third of the other word; forms without another word,
    few as forms, meet the whole block.
    """
    base = ("digits", "kind", "direction")
    word = lambda tag, own, other: F.when(F.col(own) != "", F.struct(F.xxhash64(*base, F.lit(tag), F.col(own)).alias("block"), F.col(other).alias("other")))
    keyed = scratch.write(forms.select("form", F.explode(F.array_compact(F.array(word("s", "street", "town"), word("t", "town", "street"), word("p", "postal", "street")))).alias("x")).select("form", "x.*"))
    hot, (n,) = scratch.write_counting(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BLOCK).select("block"), F.count(F.lit(1)))
    rare = keyed.select("block", "form") if not n else keyed.join(hot, "block", "left_anti").select("block", "form")
    ends = lambda c: F.array(F.substring(c, 1, 3), F.concat(F.lit("-"), F.substring(c, -3, 3)))
    two = F.flatten(F.transform(ends("street"), lambda x: F.transform(ends("town"), lambda y: F.xxhash64(*base, x, y))))
    rare = rare.unionByName(forms.where("town <> ''").select(F.explode(two).alias("block"), "form"))
    pairs = rare.join(rare.select("block", F.col("form").alias("form_b")), "block").where("form < form_b").select("form", "form_b")
    ended = forms.select("town", F.explode(F.transform(ends("street"), lambda x: F.xxhash64(*base, x))).alias("block"), F.col("form").alias("y"))  # forms without a town meet all with an end of their street
    loose = ended.where("town = ''").select("block", F.col("y").alias("x")).join(ended.select("block", "y"), "block").where("x <> y")
    pairs = pairs.unionByName(loose.select(F.least("x", "y").alias("form"), F.greatest("x", "y").alias("form_b")))
    if n:
        full = scratch.write(keyed.join(hot, "block", "left_semi"))
        both, size = full.where("other <> ''"), F.length("other").alias("size")
        kept = both.select("block", F.explode(kept_blocks("other")).alias("third"), F.col("form").alias("x"), size)
        sought = both.select("block", F.explode(sought_blocks("other")).alias("third"), F.col("form").alias("y"), F.length("other").alias("size_y"))
        close = kept.join(sought, ["block", "third"]).where("x <> y and (size < size_y or x < y)").select("x", "y")
        lacking = full.where("other = ''").select("block", F.col("form").alias("x")).join(full.select("block", F.col("form").alias("y")), "block").where("x <> y").select("x", "y")
        pairs = pairs.unionByName(close.unionByName(lacking).select(F.least("x", "y").alias("form"), F.greatest("x", "y").alias("form_b")))
    return pairs.distinct()


def place_groups(addresses: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """((form, address_id), (form, form_b)): which form each address has, and the pairs of forms that name the same place.

    The links between differing forms with the membership of the addresses: as many rows as addresses and links, whatever the
    number of copies. Addresses without a house number or street are in no form. Repeated rows count once.
    """
    scratch = scratch or Scratch(addresses.sparkSession)
    known = scratch.write(addresses.where("digits <> '' and street <> ''").withColumn("form", F.xxhash64(*FIELDS)).distinct())
    forms = scratch.write(known.select("form", *FIELDS).distinct())
    words = forms.select(F.explode(F.array("street", "town")).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n = forms.count()
    rarity = words.select("w", F.log(F.lit(float(max(n, 2))) / F.col("n") + 1).alias("r"))
    a = forms.select("form", "street", "town", "postal", "nation").join(rarity.select(F.col("w").alias("street"), F.col("r").alias("street_rarity")), "street").join(rarity.select(F.col("w").alias("town"), F.col("r").alias("town_rarity")), "town", "left")
    a = scratch.write(a.select("form", "street", "town", "postal", "nation", "street_rarity", F.coalesce("town_rarity", F.lit(0.0)).alias("town_rarity")))
    b = a.select(*(F.col(c).alias(f"{c}_b") for c in a.columns))
    near = scratch.write(_near(_met(forms, scratch).join(a, "form").join(b, "form_b")))
    return known.select("form", "address_id"), scratch.write(_settled(near))


def address_pairs(addresses: DataFrame) -> DataFrame:
    """``(address_id_a, address_id_b)``, smaller id first: pairs of ``parsed_addresses`` rows that name the same place.

    All pairs come out, those of equal forms included, as the result is defined by pairs; ``place_groups`` gives the same without them.
    """
    ids, close = place_groups(addresses)
    apart = close.join(ids, "form").select("form_b", F.col("address_id").alias("x")).join(ids.select(F.col("form").alias("form_b"), F.col("address_id").alias("y")), "form_b").select("x", "y")
    alike = ids.join(ids.select("form", F.col("address_id").alias("y")), "form").where("address_id < y").select(F.col("address_id").alias("x"), "y")
    return apart.where("x <> y").unionByName(alike).select(F.least("x", "y").alias("address_id_a"), F.greatest("x", "y").alias("address_id_b")).distinct()


def _likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _slips(x: Column, y: Column) -> Column:
    """At most two edits apart, or one where a word has less than six letters; two letters that changed places count as one."""
    far = F.levenshtein(x, y)
    return (far <= F.when(F.least(F.length(x), F.length(y)) >= 6, 2).otherwise(1)) | ((far == 2) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, ""))))


def _near(pairs: DataFrame) -> DataFrame:
    """(form, form_b, town, town_b, tier, sure) of pairs whose digits, kind and direction agree by the block, and the street but for slips.

    With towns on both sides the rarity-weighted overlap of the words decides, where the words that aren't in common count by
    their likeness; else an equal postal code (tier 0). A code that is a slip away (tier 1) or lacks (tier 2) leaves a pair that isn't ``sure``.
    """
    c = F.col
    one, two = F.array(F.concat(F.lit("s"), "street"), F.concat(F.lit("t"), "town")), F.array(F.concat(F.lit("s"), "street_b"), F.concat(F.lit("t"), "town_b"))
    pairs = pairs.withColumn("common", F.array_intersect(one, two))
    weight = lambda w: F.when(F.startswith(w, F.lit("s")), c("street_rarity") + c("street_rarity_b")).otherwise(c("town_rarity") + c("town_rarity_b"))
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda got, x: got + x)
    apart = F.arrays_zip(F.array_except(one, "common").alias("x"), F.array_except(two, "common").alias("y"))
    overlap = (sum_of(F.transform("common", weight)) + sum_of(F.transform(apart, lambda p: weight(p["x"]) * _likeness(F.substr(p["x"], F.lit(2)), F.substr(p["y"], F.lit(2)))))) / sum_of(F.transform(one, weight))
    nation = (c("nation") == c("nation_b")) | (c("nation") == "") | (c("nation_b") == "")
    both = (c("town") != "") & (c("town_b") != "")
    postal = (c("postal") != "") & (c("postal_b") != "")
    by_town = ((c("town") == c("town_b")) | (_slips(c("town"), c("town_b")) & (overlap >= 0.7))) | (postal & (c("postal") == c("postal_b")) & (_likeness(c("town"), c("town_b")) >= 0.5))
    tier = F.when(both, F.when(by_town & nation, 0)).when(postal & (c("postal") == c("postal_b")), 0).when(postal & nation & (F.levenshtein("postal", "postal_b", 1) >= 0), 1).when(~postal & nation, 2)
    alike = (c("street") == c("street_b")) | _slips(c("street"), c("street_b"))
    return pairs.where(alike).select("form", "form_b", "town", "town_b", tier.alias("tier"), (tier == 0).alias("sure")).where("tier is not null")


def found_pairs(candidates: DataFrame, subsidiaries: DataFrame) -> DataFrame:
    """``(address_id_a, address_id_b)`` over headquarters of candidates and legal addresses of subsidiaries together."""
    both = parsed_addresses(candidates, "address_id", "headquarters_address").unionByName(parsed_addresses(subsidiaries, "address_id", "legal_address"))
    return address_pairs(both)
