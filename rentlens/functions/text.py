"""Text -> field scalar functions. Every function maps Column(s) to a Column
built from Spark's native string/regex functions, so it runs inside
whole-stage codegen: no Python UDF anywhere on this path.

Regex notes (Java engine):
  * ``(?U)`` makes ``\\s \\d \\w \\b`` Unicode-aware, matching Python ``re`` on
    ``str`` patterns; ``(?iU)`` adds Unicode case folding for ``re.I``.
  * ``regexp_extract`` returns '' when there is no match -> wrapped in ``nullif``.
  * Numbers are cast with ``try_cast`` so a malformed amount gives NULL
    instead of dropping the record or failing the job.
  * Case is folded once a text (``folded``); patterns then run without the
    case-insensitive flag, which costs a case conversion at every position.
    A pattern runs only where ``has`` finds the literals that every match
    must hold: a plain substring search settles most texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rentlens.sources.dims import KNOWN_LOCALITIES, correction_canon, correction_names

# Python's str.isspace() set, written out so both Java and RE2 see the same class.
WS_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CHARS}]"
WS_LITERAL = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# ---------------------------------------------------------------------------
# FIXED VALUES: patterns that must equal the reference's for equal results.
# Case-insensitive ones get (?iU) when compiled for Spark.
# ---------------------------------------------------------------------------
BHK_RE = r"(\d+(?:\.\d+)?)\s*BHK"
AREA_RE = r"([\d,]+)\s*sq\.?\s*ft"
INR_LAKH_RE = r"(?:₹|rs\.?)\s*([\d.]+)\s*L"
INR_THOUSAND_RE = r"(?:₹|rs\.?)\s*([\d.]+)\s*K"
INR_PLAIN_RE = r"(?:₹|rs\.?)\s*([\d.]+)"
INR_NEAR_RENT_RE = r"rent[^0-9]{0,20}([\d.]+)"
# one hit of any of the three currency rules above (their shared prefix)
_INR_HIT_RE = r"(?:₹|rs\.?)\s*[\d.]+\s*[LK]?"
MSG_RENT_RE = r"(?:rent|rental)[^0-9]{0,80}(?:₹|rs\.?|inr)?\s*([\d,]+(?:\.\d+)?)\s*([KLkl])?"
MSG_INR_ANY_RE = r"(?:₹|rs\.?)\s*([\d,]+(?:\.\d+)?)\s*([KLkl])?"
RENT_MARKER_RE = (r"(?:\d+\s*bhk|\b(rent|deposit|rental|for\s+rent)\b|₹|rs\.?\s*\d|"
                  r"sqft|sq\.?\s*ft|preferred|bachelor|family|owner|broker)")
SALE_MARKER_RE = (r"\bfor\s+sale\b|\bresale\b|\b\d[\d,]*\s*/?-?\s*per\s*sq\.?\s*ft\b|"
                  r"\bexpected\s+price\b")
ROOM_SHARE_RE = (r"\b(?:flatmate|flat\s*mate|roommate|room\s*mate|"
                 r"female\s+flatmate|male\s+flatmate|per\s+person|per\s+head|"
                 r"room\s+available|share\s+the\s+flat|share\s+the\s+room|"
                 r"looking\s+for\s+(?:a\s+)?(?:female|male|girl|boy)\s+(?:flatmate|roommate)|"
                 r"paying\s+guest|\bpg\b)")
PROPERTY_TYPE_RULES: list[tuple[str, str]] = [
    (r"\bindependent\s*house\b", "independent_house"),
    (r"\bvilla\b", "villa"),
    (r"\bpg\b", "pg"),
    (r"\bstudio\b", "studio"),
    (r"\b(apartment|flat)\b", "apartment"),
    (r"\bhouse\b", "independent_house"),
]
DEPOSIT_RE = r"₹\s*([\d,]+(?:\.\d+)?)\s*\n\s*Deposit\b"
FLOOR_RE = r"(?<!\d)(\d{1,2})\s*/\s*(\d{1,2})(?!\d)"
AGE_RE = r"(\d+)\s*(?:-\s*(\d+))?\s*\+?\s*(?:years?|yrs?)\b"
FURNISHING_RULES: list[tuple[tuple[str, ...], str]] = [
    (("fully furnished", "full furnish"), "full"),
    (("semi furnished", "semi-furnished"), "semi"),
    (("unfurnished", "not furnished"), "unfurnished"),
]
FURNISHING_VARIANTS: dict[str, str] = {
    "semi_furnished": "semi", "semi": "semi", "semifurnished": "semi",
    "fully_furnished": "full", "furnished": "full", "full": "full",
    "unfurnished": "unfurnished", "un_furnished": "unfurnished",
}
FIRST_CHARS_PROPERTY_TYPE = 200
FIRST_CHARS_LOCALITY = 400

# ---------------------------------------------------------------------------


def translate_pattern(p: str, digit: str | None = None, boundary: bool = False, java: bool = False) -> str:
    """Rewrite Python ``re`` escapes for another regex engine.

    ``\\s`` becomes Python's exact whitespace set (Java's Unicode ``\\s``
    differs on U+001C-U+001F); ``digit`` replaces ``\\d`` when given; with
    ``boundary`` each ``\\b`` becomes a consuming Unicode word-edge test (for
    engines whose ``\\b`` is ASCII-only; valid for match/no-match tests).
    """
    word = r"\pL\pM\pN_"
    out: list[str] = []
    i, in_cls = 0, False
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            n = p[i + 1]
            if n == "s" and java:
                # Java's Unicode \s plus the four separators Python also counts
                out.append(r"\s\x1C-\x1F" if in_cls else r"[\s\x1C-\x1F]")
            elif n == "s":
                out.append(WS_CHARS if in_cls else WS)
            elif n == "d" and digit:
                out.append(digit if in_cls else f"[{digit}]")
            elif n == "b" and boundary and not in_cls:
                prev = "".join(out)
                leading = prev == "" or prev.endswith(("(", "|", "(?:", "(?i)"))
                out.append(f"(?:^|[^{word}])" if leading else f"(?:[^{word}]|$)")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if c == "[" and not in_cls:
            in_cls = True
        elif c == "]" and in_cls:
            in_cls = False
        out.append(c)
        i += 1
    return "".join(out)


def ci(p: str) -> str:
    """Java form of a case-insensitive Python pattern."""
    return "(?iU)" + translate_pattern(p, java=True)


#: The characters other than A-Z that match an ASCII letter whatever the case, and that letter.
FOLDS = ("\u0130\u0131\u017f\u212a", "iisk")


def folded(c: Column) -> Column:
    """Lower case, with everything that matches an ASCII letter case-insensitively as that letter."""
    odd = reduce(Column.__or__, [c.contains(x) for x in FOLDS[0]])
    return F.lower(F.when(odd, F.translate(c, *FOLDS)).otherwise(c))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is read there."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def on_folded(fn):
    """A function of a folded text as one of a text as it stands, which is folded once (a bound variable: the optimizer
    would copy the fold into every place that reads it). ``.of`` takes a text that is folded already."""
    def on_text(text: Column) -> Column:
        return let(folded(text), fn)
    on_text.of = fn
    on_text.__doc__ = fn.__doc__
    return on_text


def cf(p: str) -> str:
    """Java form of a case-insensitive Python pattern, for a ``folded`` text."""
    small = "".join(c if k and p[k - 1] == "\\" else c.lower() for k, c in enumerate(p))
    return "(?U)" + translate_pattern(small, java=True)


def has(t: Column, *literals: str | tuple[str, ...]) -> Column:
    """Whether a folded text holds one of the literals (of a tuple: all of them)."""
    cond = None
    for one in literals:
        both = None
        for word in (one,) if isinstance(one, str) else one:
            both = t.contains(word) if both is None else both & t.contains(word)
        cond = both if cond is None else cond | both
    return cond


def cu(p: str) -> str:
    """Java form of a case-sensitive Python pattern."""
    return "(?U)" + translate_pattern(p, java=True)


# T1 / T2 -------------------------------------------------------------------

def normalize_text(c: Column) -> Column:
    """strip, lower, collapse every whitespace run to one space."""
    return F.trim(F.regexp_replace(F.lower(c), WS + "+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


# T3 - T6 -------------------------------------------------------------------

def normalize_locality(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), f"[^a-z0-9{WS_CHARS}]", " ")
    s = F.trim(F.regexp_replace(s, WS + "+", " "))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(F.replace(s, F.lit(" "), F.lit("_")))


def _bucket(x: Column, width: Column) -> Column:
    lo = (F.floor(x / width) * width).cast("bigint")
    return F.concat_ws("-", lo.cast("string"), (lo + width.cast("bigint")).cast("string"))


def rent_bucket(rent: Column) -> Column:
    w = F.when(rent < 100000, F.lit(5000)).otherwise(F.lit(20000))
    return F.when(rent.isNull(), F.lit("unknown")).otherwise(_bucket(rent, w))


def area_bucket(area: Column) -> Column:
    return F.when(area.isNull(), F.lit("unknown")).otherwise(_bucket(area, F.lit(200)))


def dedup_key(locality_norm: Column, bhk: Column, rent: Column, area: Column) -> Column:
    loc = F.when(locality_norm.isNull() | (locality_norm == ""), F.lit("unknown")).otherwise(locality_norm)
    b = F.coalesce(bhk.cast("string"), F.lit("unk"))
    return F.concat_ws("|", loc, b, rent_bucket(rent), area_bucket(area))


# T7 - T11 (card and message fields) ----------------------------------------

def _found(t: Column, literals: tuple, pattern: str, idx: int = 1) -> Column:
    """A group of a pattern's first match in a folded text that holds the literals ('' without a match)."""
    return F.when(has(t, *literals), F.regexp_extract(t, cf(pattern), idx))


@on_folded
def parse_bhk(t: Column) -> Column:
    return _found(t, ("bhk",), BHK_RE).try_cast("double")


@on_folded
def parse_area(t: Column) -> Column:
    return F.replace(_found(t, (("sq", "ft"),), AREA_RE), F.lit(","), F.lit("")).try_cast("double")


@on_folded
def parse_inr(t: Column) -> Column:
    """Card amount. Commas removed first; lakh, thousand, plain, near 'rent'.

    The three currency rules share their prefix, and their digit run cannot
    give characters back to the suffix, so each rule's first match starts at
    one of the successive matches of ``_INR_HIT_RE``. One scan collects those
    hits; the rules then pick the first hit ending in L, in K, or the first
    hit. A malformed number gives NULL (the rule is still decided).
    """
    t = F.replace(t, F.lit(","), F.lit(""))
    hits = F.when(has(t, "₹", "rs"), F.regexp_extract_all(t, F.lit(cf(_INR_HIT_RE)), 0)).otherwise(F.array().cast("array<string>"))
    plain = cf(INR_PLAIN_RE)    # on a hit it matches at the start: the hit's number
    none = F.lit(None).cast("string")

    def ends_in(h, ch):
        return F.substring(h, -1, 1) == ch

    def step(acc, h):   # first hit ending in L, first ending in K, first hit
        return F.struct(F.coalesce(acc["l"], F.when(ends_in(h, "l"), h)).alias("l"),
                        F.coalesce(acc["k"], F.when(ends_in(h, "k"), h)).alias("k"),
                        F.coalesce(acc["p"], h).alias("p"))

    def num(h):
        return F.regexp_extract(h, plain, 1).try_cast("double")

    def finish(acc):    # the near-'rent' rule runs only when no currency hit exists
        return (F.when(acc["p"].isNull(), _found(t, ("rent",), INR_NEAR_RENT_RE).try_cast("double"))
                 .when(acc["l"].isNotNull(), num(acc["l"]) * 100000)
                 .when(acc["k"].isNotNull(), num(acc["k"]) * 1000)
                 .otherwise(num(acc["p"])))
    return F.aggregate(hits, F.struct(none.alias("l"), none.alias("k"), none.alias("p")), step, finish)


def _scaled_amount(num: Column, suffix: Column) -> Column:
    n = F.replace(num, F.lit(","), F.lit("")).try_cast("double")
    return (F.when(suffix == "k", n * 1000).when(suffix == "l", n * 100000).otherwise(n))


@on_folded
def parse_message_rent(t: Column) -> Column:
    """Rent-anchored amount in [3k, 500k], else the first currency amount in [5k, 500k]."""
    hit = _found(t, ("rent",), MSG_RENT_RE, 0)  # one scan of the text; the groups are read from the hit
    p1 = cf(MSG_RENT_RE)
    first = let(hit, lambda h: _scaled_amount(F.regexp_extract(h, p1, 1), F.regexp_extract(h, p1, 2)))
    first = let(first, lambda v: F.when(v.between(3000, 500000), v))
    p2 = cf(MSG_INR_ANY_RE)
    amounts = F.transform(F.regexp_extract_all(t, F.lit(p2), 0),
                          lambda h: _scaled_amount(F.regexp_extract(h, p2, 1), F.regexp_extract(h, p2, 2)))
    ok = F.filter(amounts, lambda v: v.between(5000, 500000))
    return F.coalesce(first, F.when(has(t, "₹", "rs"), F.try_element_at(ok, F.lit(1))))


def parse_furnishing(text: Column) -> Column:
    return furnishing_of(F.lower(text))


def furnishing_of(t: Column) -> Column:
    """Furnishing label of a text in lower case."""
    out = F.lit(None).cast("string")
    for needles, label in reversed(FURNISHING_RULES):
        cond = None
        for n in needles:
            cond = t.contains(n) if cond is None else (cond | t.contains(n))
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


# T12 / T13 (locality) -------------------------------------------------------

def guess_locality(text: Column) -> Column:
    """First KNOWN_LOCALITIES name (list order) contained case-insensitively."""
    t = F.lower(text)
    out = F.lit(None).cast("string")
    for name in reversed(KNOWN_LOCALITIES):
        out = F.when(t.contains(name.lower()), F.lit(name)).otherwise(out)
    return out


def locality_pattern() -> str:
    import re
    return r"\b(" + "|".join(re.escape(n) for n in correction_names()) + r")\b"


WORD = r"\p{L}\p{N}_"   # Python's \w on str


def trie_alternation(words: list[str]) -> str:
    """Regex over literal ``words`` shaped as a prefix trie. At every node the
    longer continuation is tried before stopping, so together with a trailing
    boundary test it accepts exactly what ``(w1|w2|...)`` with the words sorted
    longest-first accepts, but needs about one comparison per text position."""
    import re
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        end = "" in node
        kids = [re.escape(ch) + build(sub) for ch, sub in sorted(node.items()) if ch != ""]
        if not kids:
            return ""
        body = kids[0] if len(kids) == 1 else "(?:" + "|".join(kids) + ")"
        return f"(?:{body})?" if end else body
    return build(tree)


def locality_pattern_java() -> str:
    """Lower-case names as a trie, with explicit Unicode word edges."""
    names = sorted({n.lower() for n in correction_names()})
    return f"(?<![{WORD}])({trie_alternation(names)})(?![{WORD}])"


def correct_locality(text: Column, current: Column) -> Column:
    """struct(locality, changed) from whole-word mentions in the first 400 chars."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, FIRST_CHARS_LOCALITY)
    canon = F.create_map(*[x for k, v in correction_canon().items() for x in (F.lit(k), F.lit(v))])
    # case-insensitive match = case-sensitive match on the lower-cased head
    hits = F.regexp_extract_all(F.lower(head), F.lit(locality_pattern_java()), 1)
    cur = F.coalesce(current, F.lit(""))
    # one pass over the hits: first canonical hit, whether the current tag is
    # among them, and how many there are (the hit array is computed once)
    init = F.struct(F.lit(None).cast("string").alias("first"), F.lit(False).alias("keep"),
                    F.lit(0).alias("n"))

    def step(acc, h):
        c = F.try_element_at(canon, F.lower(h))
        return F.struct(F.coalesce(acc["first"], c).alias("first"),
                        (acc["keep"] | (c.isNotNull() & current.isNotNull() & (F.lower(c) == F.lower(cur))))
                        .alias("keep"),
                        (acc["n"] + F.when(c.isNotNull(), 1).otherwise(0)).alias("n"))

    outside = F.lit("outside_coverage")

    def finish(acc):
        loc = F.when(acc["n"] == 0, outside).when(acc["keep"], current).otherwise(acc["first"])
        changed = (F.when(acc["n"] == 0, cur != outside).when(acc["keep"], F.lit(False))
                   .otherwise(acc["first"] != cur))
        return F.struct(loc.alias("locality"), changed.alias("changed"))
    return F.aggregate(hits, init, step, finish)


# T14 - T17 (card enrichment) -----------------------------------------------

#: What every match of a label's patterns holds.
PROPERTY_TYPE_LITERALS = {"independent_house": ("house",), "villa": ("villa",), "pg": ("pg",), "studio": ("studio",),
                          "apartment": ("apartment", "flat")}


@on_folded
def parse_property_type(t: Column) -> Column:
    return property_type_of(F.substring(t, 1, FIRST_CHARS_PROPERTY_TYPE))  # folding keeps the number of characters


def property_type_of(head: Column) -> Column:
    """Property type of the first characters of a folded text."""
    out = F.lit(None).cast("string")
    for pat, label in reversed(PROPERTY_TYPE_RULES):
        out = F.when(has(head, *PROPERTY_TYPE_LITERALS[label]) & head.rlike(cf(pat)), F.lit(label)).otherwise(out)
    return out


@on_folded
def parse_deposit(t: Column) -> Column:
    v = F.replace(_found(t, (("₹", "deposit"),), DEPOSIT_RE), F.lit(","), F.lit("")).try_cast("double")
    return let(v, lambda v: F.when(v.between(1000, 5000000), v))


def parse_floor(text: Column) -> Column:
    """struct(floor_num, total_floors) from the first a/b pair; valid iff 0<=a<=b<=60."""
    m = F.when(has(text, "/"), F.regexp_extract(text, cu(FLOOR_RE), 0))     # one scan of the text

    def pair(parts):
        return F.struct(F.trim(F.try_element_at(parts, F.lit(1))).try_cast("int").alias("a"),
                        F.trim(F.try_element_at(parts, F.lit(2))).try_cast("int").alias("b"))

    def judged(f):
        ok = (f.a >= 0) & (f.a <= f.b) & (f.b <= 60)
        return F.struct(F.when(ok, f.a).alias("floor_num"), F.when(ok, f.b).alias("total_floors"))
    return let(let(F.split(m, "/"), pair), judged)


# AGE_RE with possessive quantifiers for the Java engine. Same first match:
# a digit run is always followed by a non-digit token, and giving whitespace
# back from one \s* to the next cannot change what follows, so backtracking
# into them can never produce a match the greedy form would miss.
AGE_RE_POSSESSIVE = r"(\d++)\s*+(?:-\s*+(\d++))?\s*+\+?\s*+(?:years?|yrs?)\b"


@on_folded
def parse_age(t: Column) -> Column:
    p = cf(AGE_RE_POSSESSIVE)
    hit = _found(t, ("year", "yr"), AGE_RE_POSSESSIVE, 0)    # one scan of the text; the groups are read from the hit
    ends = let(hit, lambda m: F.struct(F.regexp_extract(m, p, 1).try_cast("double").alias("lo"),
                                       F.regexp_extract(m, p, 2).try_cast("double").alias("hi")))
    mid = let(ends, lambda e: (e.lo + F.coalesce(e.hi, e.lo)) / 2)
    return let(mid, lambda v: F.when((v >= 0) & (v <= 100), v))


# All fields of a card (T7 - T9, T11, T14 - T17) --------------------------------

#: Stands for the currency sign in a ``masked`` text. Most cards are ASCII then, which is folded, decoded and matched
#: faster. No pattern tells the two characters from each other but by the currency sign.
RUPEE, NOT_RUPEE = "\x01", "\x02"


def masked(c: Column) -> Column:
    """The text with RUPEE for the currency sign, character by character."""
    return F.replace(F.replace(c, F.lit(RUPEE), F.lit(NOT_RUPEE)), F.lit("₹"), F.lit(RUPEE))


def folded_masked(m: Column) -> Column:
    """``folded`` of a masked text; plain ASCII needs its lower case only."""
    return F.when(F.octet_length(m) == F.char_length(m), F.lower(m)).otherwise(folded(m))


def with_card_fields(df: DataFrame, text_col: str, fields) -> DataFrame:
    """Adds the named fields of the cards in ``text_col``: bhk, area_sqft, rent_monthly, furnishing, property_type, deposit,
    floor_num and total_floors (both by ``floor``), age_years; as the single parsers find them.

    A projection's results are read more than once by the next, so the optimizer leaves them apart. The bound variable
    in the one with the patterns keeps it out of the stage's one method, which the JVM would not compile beyond 8000 bytes.
    """
    t, plain, hits, names = F.col("__text"), F.col("__plain"), F.col("__hits"), df.columns

    def masks(p):
        return p.replace("₹", r"\x01")

    def number(x):
        return F.replace(x, F.lit(","), F.lit("")).try_cast("double")

    def amount(suffix):     # of the first hit that ends so
        return F.regexp_extract(hits, cf(masks(INR_PLAIN_RE) + suffix), 1)

    def floor(k):
        return F.trim(F.get("__floor", F.lit(k))).try_cast("int")

    def years(k):
        return F.regexp_extract("__age", cf(AGE_RE_POSSESSIVE), k).try_cast("double")

    d = df.withColumn("__text", masked(F.col(text_col))).withColumn("__text", folded_masked(t))
    d = d.select(*names, t, F.substring(t, 1, FIRST_CHARS_PROPERTY_TYPE).alias("__head"), F.replace(t, F.lit(","), F.lit("")).alias("__plain"))
    deposit = number(_found(t, ((RUPEE, "deposit"),), masks(DEPOSIT_RE)))
    found = {
        "bhk": {"bhk": _found(t, ("bhk",), BHK_RE).try_cast("double")},
        "area_sqft": {"area_sqft": number(_found(t, (("sq", "ft"),), AREA_RE))},
        "rent_monthly": {"__plain": plain, "__hits": F.when(has(plain, RUPEE, "rs"), F.array_join(
            F.regexp_extract_all(plain, F.lit(cf(masks(_INR_HIT_RE))), 0), "|")).otherwise("")},
        "furnishing": {"furnishing": furnishing_of(t)},
        "property_type": {"property_type": property_type_of(F.col("__head"))},
        "deposit": {"deposit": let(deposit, lambda v: F.when(v.between(1000, 5000000), v))},
        "floor": {"__floor": F.split(F.when(has(t, "/"), F.regexp_extract(t, cu(FLOOR_RE), 0)), "/")},
        "age_years": {"__age": _found(t, ("year", "yr"), AGE_RE_POSSESSIVE, 0)},
    }
    d = d.select(*names, *[v.alias(k) for f in fields for k, v in found[f].items()])
    split = {
        "rent_monthly": {"__plain": plain, "__lakh": amount(r"\s*L"), "__thousand": amount(r"\s*K"), "__rupees": amount("")},
        "floor": {"__a": floor(0), "__b": floor(1)},
        "age_years": {"__lo": years(1), "__hi": years(2)},
    }
    d = d.select(*names, *[v.alias(k) for f in fields for k, v in split.get(f, {f: F.col(f)}).items()])
    lakh, thousand, rupees, low, high = (F.col(c) for c in ("__lakh", "__thousand", "__rupees", "__a", "__b"))
    ok, mid = (low >= 0) & (low <= high) & (high <= 60), (F.col("__lo") + F.coalesce("__hi", "__lo")) / 2
    judged = {
        "rent_monthly": {"rent_monthly": F.when(lakh != "", number(lakh) * 100000).when(thousand != "", number(thousand) * 1000)
                         .when(rupees != "", number(rupees)).otherwise(_found(plain, ("rent",), INR_NEAR_RENT_RE).try_cast("double"))},
        "floor": {"floor_num": F.when(ok, low).cast("double"), "total_floors": F.when(ok, high).cast("double")},
        "age_years": {"age_years": F.when((mid >= 0) & (mid <= 100), mid)},
    }
    return d.select(*names, *[v.alias(k) for f in fields for k, v in judged.get(f, {f: F.col(f)}).items()])


# F1 / F2 / T21 - T23 --------------------------------------------------------

def strip(c: Column) -> Column:
    """White space of Python's ``str.strip`` removed at both ends (no pattern that is tried at every blank inside)."""
    return F.btrim(c, F.lit(WS_LITERAL))


@on_folded
def looks_like_listing(t: Column) -> Column:
    t = F.coalesce(t, F.lit(""))
    sale = has(t, "sale", ("per", "sq"), "price") & t.rlike(cf(SALE_MARKER_RE))
    rent = has(t, *RENT_LITERALS) & t.rlike(cf(RENT_MARKER_RE))
    return (F.char_length(t) >= 60) & ~sale & rent


#: What every match of the rent marker, and of the room-share marker, holds one of.
RENT_LITERALS = ("bhk", "rent", "deposit", "₹", "rs", "sq", "preferred", "bachelor", "family", "owner", "broker")
ROOM_SHARE_LITERALS = ("mate", "per", "room", "share", "looking", "paying", "pg")


@on_folded
def is_room_share(t: Column) -> Column:
    t = F.coalesce(t, F.lit(""))
    return has(t, *ROOM_SHARE_LITERALS) & t.rlike(cf(ROOM_SHARE_RE))


def source_tag(group_name: Column, share: Column) -> Column:
    return F.concat(F.when(share, F.lit("telegram_share:")).otherwise(F.lit("telegram:")), group_name)


def source_bucket(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def furnishing_category(furnishing: Column) -> Column:
    s = F.lower(F.coalesce(furnishing, F.lit("unknown")))
    s = F.btrim(F.regexp_replace(s, "[^a-z]+", "_"), F.lit("_"))
    m = F.create_map(*[x for k, v in FURNISHING_VARIANTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, s), F.lit("unknown"))


# T24 (typed label answers) ---------------------------------------------------

def parse_choice_answer(raw: Column, allowed, default: Column) -> Column:
    """One of ``allowed`` as typed; a null word gives NULL, anything else keeps the default."""
    s = strip(raw)
    return F.when(F.lower(s).isin(*NULL_WORDS), F.lit(None).cast("string")).when(s.isin(*allowed), s).otherwise(default)


TRUE_WORDS = ("1", "y", "yes", "true", "t")
FALSE_WORDS = ("0", "n", "no", "false", "f")
NULL_WORDS = ("none", "null", "-")


def parse_bool_answer(raw: Column) -> Column:
    s = strip(raw)
    return (F.when(F.lower(s).isin(*NULL_WORDS), F.lit(None).cast("int"))
            .when(s.isin(*TRUE_WORDS), F.lit(1)).when(s.isin(*FALSE_WORDS), F.lit(0)))


def parse_int_answer(raw: Column) -> Column:
    s = strip(raw)
    return F.when(F.lower(s).isin(*NULL_WORDS), F.lit(None).cast("int")).otherwise(
        F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int")))


def parse_tag_answer(raw: Column, allowed: list[str]) -> Column:
    s = strip(raw)
    tags = F.transform(F.split(s, ","), lambda t: F.lower(strip(t)))
    tags = F.filter(tags, lambda t: t != "")
    keep = F.array_sort(F.array_distinct(F.array_intersect(tags, F.array(*[F.lit(a) for a in allowed]))))
    return F.when(F.lower(s).isin("none", "null", "-", "empty"), F.array().cast("array<string>")).otherwise(keep)


# T25 (display) ---------------------------------------------------------------

def rupees(x: Column) -> Column:
    """'₹12,345' with Python int() truncation."""
    return F.concat(F.lit("₹"), F.format_number(x.cast("bigint"), 0))


def title_words(s: Column) -> Column:
    """Python ``str.title`` of the text with spaces for underscores: every run of
    letters gets a capital, also after a digit."""
    runs = F.regexp_extract_all(F.replace(s, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))),
                                                             F.lower(F.substr(w, F.lit(2))))), "")


def json_string_array(arr: Column) -> Column:
    """Python json.dumps(list[str]) layout: ["a", "b"] (ASCII tags only)."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "),
                    F.lit("]"))
