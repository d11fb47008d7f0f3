"""Per-operator unit tests on inline rows (the quirks listed in FIXTURES.md)."""

import re

from pyspark.sql import functions as F

from rentlens.functions import extract as ex, text as tx


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"t {typ}").select(expr(F.col("t")).alias("x")).first()["x"]


def many(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {typ}")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_normalize_text_whitespace(spark):
    got = many(spark, tx.normalize_text, ["\n  Two BHK\t\tFlat ", "A\x1cB", "MiXeD   case"])
    assert got == ["two bhk flat", "a b", "mixed case"]


def test_content_hash_is_sha256_of_normalised(spark):
    import hashlib
    assert one(spark, tx.content_hash, " Hello\tWORLD ") == hashlib.sha256(b"hello world").hexdigest()


def test_buckets(spark):
    got = many(spark, tx.rent_bucket, [0.0, 4999.99, 5000.0, 99999.0, 100000.0, 119999.0, None], "double")
    assert got == ["0-5000", "0-5000", "5000-10000", "95000-100000", "100000-120000", "100000-120000", "unknown"]
    assert many(spark, tx.area_bucket, [199.9, 200.0, None], "double") == ["0-200", "200-400", "unknown"]


def test_dedup_key_prints_bhk_as_float(spark):
    df = spark.createDataFrame([("hsr_layout", 2.0, 27000.0, 1100.0), (None, None, None, None)],
                               "l string, b double, r double, a double")
    got = [r[0] for r in df.select(tx.dedup_key(F.col("l"), F.col("b"), F.col("r"), F.col("a"))).collect()]
    assert got == ["hsr_layout|2.0|25000-30000|1000-1200", "unknown|unk|unknown|unknown"]


def test_normalize_locality(spark):
    assert many(spark, tx.normalize_locality, ["  HSR Layout, Sector-2 ", "", None, "!!!"]) == [
        "hsr_layout_sector_2", None, None, ""]


def test_card_amounts(spark):
    got = many(spark, tx.parse_inr, ["₹32,000", "Rs 32K", "₹1.2L", "₹32000 Lift", "rent 15000 located",
                                      "no amount", "₹1.2.3"])
    assert got == [32000.0, 32000.0, 120000.0, 3200000000.0, 15000.0, None, None]


def test_message_rent(spark):
    got = many(spark, tx.parse_message_rent, [
        "2 BHK for Rent in HSR. RENT: 27k", "rent 1000 only, ₹ 12,500 per person", "Rental 1.2L villa",
        "rent 15000 located near Silk Board", "nothing here", "rent 900000 ₹600000 rs 7000"])
    # "15000 located": the optional suffix takes the "l" -> 15000 lakh, out of range, no fallback amount
    assert got == [27000.0, 12500.0, 120000.0, None, None, 7000.0]


def test_floor_pairs(spark):
    texts = ["x\n1/28\n", "28/1", "0/0", "12/61", "123/45", "99/1 then 3/10"]
    got = [(r.floor_num, r.total_floors) for r in
           spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
                .select("i", tx.parse_floor(F.col("t")).alias("f")).orderBy("i").select("f.*").collect()]
    assert got == [(1, 28), (None, None), (0, 0), (None, None), (None, None), (None, None)]


def test_age_and_deposit(spark):
    assert many(spark, tx.parse_age, ["5-10 Years", "10+ Yrs", "New building", "500 years"]) == [
        7.5, 10.0, None, None]
    assert many(spark, tx.parse_deposit, ["₹ 1,00,000\nDeposit", "₹500\nDeposit", "₹50000 Deposit"]) == [
        100000.0, None, None]


def test_property_type_order(spark):
    assert many(spark, tx.parse_property_type, ["Independent House for rent", "Villa", "2 BHK Flat",
                                                "Studio apartment", "House", "x" * 250 + " villa"]) == [
        "independent_house", "villa", "apartment", "studio", "independent_house", None]


def test_correct_locality(spark):
    rows = [("Koramangala", "1 BHK in Koramangala near HSR"),   # current tag present -> kept
            ("Koramangala", "House, Jigani, HSR, Sarjapur Road"),  # first hit in text order; alias
            ("HSR Layout", "Sarjapur Road flat"),                # alias beats exact name
            ("Hebbal", "no known place"),                        # none -> outside coverage
            ("Hebbal", "y" * 400 + " Hebbal"),                   # mention after 400 chars ignored
            (None, "Flat in BTM")]
    df = spark.createDataFrame(rows, "cur string, t string")
    got = [(r.l.locality, r.l.changed) for r in
           df.select(tx.correct_locality(F.col("t"), F.col("cur")).alias("l")).collect()]
    assert got == [("Koramangala", False), ("HSR Layout", True), ("Sarjapur", True),
                   ("outside_coverage", True), ("outside_coverage", True), ("BTM Layout", True)]


def test_guess_locality_list_order(spark):
    assert many(spark, tx.guess_locality, ["near HSR Layout", "flat in hsr", "Sarjapur Road 2bhk", "none"]) == [
        "HSR Layout", "HSR", "Sarjapur Road", None]


def test_listing_filters(spark):
    share = "Female flatmate wanted in a 3 BHK, rent 12000 per person, all inclusive, call now please"
    sale = "3 BHK for sale in HSR, expected price 1.2 Cr, owner direct sale, call for more details now"
    assert many(spark, tx.looks_like_listing, [share, sale, "2 BHK rent"]) == [True, False, False]
    assert many(spark, tx.is_room_share, [share, "PG for gents", "2 BHK family flat"]) == [True, True, False]


def test_owner_and_negotiable_quirks(spark):
    texts = ["no broker", "NO BROKERAGE", "direct owner", "non-negotiable", "Posted by broker"]
    assert many(spark, ex.is_owner, texts) == [None, 0, 1, None, 0]
    assert many(spark, ex.negotiable, texts) == [None, None, None, 1, None]


def test_amenities_and_lock_in(spark):
    df = spark.createDataFrame([("lifting weights, gym, 24/7 security, lock-in: 2 years, pure veg",)], "t string")
    r = ex.with_record(df, "t").first()
    assert r.amenities_json == '["gym", "lift", "security"]'
    assert (r.lock_in_months, r.veg_only, r.n_amenities) == (24, 1, 3)


def test_llm_answer_normaliser(spark):
    answers = ['{"tenant_pref":"family","veg_only":true,"is_owner":false,"lock_in_months":11,'
               '"amenities":["lift","gym","lift"]}',
               'Here: {"tenant_pref":"students","veg_only":"yes","lock_in_months":"6","amenities":["x","ac"]} ok',
               '{"amenities":"none"}', "sorry", '{"broken": ']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = df.select("i", ex.normalize_llm_answer(F.col("a")).alias("n")).orderBy("i").select("n.*").collect()
    assert [g.ok for g in got] == [True, True, True, False, False]
    assert (got[0].tenant_pref, got[0].veg_only, got[0].is_owner, got[0].lock_in_months, got[0].amenities_json) == (
        "family", 1, 0, 11, '["gym", "lift"]')
    assert (got[1].tenant_pref, got[1].veg_only, got[1].lock_in_months, got[1].amenities_json) == (
        None, None, 6, '["ac"]')
    assert got[2].amenities_json == "[]"


def test_token_cost(spark):
    df = spark.createDataFrame([(1000000, 1000000), (None, None)], "i long, o long")
    got = [r[0] for r in df.select(ex.token_cost(F.col("i"), F.col("o"))).collect()]
    assert abs(got[0] - 2.80) < 1e-12 and got[1] == 0.0


def test_furnishing_category(spark):
    assert many(spark, tx.furnishing_category, ["Fully Furnished", "semi-furnished", "UN FURNISHED", None, "x"]) == [
        "full", "semi", "unfurnished", "unknown", "unknown"]


def _inr_brute(text):
    """The four card-amount rules, each as its own first-match search."""
    if text is None:
        return None
    t = text.replace(",", "")

    def first(p):
        m = re.search(p, t, re.I)
        return m.group(1) if m else None

    def num(s):
        try:
            return float(s)
        except ValueError:
            return None
    for p, mult in ((tx.INR_LAKH_RE, 100000), (tx.INR_THOUSAND_RE, 1000), (tx.INR_PLAIN_RE, 1)):
        g = first(p)
        if g is not None:
            v = num(g)
            return None if v is None else v * mult
    g = first(tx.INR_NEAR_RENT_RE)
    return None if g is None else num(g)


def test_parse_inr_single_scan_matches_rule_by_rule(spark):
    cases = ["₹500 deposit ₹1.2L rent", "rs 900 then Rs. 25 k", "₹ 7 , ₹ 8L and ₹9K", "Rs.5000 ", "₹1.2.3 L ₹5",
             "hours 5 rent 20000", "₹ rent 12000", "RS 40k", "₹ 12 lakh", "rent: 1.5.6", None, "", "₹₹500",
             "₹ 3000 Rs 4000 K", "rs..5 L", "Rs 10 L, ₹ 20 K"]
    got = many(spark, tx.parse_inr, cases)
    assert got == [_inr_brute(c) for c in cases]


def test_guarded_patterns_match_like_unguarded(spark):
    """Folding the case once and asking for literals first changes no pattern's verdict."""
    import random

    from pyspark.sql import functions as F

    from rentlens.functions import extract as ex, text as tx
    phrases = ["bachelors only male", "male bachelors", "bachelor - female", "working women", "families preferred", "family", "bachelor",
               "anyone", "all tenants", "no restriction", "preferred tenants: all", "veg only", "only vegetarian", "pure veg",
               "no non-veg", "veg tenants only", "non veg allowed", "non-vegetarian ok", "any food", "owner direct", "no broker",
               "posted by owner", "get owner details", "brokerage", "agent fee", "agent details", "posted by agent", "negotiable",
               "price can be discussed", "rent is negotiable", "lift", "elevator", "parking", "car park", "gym", "fitness center",
               "swimming pool", "24/7 security", "power backup", "generator", "dg backup", "24 7 water", "borewell", "corp water",
               "club-house", "garden", "lawn", "kids play", "children's play", "play area", "wi-fi", "air conditioning", "ac included",
               "split ac", "washing machine", "fridge", "refrigerator", "geyser", "water heater", "cctv", "surveillance",
               "independent house", "villa", "pg", "studio", "apartment", "flat", "house", "for sale", "resale", "4,500 per sq ft",
               "expected price", "flat mate", "roommate", "per head", "room available", "share the flat", "looking for a girl flatmate",
               "paying guest", "2 bhk", "rent", "₹ 12,000", "rs. 900", "sqft", "deposit", "lock-in: 11 months", "minimum stay 2 years"]
    rng = random.Random(4)
    odd = {"i": "İı", "s": "ſ", "k": "K"}
    texts = []
    for _ in range(400):
        t = rng.choice(["", "x", " \n"]).join(rng.sample(phrases, 3))
        texts.append("".join(rng.choice([c, c.upper(), *odd.get(c, c)]) if rng.random() < 0.3 else c for c in t))
    rules = [*zip([p for p, _ in ex.TENANT_RULES], ex.TENANT_LITERALS), *zip(ex.VEG_RULES, ex.VEG_LITERALS),
             *zip(ex.NONVEG_OK_RULES, ex.NONVEG_OK_LITERALS), *zip(ex.OWNER_RULES, ex.OWNER_LITERALS),
             *zip(ex.BROKER_RULES, ex.BROKER_LITERALS), *zip(ex.NEGOTIABLE_RULES, ex.NEGOTIABLE_LITERALS),
             (ex.LOCK_IN_RE, ex.LOCK_IN_LITERALS), *[(p, ex.AMENITY_LITERALS[t]) for t, p in ex.AMENITY_RULES],
             *[(p, tx.PROPERTY_TYPE_LITERALS[t]) for p, t in tx.PROPERTY_TYPE_RULES],
             (tx.RENT_MARKER_RE, tx.RENT_LITERALS), (tx.ROOM_SHARE_RE, tx.ROOM_SHARE_LITERALS),
             (tx.SALE_MARKER_RE, ("sale", ("per", "sq"), "price"))]
    t = tx.folded(F.col("t"))
    differ = [F.when(F.col("t").rlike(tx.ci(p)) != (tx.has(t, *need) & t.rlike(tx.cf(p))), F.lit(p)) for p, need in rules]
    wrong = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.array_compact(F.array(*differ)).alias("d")).where("size(d) > 0")
    assert wrong.collect() == []
    hits = spark.createDataFrame([(x,) for x in phrases], "t string").select(*[F.max(tx.has(t, *need) & t.rlike(tx.cf(p))) for p, need in rules]).first()
    assert all(hits)


def test_strip_equals_python(spark):
    from pyspark.sql import functions as F

    from rentlens.functions import text as tx
    assert set(tx.WS_LITERAL) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    texts = ["", " ", "a", *(f"{c}x {c}y\n{c}" for c in tx.WS_LITERAL), "​x ", "\n\r\n a₹ 　\u0085"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip(F.col("t")).alias("s"))
    assert all(r.s == r.t.strip() for r in df.collect())
    assert "regexp" not in df._jdf.queryExecution().analyzed().toString()   # a pattern was tried at every blank of the text


def test_card_fields_in_stages_equal_the_single_parsers(spark):
    """Masking the currency sign, and reading amounts from the hits alone, changes no field; no per-row fold of hits."""
    import random

    from pyspark.sql import functions as F

    from rentlens.plans.q_extract import CARD_FIELDS
    parts = ["1", "23", "456", "1.5", "2.3.4", ",", ".", "/", " / ", "\n", " ", "\x1c", "\xa0", "₹", "rs", "Rs.", "RS", "ſ", "K", "\u212a", "L",
             "bhk", "bHK", "sqft", "sq. ft", "Deposit", "depositx", "years", "yr", "+", "-", "rent", "rrs", "\x01", "\x02", "|", "İ", "ı", "Σ",
             "é", "٣", "house", "Villa", "pg", "semi furnished", "UNFURNISHED", "5-10 Years", "₹ 12,000\nDeposit", "₹1.2L", "12/20", "x" * 190]
    rng = random.Random(3)
    texts = [None, "", "|"] + ["".join(rng.choices(parts, k=rng.randint(1, 20))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    single = rows.select("i", tx.parse_bhk(t), tx.parse_area(t), tx.parse_inr(t), tx.parse_furnishing(tx.folded(t)), tx.parse_property_type(t),
                         tx.parse_deposit(t), tx.parse_floor(t)["floor_num"].cast("double"), tx.parse_floor(t)["total_floors"].cast("double"),
                         tx.parse_age(t))
    staged = tx.with_card_fields(rows, "t", CARD_FIELDS).drop("t")
    assert "aggregate(" not in staged._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, staged.collect()))
    assert got == sorted(map(tuple, single.collect())) and all(any(r[k] is not None for r in got) for k in range(len(got[0])))
