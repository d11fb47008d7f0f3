"""Exact dedup, SimHash near-dedup and repeated passages against brute force."""

import random
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rentlens.llm import exact, queries, rindex, simhash  # noqa: E402
from rentlens.llm.common import connected_components  # noqa: E402

#: Clashing names, nulls, empty and repeated texts, white space only, a long text.
ODD = [(5, "A  b\tc"), (3, "A b c"), (9, None), (8, ""), (7, " "), (1, "\t\n"), (4, "x" * 70000), (6, "x" * 70000),
       (10, "one two"), (11, "one  two"), (12, "ONE two"), (13, "é\u00a0é"), (14, "w " * 40000)]


@pytest.fixture(scope="module")
def odd(spark):
    return (spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(3)
            .select("*", *[F.lit("z").alias(c) for c in ("fingerprint", "keep_id", "row", "run", "digest", "u", "v", "k", "b", "start")]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{helpers.SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups(spark, odd, fan_in):
    assert set(helpers.rows(exact.exact_groups(odd, fan_in), *EXACT)) == helpers.exact(ODD)


def test_exact_query(spark, docs):
    got = helpers.rows(queries.op4_exact_dedup(spark, helpers.SF), *EXACT)
    assert len(got) == docs.count() and set(got) == helpers.exact(helpers.rows(docs, "doc_id", "text"))


def test_exact_keeps_texts_apart_that_share_the_short_digest(odd):
    got = helpers.rows(exact.exact_groups(odd, 2, digest=lambda c: F.length(c).cast("long") % 2), *EXACT)
    assert set(got) == helpers.exact(ODD)


def test_exact_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b")], "doc_id bigint, text string")
    got = exact.exact_groups(df)
    assert sorted(r["keep_id"] for r in got.collect()) == [1, 1, 1, 2, 2]
    assert got.where("kept").count() == 2
    assert sorted(helpers.rows(exact.exact_dedup(df), "doc_id", "text")) == [(1, "a"), (2, "b")]


def test_exact_uses_no_python(odd):
    plan = exact.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_duplicates(spark, odd):
    found = simhash.near_duplicates(odd)
    assert set(helpers.rows(found, "doc_id", "fingerprint", "component_id")) == helpers.near(ODD)


def test_near_query(spark, docs):
    got = set(helpers.rows(queries.op1_simhash(spark, helpers.SF), "doc_id", "fingerprint", "component_id"))
    assert got == helpers.near(helpers.rows(docs, "doc_id", "text"))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_links_join_all_within_the_radius(spark, radius):
    rnd = random.Random(radius)
    fps = set()
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(at)
            for _ in range(rnd.randint(1, 4)):
                at ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp bigint, rep bigint")
    links = simhash.ball_links(df, radius).collect()
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= radius for r in links)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    ids = list(range(len(fps)))
    assert helpers.components(ids, [(r["a"], r["b"]) for r in links]) == helpers.components(ids, pairs)


def test_near_dedup_keeps_the_smallest_of_each_component(spark, odd):
    want = {c for _, _, c in helpers.near(ODD)}
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 300)]
    star = [(1000, i) for i in range(1001, 1400)]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame([p[::-1] if p[0] % 3 else p for p in chain + star], "a bigint, b bigint")).collect()}
    assert all(v == (100 if k < 1000 else 1000) for k, v in got.items()) and len(got) == 200 + 399


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [rindex.HOT_STRETCHES, 2])
def test_repeats(spark, hot):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(60, 400))) for _ in range(8)]
    made = [(i, "".join(rnd.choice(base)[rnd.randint(0, 30):rnd.randint(40, 400)] + "x" * rnd.randint(0, 2) for _ in range(rnd.randint(0, 6))))
            for i in range(60)]
    made += [(500, None), (501, "a" * 900), (502, "a" * 99), (503, "ab" * 300), (504, ""), (505, "a" * 100)]
    df = spark.createDataFrame(made, "doc_id bigint, text string").withColumn("b", F.lit(1)).withColumn("h", F.lit(1)).repartition(3)
    assert set(helpers.rows(rindex.span_digest(rindex.remove_repeats(df, hot=hot)), *REPEATS)) == helpers.repeats(made)


def test_repeats_of_a_text_longer_than_a_piece(spark, monkeypatch):
    rnd = random.Random(1)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    made = [(1, body + body[:700] + body[300:900]), (2, body[2000:2600]), (3, "q" * 150 + body[4990:])]
    texts = [t.encode() for _, t in made]
    monkeypatch.setattr(rindex, "CHUNK", 512)
    seen = [(i, o + s + k) for ids, offsets, parts in rindex._pieces([1, 2, 3], texts, 100)
            for w, s, n, _ in zip(*rindex.stretches(parts, 100)) for i, o in [(ids[w], offsets[w])] for k in range(n)]
    assert sorted(seen) == [(i, p) for i, t in zip((1, 2, 3), texts) for p in range(len(t) - 99)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    assert set(helpers.rows(rindex.span_digest(rindex.remove_repeats(df)), *REPEATS)) == helpers.repeats(made)


def test_repeats_query(spark, docs):
    got = set(helpers.rows(queries.op8_repeats(spark, helpers.SF), *REPEATS))
    assert got == helpers.repeats(helpers.rows(docs, "doc_id", "text"))


def test_repeats_with_repeated_ids(spark):
    a, b = "p" * 40 + "".join(map(str, range(60))), "".join(map(str, range(60, 120)))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (2, a)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in rindex.span_digest(rindex.remove_repeats(df)).collect()}
    assert got[2, len(a)] == len(a) and got[None, len(b)] == len(b) and got[1, len(a)] == 0 and got[1, len(b)] == 0


def test_empty_tables(spark):
    none = empty(spark)
    assert exact.exact_groups(none).count() == 0 and exact.exact_dedup(none).columns == none.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_dedup(none).columns == none.columns
    assert rindex.remove_repeats(none).count() == 0


@pytest.mark.parametrize("length", [159, 200])
def test_repeats_of_long_strings(spark, length):
    """Stretches of more than 128 windows."""
    import random
    rng = random.Random(length)
    base = ["".join(rng.choices("abcdefg ", k=n)) for n in (700, 450, 300, length, length - 1)]
    made = [(k, "".join(rng.choice([b, b[: rng.randint(1, len(b))], "x" * rng.randint(0, 9)]) for b in rng.choices(base, k=4))) for k in range(25)]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    assert set(helpers.rows(rindex.span_digest(rindex.remove_repeats(df, length)), *REPEATS)) == helpers.repeats(made, length)
    with pytest.raises(ValueError):
        rindex.remove_repeats(df, rindex.WINDOWS)
