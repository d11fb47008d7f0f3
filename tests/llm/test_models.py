"""Toxicity, mixing, nearest neighbours and the pipeline."""

import sys

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rentlens.llm import ann, mixing, queries, toxicity  # noqa: E402
from rentlens.llm.common import read_table  # noqa: E402

SF = "/root/testdata/sf0.01"


# ---- toxicity ----------------------------------------------------------------

def test_string_kernel_equals_its_definition():
    words = ["idiot", "i.d.i.o.t", "idxiot", "id1ot", "harbour", "aaaa", "é", "idiotisch"]

    def phi(word):
        out, s = {}, [31, *(int(toxicity.CODES[ord(c)]) for c in word)]
        for i in range(len(s)):
            for a in range(i + 1, min(i + 5, len(s))):
                for b in range(a + 1, min(i + 5, len(s))):
                    if s[i] and s[a] and s[b]:
                        key = s[i], s[a], s[b]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (b - i - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    want = np.array([[sum(v * phi(y).get(k, 0) for k, v in phi(x).items()) for y in words] for x in words])
    want = np.maximum(want - toxicity.FLOOR, 0) / (1 - toxicity.FLOOR)
    at, got = toxicity.Landmarks(words).kernel(words)
    full = np.zeros_like(want)
    full[at] = got
    assert np.allclose(full, want)
    assert full[0, 1] > 0 and full[0, 2] > 0.1 and full[0, 3] > 0.99 and full[0, 4] == 0


def test_kernel_reads_only_the_landmarks_that_hold_a_sequence():
    """The same similarities without the dense table, for words that share nothing, something or everything."""
    marks = toxicity.Landmarks(["idiot", "harbour", "aaaa", "stupid"])
    words = ["idiot", "zzzz", "id1otic", "", "\0\1", "harbours", "aaaaaaaaa", "sstupidd", "é漢字"] + [f"word{n}" for n in range(300)]
    ids, codes, value = toxicity.embed(words)
    full = np.zeros((len(words), 4))
    np.add.at(full, ids, value[:, None] * marks.table[codes])
    full = np.maximum(full - toxicity.FLOOR, 0) / (1 - toxicity.FLOOR)
    marks.table = None
    at, got = marks.kernel(words)
    assert at.tolist() == np.flatnonzero(full.max(axis=1)).tolist() and np.allclose(got, full[at])


def test_runs_of_single_characters_are_words():
    for text, run in (("a b c", "abc"), ("x i\td\ni o t y z", "xidiotyz"), ("an i d i", "idi")):
        assert run in toxicity.words_of(text)
    assert toxicity.words_of("a b cc d e") == {"a", "b", "cc", "d", "e"} == toxicity.words_of("a  b cc d  e")


def toxic_rows():
    calm = "the ship left the harbour in the morning and the crew sang about the weather and the sea".split()
    out = []
    for i in range(240):
        text = [calm[(i * 7 + j) % len(calm)] + ("", "ly", "ing")[(i + j) % 3] for j in range(12 + i % 9)]
        toxic = i % 3 == 0
        if toxic:
            text[3:3] = [("grubmuffin", "snarkweed")[i % 2], ("snarkweed", "grubmuffin")[i % 2]]
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_toxicity_catches_gapped_and_inserted_characters(spark):
    made = toxic_rows()
    df = spark.createDataFrame(made, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    tests = [(1, "you grubmuffin and snarkweed"), (2, "a g.r.u.b.m.u.f.f.i.n and a snark-weed sat"), (3, "what a grubxmuffin, snarkqweed"),
             (4, "g r u b m u f f i n s n a r k w e e d here, snarkweed"), (5, "the harbour in the morning"), (6, ""), (7, None),
             (8, "the sea " * 20000), (9, "x" * 50000 + "grubmuffin snarkweed"), (1, "you grubmuffin and snarkweed")]
    rows = spark.createDataFrame(tests, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("predicted", F.lit("x"))
    got = {r["doc_id"]: r for r in toxicity.score(rows, model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_rare_insult_becomes_a_landmark_beside_many_frequent_words(spark):
    common = [f"{a}{b}{c}" for a in "bcdfghjklmnprstvwxyz" for b in "aeiou" for c in range(100, 190)]  # 9000
    rows = [(i, " ".join(common) + (" grubmuffin" if i < 3 else ""), int(i < 6)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    assert any(w.startswith("grub") for w in toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic")).landmarks)


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    for labels in (none, one):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_query_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert len(got) == read_table(spark, SF, "documents").count()
    english = read_table(spark, SF, "documents").where("lang = 'en'").select("doc_id")
    right = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in read_table(spark, SF, "labels").join(english, "doc_id").collect()
             if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in right]) > 0.95 and sum(b for a, b in right if a) >= 0.8 * sum(a for a, _ in right)


# ---- mixing ------------------------------------------------------------------

def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    rows = [(i, int(rng.integers(0, 500)), p[i].tolist()) for i in range(400)]
    members = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, posteriors array<double>")
    got = mixing.fit_rates(members, [5, 3, 2]).collect()
    total = sum(t for _, t, _ in rows)
    expected = sum(r["rate"] * r["tokens"] * np.array(r["posteriors"]) for r in got)
    assert np.allclose(expected, np.array([5, 3, 2]) / 10 * total, rtol=1e-4) and min(r["rate"] for r in got) >= 0


def test_rates_stay_nonnegative_when_a_target_is_zero(spark):
    rows = [(i, 10, [0.9, 0.1] if i % 2 else [0.1, 0.9]) for i in range(50)]
    got = mixing.fit_rates(spark.createDataFrame(rows, "doc_id bigint, tokens bigint, posteriors array<double>"), [1, 0]).collect()
    # least squares: no nonnegative rates leave domain 2 empty; documents of domain 2 go entirely
    assert {round(r["rate"], 6) for r in got if not r["doc_id"] % 2} == {0.0} and min(r["rate"] for r in got if r["doc_id"] % 2) > 1


def test_rates_equal_nonnegative_least_squares_on_soft_posteriors(spark):
    rows = [(i, 10, [0.6, 0.4] if i % 2 else [0.4, 0.6]) for i in range(20)]
    got = mixing.fit_rates(spark.createDataFrame(rows, "doc_id bigint, tokens bigint, posteriors array<double>"), [160, 40]).collect()
    # one kind alone: rate 200 * (0.6 * 160 + 0.4 * 40) / (100 * (0.36 + 0.16)) / 200 each
    assert all(abs(r["rate"] - (112 / 52 if r["doc_id"] % 2 else 0)) < 1e-5 for r in got)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rates_end_at_the_least_squares_optimum(spark, seed):
    rng = np.random.default_rng(seed)
    p, tokens = rng.dirichlet([2, 2, 2, 2], 60), rng.integers(0, 300, 60)
    members = spark.createDataFrame([(i, int(tokens[i]), p[i].tolist()) for i in range(60)], "doc_id bigint, tokens bigint, posteriors array<double>")
    got = mixing.fit_rates(members, [0.85, 0.05, 0.05, 0.05]).toPandas().set_index("doc_id")["rate"].sort_index().to_numpy()
    error = (got * tokens) @ p / tokens.sum() - [0.85, 0.05, 0.05, 0.05]
    assert (got >= 0).all() and np.linalg.norm(error) < np.linalg.norm(tokens @ p / tokens.sum() - [0.85, 0.05, 0.05, 0.05])
    slope = (p @ error)[tokens > 0]  # zero where the rate is above zero, else not negative
    assert abs(slope[got[tokens > 0] > 0]).max() < 1e-5 and slope.min() > -1e-5
    assert (got[tokens == 0] == 1).all()


def least_squares(a, t):
    """Lawson and Hanson's active sets: nonnegative x with the least |a x - t|."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10_000):
        slope = a.T @ (t - a @ x)
        if free.all() or slope[~free].max() <= 1e-12:
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], t, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            bad = free & (z <= 0)
            x = x + min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            free &= x > 1e-13
            x[~free] = 0
            if not free.any():
                break
    return x


def test_projected_gradient_equals_least_squares_on_200_problems():
    """2 to 12 domains, crisp and soft posteriors, reachable and unreachable targets; the error never rises."""
    rng, most = np.random.default_rng(4), 0
    for _ in range(200):
        k, n = int(rng.integers(2, 13)), 60
        p, s = rng.dirichlet(np.full(k, rng.choice([0.05, 0.3, 1.0, 4.0])), n), rng.random(n) * (rng.random(n) < 0.9)
        s /= s.sum()
        t = rng.dirichlet(np.full(k, rng.choice([0.1, 1.0, 5.0]))) * rng.choice([0.5, 1.0, 3.0])
        totals = p.T @ s
        scale = p @ (1 / np.maximum(totals, 1e-12))
        step = 1 / np.linalg.eigvalsh((p * (s * scale)[:, None]).T @ p)[-1]
        state, errors, passes = [np.ones(n), np.ones(n)], [], []

        def gram(rate):
            return (p * (s * scale * (rate > 0))[:, None]).T @ p

        def look(steps):
            passes.append(1)
            rate, before, at = mixing.stepped(p, scale, *state, steps)
            return p.T @ (s * rate), p.T @ (s * before), gram(rate), float(np.sqrt((s * ((rate - at) / (step * scale)) ** 2).sum()))

        def write(steps):
            state[:] = mixing.stepped(p, scale, *state, steps)[:2]
            errors.append(float(((p.T @ (s * state[0]) - t) ** 2).sum()))

        steps = mixing.descend(look, write, (totals, totals, gram(state[0]), 0.0), t, step, 1e-10)
        most = max(most, len(passes))
        rate = mixing.stepped(p, scale, *state, steps)[0]
        best = least_squares((p * s[:, None]).T, t)
        mine, least = np.linalg.norm(p.T @ (s * rate) - t), np.linalg.norm((p * s[:, None]).T @ best - t)
        assert rate.min() >= 0 and abs(mine - least) <= 1e-5 and np.allclose(p.T @ (s * rate), (p * s[:, None]).T @ best, atol=2e-4)
        assert all(b <= a for a, b in zip(errors, errors[1:]))


def test_copies_of_rows_without_an_id(spark):
    """The draw hangs on the whole key: rows without an id are drawn one by one, equal rows alike."""
    rows = [(None, f"key{i}", 0.3) for i in range(1000)] + [(5, "same", 0.5)] * 4
    got = mixing.with_copies(spark.createDataFrame(rows, "doc_id bigint, text_key string, rate double")).collect()
    assert 230 < sum(r["copies"] for r in got if r["doc_id"] is None) < 370
    assert len({r["copies"] for r in got if r["doc_id"] == 5}) == 1


def test_mixing_query(spark):
    got = queries.op5_mixing(spark, SF).toPandas()
    assert len(got) == read_table(spark, SF, "documents").count()
    mass = np.stack(got["posteriors"].to_list()) * got["tokens"].to_numpy()[:, None]
    want = np.array([queries.MIX_TARGETS[n] for n in sorted(queries.MIX_TARGETS)]) * queries.MIX_BUDGET * mass.sum()
    assert np.allclose((mass * got["rate"].to_numpy()[:, None]).sum(0), want, rtol=1e-3)
    assert (abs(got["copies"] - got["rate"]) < 1).all()
    truth = queries.mixing.quality_domains(read_table(spark, SF, "documents"), read_table(spark, SF, "labels")).toPandas()
    both = truth.merge(got, on="doc_id", suffixes=("", "_found"))
    assert (both["domain"] == both["domain_found"]).mean() > 0.9


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "en"), (None, "x", None), (1, "a b", "en")], "doc_id bigint, text string, lang string")
    docs = docs.withColumn("rate", F.lit(1)).withColumn("copies", F.lit(9)).withColumn("posteriors", F.lit(9))
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    found = mixing.mix(docs, none, {"a": 1, "b": 1})
    assert found.count() == 4 and {round(r["rate"], 6) for r in found.collect()} == {1.0}
    assert mixing.apply_mix(docs, found).count() == 4 and mixing.apply_mix(docs, found).columns == docs.columns
    assert mixing.mix(docs.limit(0), none, {"a": 1}).count() == 0
    nothing = mixing.mix(docs.where("text IS NULL"), none, {"a": 1, "b": 1})
    assert [r["rate"] for r in nothing.collect()] == [1.0]


# ---- nearest neighbours ------------------------------------------------------

def truth(ids, x, asked, limit):
    out = {}
    for q in asked:
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += x[ids == q][0][d] * x[:, d]
        out[q] = [(int(i), float(v)) for v, i in sorted(zip(-s, ids)) if i != q][:limit]
        out[q] = [(i, -v) for i, v in out[q]]
    return out


def test_ann_query_recall_and_scores(spark):
    e = read_table(spark, SF, "embeddings").orderBy("vec_id").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"].to_list()).astype(float)
    want = truth(ids, x, ids[ids % 20 == 0], 20)
    got = queries.op6_ann(spark, SF).toPandas()
    assert set(got["query_id"]) == set(want)
    hits = 0
    for q, g in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        assert list(g["rank"]) == list(range(1, 21))
        assert list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))
        hits += len({i for i, _ in want[q]} & set(g["vec_id"]))
        at = {int(i): k for k, i in enumerate(ids)}
        for v, s in zip(g["vec_id"], g["score"]):
            assert abs(s - x[at[q]] @ x[at[v]]) < 1e-12
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ann_of_a_whole_index_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:250] = x[100]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8), (1004, [1.0, 2.0]), (1005, [float("inf")] * 8), (1020, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("c1", F.lit(1))
    entries = ann.usable(df)
    got = ann.nearest_neighbours(entries, entries.where("vec_id % 20 = 0"), limit=20, share=1.0, k=8, entry_block=64, query_block=4).toPandas()
    want = truth(np.arange(300), x, range(0, 300, 20), 20)
    for q, g in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        assert list(g["vec_id"]) == [i for i, _ in want[q]]
    assert set(got["query_id"]) == set(want)


def test_ann_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    e = ann.usable(df)
    got = sorted(helpers.rows(ann.nearest_neighbours(e, e.where("vec_id % 20 = 0")), "query_id", "rank", "vec_id", "score"))
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    none = ann.usable(df.limit(0))
    assert ann.nearest_neighbours(none, none).count() == 0


def test_ann_repeated_query_rows_keep_their_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = rng.normal(size=6)
    e = ann.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    asked = ann.usable(spark.createDataFrame([rows[0]] * 3 + [rows[20], rows[20], (20, other.tolist())], "vec_id bigint, embedding array<double>"))
    got = ann.nearest_neighbours(e, asked, limit=20, share=1.0, k=8, entry_block=16, query_block=2).toPandas()
    want = truth(np.arange(120), x, [0], 20)[0]
    first = got[got["query_id"] == 0].sort_values("rank")
    assert list(first["vec_id"]) == [i for i, _ in want] and list(first["rank"]) == list(range(1, 21))
    best = np.maximum(x @ x[20], x @ other)  # two vectors of one id: an entry counts once, by the better
    best[20] = -np.inf
    second = got[got["query_id"] == 20].sort_values("rank")
    assert list(second["vec_id"]) == np.argsort(-best)[:20].tolist() and np.allclose(second["score"], np.sort(best)[::-1][:20])


def test_ann_entries_without_an_id_and_large_ids(spark):
    """A null vec_id is a neighbour whose id is null, never a query; ids above 2^53 come back exactly."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    big = (1 << 60) // 20 * 20
    ids = [None if i % 7 == 3 else big + i for i in range(60)]
    e = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>"))
    rows = ann.nearest_neighbours(e, e.where("vec_id IS NULL OR vec_id % 20 = 0"), limit=20, share=1.0, k=4, entry_block=16, query_block=2).collect()
    asked = [k for k, i in enumerate(ids) if i is not None and i % 20 == 0]
    assert len(rows) == 20 * len(asked) and {r["query_id"] for r in rows} == {ids[k] for k in asked}
    for k in asked:
        order = sorted((j for j in range(60) if j != k), key=lambda j: -float(x[k] @ x[j]))[:20]
        mine = sorted((r for r in rows if r["query_id"] == ids[k]), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == [ids[j] for j in order]


# ---- pipeline ----------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, None
    for n, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        texts, kept = dict(helpers.rows(before, "doc_id", "text")), [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            flagged = {r["doc_id"] for r in queries.op10_toxicity(spark, SF).collect() if r["predicted"]}
            assert set(kept) == set(texts) - flagged
        elif name == "exact_dedup":
            assert set(kept) == {x[0] for x in helpers.exact(texts.items()) if x[3]} and len(kept) == len(set(kept))
        elif name == "near_dedup":
            assert set(kept) == {x[2] for x in helpers.near(list(texts.items()))} and len(kept) == len(set(kept))
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in queries.mixture(before, read_table(spark, SF, "labels")).collect()}
            assert sorted(kept) == sorted(d for d, c in copies.items() for _ in range(c))
        else:
            assert sorted(kept) == sorted(r["doc_id"] for r in before.collect())
            assert {(r["doc_id"], r["decoded_sha256"]) for r in docs.collect()} == {(d, helpers.sha(t)) for d, t in texts.items()}


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = read_table(spark, helpers.SF, "documents")
    odd = spark.createDataFrame([(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", "en", "s", 0), (None, "a", "en", "s", 1),
                                 (10 ** 6 + 1, "", "en", "s", 0)], docs.schema)
    for k, table in enumerate((odd.withColumn("score", F.lit(1)).withColumn("copies", F.lit(7)), docs.limit(0))):
        for n, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, table, helpers.SF)
            out.write.parquet(str(tmp_path / f"{k}-{n}"))
            if n < len(pipeline.STAGES) - 1:
                assert out.columns == table.columns
            if k:
                assert spark.read.parquet(str(tmp_path / f"{k}-{n}")).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    made = toxic_rows()
    df = spark.createDataFrame(made, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    rows = [(None, "you grubmuffin and snarkweed", 1), (None, "the harbour in the morning", 2), (None, None, 3),
            (7, "you grubmuffin and snarkweed", 4), (7, "the crew sang about the sea", 5), (7, "the crew sang about the sea", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted int")
    got = toxicity.keep_clean(docs, model)
    assert got.columns == docs.columns and sorted(r["predicted"] for r in got.collect()) == [2, 3, 5, 6]


def test_copies_are_those_of_the_row(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (7, "a"), (7, "b"), (7, None)], "doc_id bigint, text string")
    copies = F.when(F.col("text") == "a", 2).when(F.col("text") == "b", 0).otherwise(1).cast("long")
    mixed = docs.select("doc_id", mixing.text_key().alias("text_key"), copies.alias("copies"))
    got = sorted(helpers.rows(mixing.apply_mix(docs, mixed), "doc_id", "text"), key=repr)
    assert got == sorted([(None, "a")] * 2 + [(7, "a")] * 2 + [(7, None)], key=repr)
