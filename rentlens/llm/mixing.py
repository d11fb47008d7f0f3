"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document posteriors over
domains, so a document may belong to several. Document rates r >= 0 are fitted
so that the expected tokens of domain d, the sum of r * tokens * posterior(d),
match the targets in the least-squares sense, by distributed projected gradient
descent: every document steps against its own gradient, posteriors . error of
the totals, and is cut off at zero; one pass over the documents is one aggregation of a few numbers
a domain. Rates become copies: the whole part, and one more
with the probability of the fraction, drawn by a hash of the row's key.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import map_rows, materialize, struct_of

#: Hashed word features; style features follow.
BUCKETS = 1024
STYLE = 10
#: Rounds after which the rates are written, so that later rounds do not repeat the steps before.
WRITE_ROUNDS = 16

_LETTERS = re.compile(r"[^\W\d_]+")


class Features:
    """Hashed word shares (square root) and style shares of whole texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, int]:
        words = text.split()
        n = len(words)
        out = np.zeros(BUCKETS + STYLE + 1, np.float32)
        out[-1] = 1
        if not n:
            return out, 0
        known = self.known
        if len(known) > 300_000:
            known.clear()
        at = []
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = zlib.crc32(w.strip(".,;:!?*#$%&|").lower().encode("utf-8", "surrogatepass")) % BUCKETS
            at.append(k)
        out[:BUCKETS] = np.sqrt(np.bincount(at, minlength=BUCKETS) / n)
        chars, lines = max(1, len(text)), text.split("\n")
        upper = sum(map(str.isupper, words))
        marks = sum(text.count(c) for c in "*#$%&|!")
        out[BUCKETS:-1] = (upper / n, marks / n, text.count("|") / n, sum(map(str.isdigit, words)) / n, len(set(words)) / n,
                           len(set(lines)) / len(lines), min(1.0, n / 20), chars / n / 20, text.count("!!") / n, min(1.0, 20 / n))
        return out, n


def fit_posteriors(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Softmax regression weights (features x classes) by accelerated gradient descent.

    Needs little more memory than ``x`` itself: the step length comes from power iteration.
    """
    n, kind = len(y), x.dtype
    goal = np.eye(classes)[y]
    v = np.ones(x.shape[1], kind)
    for _ in range(30):
        v /= np.linalg.norm(v)
        v = x.T @ (x @ v)
    step = 1 / (0.55 * float(np.linalg.norm(v)) / n + penalty)
    w = past = np.zeros((x.shape[1], classes))
    for k in range(rounds):
        at = w + k / (k + 3) * (w - past)
        error = (softmax((x @ at.astype(kind)).astype(float)) - goal).astype(kind)
        past, w = w, at - step * ((x.T @ error).astype(float) / n + penalty * at)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_key(text="text"):
    """SHA-256 of the whole text; null counts as empty. With doc_id it names a row, up to rows that are equal in both."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 6000) -> DataFrame:
    """doc_id, text_key, tokens (words between white space) and posteriors (array in the order of ``domains``).

    ``labelled`` is (doc_id, domain). The classifier is fitted on at most ``sample`` of its rows, the
    first by a hash of doc_id; rows of other domains, without a document or with nulls take no part.
    Without any, the posteriors are uniform. Null texts are empty: no tokens, the classifier's posteriors
    of an empty text.
    """
    chosen = (labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
              .toDF("k", "domain"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), text_key().alias("text_key"))

    def vectors():
        features = Features()

        def each(batch: pa.RecordBatch):
            found = [features.of(t.as_py())[0] for t in batch.column(0)]
            at = [np.flatnonzero(x).astype(np.int16) for x in found]
            return {"at": at, "x": [x[i] for x, i in zip(found, at)], "domain": batch.column(1)}
        return each

    train = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["k"]).select("t", "domain")  # at most ``sample`` ids
    got = map_rows(train, vectors, struct_of(("at", "array<smallint>"), ("x", "array<float>"), ("domain", "string"))).toArrow().combine_chunks()
    weights = np.zeros((BUCKETS + STYLE + 1, len(domains)))
    if len(got):
        at, filled = (got.column(c).combine_chunks() for c in ("at", "x"))  # features other than 0
        x = np.zeros((len(got), len(weights)), np.float32)
        x[np.repeat(np.arange(len(got)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = filled.flatten().to_numpy()
        y = np.array([domains.index(d) for d in got.column("domain").to_pylist()])
        order = np.lexsort((*x[:, -STYLE - 1:].T, x[:, :BUCKETS].argmax(axis=1), y))  # the fit must not depend on the rows' order
        x, y = x[order], y[order]
        del got, at, filled
        weights = fit_posteriors(x, y, len(domains))

    def posteriors():
        features = Features()

        def each(batch: pa.RecordBatch):
            tokens, p = [], []
            for at in range(0, batch.num_rows, 256):
                found = [features.of(t) for t in batch.column(1).slice(at, 256).to_pylist()]
                tokens += [n for _, n in found]
                p.append(softmax(np.stack([f for f, _ in found]) @ weights))
            flat = np.concatenate(p)
            return {"doc_id": batch.column(0), "text_key": batch.column(2), "tokens": tokens,
                    "posteriors": pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * len(domains), flat.ravel())}
        return each

    return map_rows(rows, posteriors, struct_of(("doc_id", docs.schema["doc_id"].dataType), ("text_key", "string"),
                                                ("tokens", "long"), ("posteriors", "array<double>")))


def stepped(p: np.ndarray, scale: np.ndarray, rate: np.ndarray, before: np.ndarray,
            steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, rates of the round before, where the last step began) after projected gradient steps (momentum, error
    times step length) from ``rate``; posteriors, scale and rates are those of some documents."""
    at = rate
    for momentum, error in steps:
        at = rate + momentum * (rate - before)
        before, rate = rate, np.maximum(0.0, at - scale * (p @ error))
    return rate, before, at


def descend(look, write, start: tuple, target: np.ndarray, step: float, tolerance: float) -> list[tuple[float, np.ndarray]]:
    """Steps to the least-squares rates, from rates of 1; those since the last ``write(steps)``.

    ``look(steps)`` gives (totals after the steps, totals one step before, Gram matrix of the documents with a rate
    above zero, norm of the last step's projected gradient); ``start`` is what it would give for no step. Steps are
    accelerated (Nesterov). While no rate reaches or leaves zero, the Gram matrix tells the totals of the next rounds,
    so one pass may take several of them; it counts only if the totals that it finds have a smaller error, else fewer
    rounds are tried, down to a single one, whose gradient is exact. A single accelerated step that would raise the
    error is taken back too, and the momentum starts anew, so the error never rises. It ends where the projected
    gradient of a single step is at most ``tolerance``, or where a plain step, which lowers the error by theory, no
    longer does in double precision.
    """
    steps: list[tuple[float, np.ndarray]] = []
    now, past, gram, _ = start
    error = float(((now - target) ** 2).sum())
    k, ahead = 0, 1
    while True:
        tried, t, before = list(steps), now, past
        for j in range(k, k + ahead):
            momentum = j / (j + 3)
            at = t + momentum * (t - before)
            tried.append((momentum, step * (at - target)))
            before, t = t, at - step * gram @ (at - target)
        new, new_past, new_gram, gradient = look(tried)
        after = float(((new - target) ** 2).sum())
        if ahead == 1 and gradient <= tolerance and after <= error:
            return tried
        if after >= error * (1 - 1e-14):
            if ahead > 1:
                ahead //= 4
                ahead = max(ahead, 1)
            elif not k:
                return steps
            else:
                past, k = now, 0
            continue
        steps, now, past, gram, error, k = tried, new, new_past, new_gram, after, k + ahead
        ahead = 1 if gradient <= tolerance else min(2 * ahead, WRITE_ROUNDS)
        if len(steps) >= WRITE_ROUNDS:
            write(steps)
            steps = []


def fit_rates(members: DataFrame, weights: list[float], budget: float | None = None, tolerance: float = 2e-7) -> DataFrame:
    """``members`` (doc_id, tokens, posteriors) with a column rate, so that expected domain tokens come
    nearest to ``budget`` times the normalised ``weights`` (budget None: the present tokens).

    Nonnegative least squares by projected gradient (``descend``), totals as shares of all tokens. A document's step
    is as much longer as its domains are rare (posteriors / domain shares, added up), which is a gradient step in
    another metric and lets rare domains settle as fast as common ones; the common step length is the inverse of the
    largest eigenvalue of the Gram matrix in that metric. A pass reads the written posteriors and rates and adds up
    as many numbers as there are domains and pairs of them. Documents without tokens change no total and keep rate 1, as does every document if there
    are no tokens at all.
    """
    k = len(weights)
    total = float(members.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    target = np.array(weights, float) / sum(weights) * (1.0 if budget is None else budget / total)
    state = materialize(members.withColumns({"__rate": F.lit(1.0), "__before": F.lit(1.0)}))
    share = F.col("tokens") / F.lit(total)
    p = [F.element_at("posteriors", i + 1) for i in range(k)]
    totals = np.array([float(x) for x in state.agg(*[F.sum(share * x) for x in p]).first()])
    inverse = 1 / np.maximum(totals, 1e-12)
    scale = sum((F.lit(float(c)) * x for c, x in zip(inverse, p)), F.lit(0.0))
    pairs = list(zip(*np.tril_indices(k)))
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, state.agg(*[F.sum(share * scale * p[i] * p[j]) for i, j in pairs]).first()):
        gram[i, j] = gram[j, i] = float(v)
    step = 1 / float(np.linalg.eigvalsh(gram)[-1])

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        m = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, k)
        return m, m @ inverse, *(np.asarray(batch.column(n)) for n in (1, 2))

    def look(steps):
        def task():
            def each(batch: pa.RecordBatch):
                m, longer, rate, before = arrays(batch)
                rate, before, at = stepped(m, longer, rate, before, steps)
                s = np.asarray(batch.column(3)) / total
                live = (m * (s * longer * (rate > 0))[:, None]).T @ m
                gradient = (s * ((rate - at) / (step * longer)) ** 2).sum()
                return {"sums": [np.concatenate([m.T @ (s * rate), m.T @ (s * before), live.ravel(), [gradient]])]}
            return each

        got = map_rows(state.select("posteriors", "__rate", "__before", "tokens"), task, struct_of(("sums", "array<double>")))
        got = np.array(got.agg(*[F.sum(F.element_at("sums", n + 1)) for n in range(2 * k + k * k + 1)]).first(), float)
        return got[:k], got[k:2 * k], got[2 * k:-1].reshape(k, k), float(np.sqrt(got[-1]))

    def moved(rows: DataFrame, steps) -> DataFrame:
        """The rows with the rates after the steps."""
        names = ["posteriors", "__rate", "__before", *[c for c in rows.columns if c not in ("posteriors", "__rate", "__before")]]

        def task():
            def each(batch: pa.RecordBatch):
                rate, before, _ = stepped(*arrays(batch), steps)
                return {c: batch.column(n) for n, c in enumerate(names)} | {"__rate": rate, "__before": before}
            return each

        return map_rows(rows.select(*names), task, rows.select(*names).schema)

    def write(steps) -> None:
        nonlocal state
        state = materialize(moved(state, steps))

    steps = descend(look, write, (totals, totals, gram, 0.0), target, step, tolerance)
    out = moved(state, steps) if steps else state
    return out.select(*members.columns, F.when(F.col("tokens") > 0, F.col("__rate")).otherwise(1.0).alias("rate"))


def with_copies(rates: DataFrame, seed: int = 42) -> DataFrame:
    """Adds copies: the rate's whole part, and one more if a hash of the row's key (doc_id and text_key) falls below
    its fraction."""
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_key"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("rate")
    return rates.withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget_share: float = 1.0, sample: int = 6000) -> DataFrame:
    """One row per document: doc_id, text_key, tokens, posteriors, domain (the likeliest), rate, copies.

    ``targets`` maps domains to nonnegative weights; ``budget_share`` is the wanted number of tokens as a
    share of the present one. Rows that repeat are members of their own; an empty table gives an empty
    result; further columns are ignored.
    """
    names = sorted(targets)
    members = materialize(domain_posteriors(docs, labelled, names, sample))
    total = members.agg(F.sum("tokens")).first()[0] or 0
    rates = with_copies(fit_rates(members, [targets[n] for n in names], total * budget_share))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    return rates.withColumn("domain", F.element_at(F.array(*[F.lit(n) for n in names]), best)).select(
        "doc_id", "text_key", "tokens", "posteriors", "domain", "rate", "copies")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as their copies say, with the columns of ``docs``. Every row has copies of its
    own, found by doc_id and text_key: rows equal in both have equal posteriors and draws."""
    n = (mixed.groupBy("doc_id", "text_key").agg(F.max("copies").alias("__copies")).where("__copies > 0")
         .toDF("__mix_id", "__mix_key", "__copies"))
    rows = docs.join(n, docs["doc_id"].eqNullSafe(n["__mix_id"]) & (text_key() == n["__mix_key"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: language and quality label, such as ``en/1``."""
    k = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("__k"), F.col("quality").alias("__quality"))
    return (docs.select("doc_id", "lang").join(k, F.col("doc_id") == F.col("__k"))
            .select("doc_id", F.concat_ws("/", "lang", F.col("__quality").cast("string")).alias("domain")))
