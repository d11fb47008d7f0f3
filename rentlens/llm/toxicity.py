"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: two words share every sequence of three letters that stands in both, in
order, within a span of five; each letter skipped inside a span multiplies the
weight by DECAY. The kernel is normalised, so inserted characters (``i.d.i.o.t``,
``idxiot``) and changed endings lower it gently instead of losing the match.

Landmarks are words and beginnings of words of labelled texts that set toxic
texts apart, chosen so that no two are alike. A text's similarities to a
landmark are those of its words (the part above FLOOR): the best, the damped
sum, and the sum for the text's length. They are mapped by the inverse root of
the landmarks' own kernel matrix (Nyström), a linear SVM with squared hinge loss
is fitted on them, and its margin is turned into a probability by Platt's sigmoid.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import map_rows, materialize, struct_of

DECAY, FLOOR = 0.5, 0.35
#: (offset of the second letter, of the third, skipped letters) within a span of five.
SPANS = tuple((a, b, b - 2) for b in range(2, 5) for a in range(1, b))
GAP = "\0" * 4  # between words, so that no sequence spans two
START = "\1"  # before every word, so that a beginning counts as such
START_CODE = 31
#: Beginnings of these lengths are landmark candidates besides the words themselves.
BEGINNINGS = range(4, 11)
POOLS = 3  # similarities of a text to each landmark
#: Longer words are read as overlapping pieces, so that a word hidden in a long one still stands out.
PIECE, STEP = 32, 16
#: Digits that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
KNOWN_WORDS = 300_000
_SPACED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")


def _letter_codes(size: int = 0x250) -> np.ndarray:
    """Code of every character: 1-26 the base letter, 27-30 other letters, 0 none."""
    out = np.zeros(size, np.int64)
    for c in range(size):
        base = unicodedata.normalize("NFKD", LEET.get(chr(c), chr(c)).lower())[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif chr(c).isalpha():
            out[c] = 27 + c % 4
    return out


CODES = _letter_codes()


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words between white space, without the punctuation around them; runs of
    single characters count as one more word (``i d i o t``)."""
    text = text.lower()
    words = text.split()
    out = set(words)
    if b"\1\1\1" in bytes([len(w) == 1 for w in words]):  # no run without three single characters in a row
        for run in _SPACED.finditer(text):
            out.add("".join(run[0].split()))
    return out


def _pieces(word: str) -> list[str]:
    return [word[i:i + PIECE] for i in range(0, max(1, len(word) - STEP), STEP)] if len(word) > PIECE else [word]


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, weight) of every letter sequence of every word, repeats included."""
    text = START + (GAP + START).join(words) + GAP
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = CODES[np.minimum(points, len(CODES) - 1)]
    far = points >= len(CODES)
    codes[far] = 27 + points[far] % 4
    codes[points == 0] = 0
    codes[points == 1] = START_CODE
    which = np.repeat(np.arange(len(words)), [len(w) + len(GAP) + 1 for w in words])
    ids, found, weights = [], [], []
    n = len(codes) - 4
    letter = codes > 0
    first, second = codes[:n] << 10, codes << 5
    for a, b, skipped in SPANS:
        at = np.flatnonzero(letter[:n] & letter[a:n + a] & letter[b:n + b])
        ids.append(which[at])
        found.append(first[at] | second[at + a] | codes[at + b])
        weights.append(np.full(len(at), DECAY ** skipped))
    return np.concatenate(ids), np.concatenate(found), np.concatenate(weights)


def embed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, value) with one row per distinct sequence of a word, of unit length per word."""
    return _unit(*sequences(words), len(words))


def _unit(ids: np.ndarray, codes: np.ndarray, weights: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as ``embed`` returns them. A weight is a power of DECAY, packed below the key for a plain sort."""
    skips = np.round(np.log2(weights) / np.log2(DECAY)).astype(np.int64)
    packed = np.sort(ids << 17 | codes << 2 | skips)
    key, weights = packed >> 2, DECAY ** (packed & 3)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[:len(key)]
    value = np.add.reduceat(weights, starts) if len(key) else weights
    ids, codes = key[starts] >> 15, key[starts] & 32767
    norm = np.sqrt(np.bincount(ids, value * value, minlength=n_words))
    return ids, codes, value / norm[ids]


class Landmarks:
    """Similarity of words to the landmarks."""

    def __init__(self, words: list[str]):
        self.words = words
        self.table = np.zeros((1 << 15, len(words)))
        ids, codes, value = embed(words)
        self.table[codes, ids] = value
        self.largest = self.table.max(axis=1) if words else np.zeros(1 << 15)
        # the landmarks that hold a sequence, sequence by sequence: few hold any one
        at, self.holders = np.nonzero(self.table)
        self.held = self.table[at, self.holders]
        self.counts = np.bincount(at, minlength=1 << 15)
        self.starts = np.cumsum(self.counts) - self.counts

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that are like any landmark, their similarities above FLOOR, one row each)."""
        ids, codes, weights = sequences(words)
        n = len(words)
        # at most what the most alike landmark could give, over at least the word's own length
        most = np.bincount(ids, weights * self.largest[codes], minlength=n)
        least = np.sqrt(np.bincount(ids, weights * weights, minlength=n))
        maybe = np.flatnonzero(most > FLOOR * np.maximum(least, 1e-9))
        if not len(maybe):
            return maybe, np.zeros((0, len(self.words)))
        place = np.full(n, -1)
        place[maybe] = np.arange(len(maybe))
        ids = place[ids]
        inside = ids >= 0
        ids, codes, value = _unit(ids[inside], codes[inside], weights[inside], len(maybe))
        shared = self.counts[codes] > 0
        ids, codes, value = ids[shared], codes[shared], value[shared]
        times = self.counts[codes]
        at = np.repeat(self.starts[codes] - (np.cumsum(times) - times), times)
        at += np.arange(len(at))
        near = np.bincount(np.repeat(ids * len(self.words), times) + self.holders[at], np.repeat(value, times) * self.held[at],
                           minlength=len(maybe) * len(self.words)).reshape(len(maybe), -1)
        near = np.maximum(near - FLOOR, 0) / (1 - FLOOR)
        some = near.max(axis=1) > 0
        return maybe[some], near[some]


class Similarities:
    """A text's pooled similarities to every landmark; remembers words up to a bound."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 10, len(self.landmarks.words)))
        self.n_rows = 0

    def keep(self, rows: np.ndarray) -> int:
        """Appends rows; the number of the first."""
        first, self.n_rows = self.n_rows, self.n_rows + len(rows)
        if self.n_rows > len(self.rows):
            grown = np.zeros((max(self.n_rows, 2 * len(self.rows)), self.rows.shape[1]))
            grown[:first] = self.rows[:first]
            self.rows = grown
        self.rows[first:self.n_rows] = rows
        return first

    def of(self, texts: list[str]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known = self.known
        new = list(set().union(*(s.difference(known) for s in sets)))
        pieces = [(p, n) for n, w in enumerate(new) for p in _pieces(w)]
        known.update(dict.fromkeys(new, -1))
        for at in range(0, len(pieces), 20_000):
            some = pieces[at:at + 20_000]
            which, near = self.landmarks.kernel([p for p, _ in some])
            first = self.keep(near)
            for k, i in enumerate(which.tolist(), first):
                w = new[some[i][1]]
                if known[w] < 0:
                    known[w] = k
                else:  # a further piece of a long word
                    self.rows[known[w]] = np.maximum(self.rows[known[w]], self.rows[k])
        out = np.zeros((len(texts), POOLS, len(self.landmarks.words)))
        for n, s in enumerate(sets):
            hits = [k for k in map(known.__getitem__, s) if k >= 0]
            if hits:
                found = self.rows[hits]
                total = np.sort(found, axis=0).sum(axis=0)  # the same sum in whatever order words were met
                out[n] = found.max(axis=0), np.log1p(total), total / np.sqrt(len(s))
        return out.reshape(len(texts), -1)


@dataclass
class Model:
    landmarks: list[str]
    #: weights on the landmark similarities (the Nyström map folded in), offset, sigmoid slope and offset
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, similarities: np.ndarray) -> np.ndarray:
        margin = similarities @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _candidates(text: str) -> set[str]:
    words = {w for w in words_of(text) if len(w) <= PIECE}
    return words | {w[:n] for w in words for n in BEGINNINGS if n < len(w)}


def choose_landmarks(candidates: list[tuple[str, int, int]], toxic: int, clean: int, limit: int, alike: float = 0.8) -> list[str]:
    """Words by their log odds times the number of toxic texts, leaving out those alike a chosen one."""
    scored = sorted((-np.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))) * t, w) for w, t, c in candidates)
    chosen: list[str] = []
    table = np.zeros((1 << 15, 0))
    for score, w in scored:
        if score >= 0 or len(chosen) >= limit:
            break
        ids, codes, value = embed([w])
        if not len(ids) or (table.shape[1] and (value @ table[codes]).max() >= alike):
            continue
        column = np.zeros((1 << 15, 1))
        column[codes, 0] = value
        table = np.hstack([table, column])
        chosen.append(w)
    return chosen


def fit(similarities: np.ndarray, labels: np.ndarray, landmarks: list[str], cost: float = 10.0, rounds: int = 500) -> Model:
    """Squared-hinge SVM on the Nyström features by accelerated gradient descent, then Platt's sigmoid."""
    if not len(landmarks) or labels.min(initial=1) == labels.max(initial=0):
        rate = (labels.sum() + 1) / (len(labels) + 2)  # one class only: its smoothed rate
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    _, own = Landmarks(landmarks).kernel(landmarks)
    w, v = np.linalg.eigh((own + own.T) / 2)
    root = v @ np.diag(1 / np.sqrt(np.maximum(w, 0.05))) @ v.T
    fold = np.kron(np.eye(POOLS), root)
    x = np.hstack([similarities @ fold, np.ones((len(labels), 1))])
    y, n = np.where(labels > 0, 1.0, -1.0), len(labels)
    weigh = np.where(labels > 0, np.sqrt(n / (2 * labels.sum())), 1.0)
    step = 1 / (1 + 2 * cost / n * np.linalg.norm(x * np.sqrt(weigh)[:, None], 2) ** 2)
    beta = past = np.zeros(x.shape[1])
    for k in range(rounds):
        at = beta + k / (k + 3) * (beta - past)
        slack = np.maximum(0, 1 - y * (x @ at)) * weigh
        grad = np.r_[at[:-1], 0] - 2 * cost / n * x.T @ (y * slack)
        past, beta = beta, at - step * grad
    margin = x @ beta
    goal = np.where(y > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / (n - labels.sum() + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(100):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -500, 500)))
        g = np.array([((p - goal) * margin).sum() + 1e-6 * ab[0], (p - goal).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * margin * margin).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, g)
        ab = ab - move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
    return Model(landmarks, fold @ beta[:-1], float(beta[-1]), float(ab[0]), float(ab[1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, n_landmarks: int = 64) -> Model:
    """A model from at most ``sample`` labelled rows (doc_id, toxic), the first by a hash of doc_id.

    Rows whose label is null or that have no document take no part. Only the
    candidate words (at most 8000, the best by ``choose_landmarks``' score) and one row of landmark similarities per
    training text come to the driver.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toDF("k", "toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text)
    rows = materialize(rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["k"]).select("text", F.col("toxic").cast("int").alias("toxic"))
                       .repartition(32))  # at most ``sample`` ids are broadcast
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}

    def count():
        def each(batch: pa.RecordBatch):
            by = Counter(), Counter()
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                by[bool(y)].update(_candidates(t.as_py()))
            words = list(by[0] | by[1])
            return {"word": words, "t": [by[1][w] for w in words], "c": [by[0][w] for w in words]} if words else None
        return each

    toxic, clean = sum(c for y, c in n.items() if y), n.get(0, 0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))) * F.col("t")
    counted = (map_rows(rows, count, struct_of(("word", "string"), ("t", "long"), ("c", "long")))
               .groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
               .where("t >= 2").orderBy(F.desc(odds), "word").limit(8000).collect())
    landmarks = choose_landmarks([(r["word"], r["t"], r["c"]) for r in counted], toxic, clean, n_landmarks)

    def similar():
        like = Similarities(Landmarks(landmarks))

        def each(batch: pa.RecordBatch):
            x = np.concatenate([like.of(batch.column(0).slice(i, 256).to_pylist()) for i in range(0, batch.num_rows, 256)])
            return {"x": list(x.astype(np.float32)), "toxic": batch.column(1)}
        return each

    found = map_rows(rows, similar, struct_of(("x", "array<float>"), ("toxic", "int"))).toPandas()
    y = found["toxic"].to_numpy(dtype=int, na_value=0) if len(found) else np.zeros(0, int)
    x = np.stack(found["x"].to_list()).astype(float) if len(found) else np.zeros((0, len(landmarks)))
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # rows come in any order; the fit must not depend on it
    return fit(x[order], y[order], landmarks)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    Null and empty texts have no similarity to any landmark, which gives the
    model's lowest score. Repeated rows get equal scores; an empty table gives
    an empty result; further columns are ignored.
    """
    def task():
        like = Similarities(Landmarks(model.landmarks))

        def each(batch: pa.RecordBatch):
            p = np.concatenate([model.probability(like.of(batch.column(1).slice(i, 256).to_pylist()))
                                for i in range(0, batch.num_rows, 256)])
            return {"doc_id": batch.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32)}
        return each

    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return map_rows(src, task, struct_of(("doc_id", docs.schema["doc_id"].dataType), ("score", "double"), ("predicted", "int")))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model doesn't reject (a score below 0.5), with the columns of ``docs``.

    Every row is judged by its own text alone, whatever its doc_id. Null and empty texts count as in ``score``.
    """
    def task():
        like = Similarities(Landmarks(model.landmarks))

        def each(batch: pa.RecordBatch):
            texts = batch.column(batch.num_columns - 1)
            p = np.concatenate([model.probability(like.of(texts.slice(i, 256).to_pylist())) for i in range(0, batch.num_rows, 256)])
            kept = batch.filter(pa.array(p < 0.5))
            return {name: kept.column(i) for i, name in enumerate(docs_columns)} if kept.num_rows else None
        return each

    docs_columns = docs.columns
    return map_rows(docs.withColumn("__toxicity_text", F.coalesce(F.col("text").cast("string"), F.lit(""))), task, docs.schema)


def held_out(doc_id):
    """Whether a row must not be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
