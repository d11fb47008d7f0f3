"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly when a value lies within
floor(r/2) bits of the one and ceil(r/2) bits of the other. So every distinct
fingerprint emits all its variants within half the radius, variants are
shuffled by value, and fingerprints that meet are verified by their bit
distance. A bucket holds distinct fingerprints of one ball (65 for r = 2), so
it is bounded whatever the number of copies. Members of a bucket link to its
smallest inner member only: all of them lie within r bits of it, so the
components are those of all pairs, with a number of links linear in the
number of fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rentlens.llm.common import connected_components, keep_rows, map_rows, materialize, struct_of, text_bytes

SEED = 42
#: Hashes are turned into bit counts in blocks of so many shingles, which bounds memory on very long texts.
BLOCK = 1 << 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash (unsigned) of the word shingles of a text.

    A-Z are lower-cased, words are split at ASCII white space, shingles are
    joined by one space and hashed by XXH64. Fewer words than a shingle form
    one shingle; no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:] - 1
    h, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at:min(at + BLOCK, n)].tolist(),
                                                                 last[at:at + BLOCK].tolist())], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row; a null text is empty."""
    def task():
        def each(batch: pa.RecordBatch):
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}
        return each

    src = docs.select("doc_id", text_bytes().alias("b"))
    return map_rows(src, task, struct_of(("doc_id", docs.schema["doc_id"].dataType), ("fp", "long")))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def ball(radius: int) -> list[tuple[int, int]]:
    """All masks of at most ``radius`` bits, as signed longs, with their number of bits."""
    return [(_signed(sum(1 << b for b in bits)), n) for n in range(radius + 1) for bits in combinations(range(64), n)]


def ball_links(distinct: DataFrame, max_distance: int = 2) -> DataFrame:
    """Distinct verified links (a, b) between representatives of ``distinct`` (fp, rep) that
    connect all fingerprints within ``max_distance`` bits of each other."""
    inner, outer = max_distance // 2, (max_distance + 1) // 2
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n <= inner).alias("inner")) for m, n in ball(outer)])
    met = (distinct.select("fp", "rep", F.explode(masks).alias("m"))
           .select(F.col("fp").bitwiseXOR(F.col("m.mask")).alias("variant"), "rep", "m.mask", "m.inner"))
    w = Window.partitionBy("variant")
    hub = F.min(F.when(F.col("inner"), F.struct("rep", "mask"))).over(w)
    apart = F.bit_count(F.col("mask").bitwiseXOR(F.col("hub.mask")))
    return (met.withColumn("hub", hub).where((F.col("rep") != F.col("hub.rep")) & (apart <= max_distance))
            .select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits. Rows with equal texts (also rows that
    repeat a doc_id) share a fingerprint and so a component. Null and empty
    texts have fingerprint zero, which links like any other. A null doc_id
    takes the component of its fingerprint (null when no row has an id).
    """
    fps = materialize(fingerprints(docs, shingle))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(ball_links(distinct.where("rep IS NOT NULL"), max_distance))
    label = (distinct.join(roots, distinct["rep"] == roots["node"], "left")
             .select(F.col("fp").alias("k"), F.coalesce("root", "rep").alias("component_id")))
    label = materialize(label)
    return fps.join(label, fps["fp"] == label["k"]).select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The documents that stay: the smallest doc_id of every component (rows without a doc_id go
    with the document of their component; they stay when it has none)."""
    found = near_duplicates(docs, shingle, max_distance)
    return keep_rows(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
