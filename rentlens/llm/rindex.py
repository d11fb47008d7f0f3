"""Repeated passages by run-length indexes of the corpus (suffix-array style deduplication).

A byte goes if a string of ``length`` bytes that covers it also starts earlier.

1. Anchors. Every window of ``length`` bytes is owned by the leftmost of its smallest hashed k-grams (its
   anchor), so equal windows own equal anchors. Neighbouring windows of one anchor form a stretch.
2. Meeting. Stretches are shuffled by anchor. Of stretches equal in every byte (anchor and a second hash)
   all but the earliest are repeats as a whole. Anchors with one distinct stretch need no more.
3. Index. The distinct stretches of the other anchors are fetched and indexed in blocks: their windows are
   sorted by prefix doubling, which gives a Burrows-Wheeler transform, kept as runs. The earliest window of an
   interval of equal windows is sampled only where a run ends inside the interval or the interval changes
   size; everywhere else the match pointer of a position is its predecessor's plus one, so streaming the
   pointers along the text yields the matching statistics: where the pointer leads to an earlier place, at
   least ``length`` bytes match.

An anchor with more distinct stretches than a block may hold is resolved by the hashes of its windows in a
partially aggregated group-by instead, so no block and no task grows with a common phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import map_rows, materialize, ship, struct_of, text_bytes

GRAM = 32
#: Bytes of text worked on at a time; positions within them fit into POSITION_BITS.
CHUNK = 1 << 21
POSITION_BITS = 24
#: Bytes of stretches in one index.
BLOCK = 1 << 22
#: Distinct stretches of one anchor from which its windows are hashed instead.
HOT_STRETCHES = 20_000
#: A stretch's start and its number of windows travel as one number; it has fewer windows than this.
WINDOWS = 1 << 12

_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << POSITION_BITS) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling the hashed length."""
    h, n = _BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) % (1 << 64) | 1) + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def stretches(texts: list[bytes], length: int):
    """(text number, start, windows, anchor hash) of every stretch of windows with one anchor, in order."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = gram_hashes(data)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    n, want = 1, length - GRAM + 1
    while n * 2 <= want:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if want > n:
        least = np.minimum(least[:n - want], least[want - n:])
    owner = (least & _LOW).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int64)
    long = sizes >= length
    np.add.at(edge, starts[:-1][long], 1)
    np.add.at(edge, starts[:-1][long] + sizes[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[:len(owner)] > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    which = np.searchsorted(starts, at, side="right") - 1
    own = owner[at]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (which[1:] != which[:-1])])
    return which[first], at[first] - starts[which[first]], np.diff(np.r_[first, len(at)]), h[own[first]]


def _pieces(ids: list[int], texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of about CHUNK bytes of (ids, offsets, texts); long texts are cut so that every window is in one piece."""
    held, offsets, parts, size = [], [], [], 0
    for i, t in zip(ids, texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[at:at + CHUNK + length - 1] if len(t) > CHUNK else t
            held.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield held, offsets, parts
                held, offsets, parts, size = [], [], [], 0
    if held:
        yield held, offsets, parts


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """Stretches (h, sig, doc, at, more): ``at`` is start * WINDOWS + windows. Of equal stretches in the same
    piece of a batch only the earliest is a row; the others are known repeats and travel packed, one row
    per text with a hash of its key for ``h`` and their ``at`` in ``more``, so a common passage makes no
    partition heavier."""
    def task():
        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in ("h", "sig", "doc", "at", "more")}
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for ids, offsets, texts in _pieces(part.column(0).to_pylist(), part.column(1).to_pylist(), length):
                    which, start, windows, h = stretches(texts, length)
                    if not len(h):
                        continue
                    sig = np.array([xxhash.xxh64_intdigest(texts[w][a:a + n + length - 1]) for w, a, n in
                                    zip(which.tolist(), start.tolist(), windows.tolist())], np.uint64)
                    doc = np.array(ids, np.int64)[which]
                    start = start + np.array(offsets, np.int64)[which]
                    order = np.lexsort((start, doc, sig, h))
                    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (sig[order][1:] == sig[order][:-1])]
                    first = np.sort(order[~same])  # in text order again, which compresses better
                    at = start * WINDOWS + windows
                    out["h"].append(h[first].view(np.int64))
                    out["sig"].append(sig[first].view(np.int64))
                    out["doc"].append(doc[first])
                    out["at"].append(at[first])
                    out["more"].append(pa.nulls(len(first), pa.binary()))
                    later = np.sort(order[same])
                    if len(later):
                        cut = np.flatnonzero(np.r_[True, doc[later][1:] != doc[later][:-1]])
                        texts_of = doc[later][cut]
                        out["h"].append((texts_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                        out["sig"].append(np.zeros(len(cut), np.int64))
                        out["doc"].append(texts_of)
                        out["at"].append(np.zeros(len(cut), np.int64))
                        out["more"].append(pa.array([x.tobytes() for x in np.split(at[later], cut[1:])], pa.binary()))
            if not out["h"]:
                return None
            return {c: pa.chunked_array(v).combine_chunks() if c == "more" else np.concatenate(v) for c, v in out.items()}
        return each

    return map_rows(docs, task, struct_of(("h", "long"), ("sig", "long"), ("doc", "long"), ("at", "long"), ("more", "binary")))


FOUND = (("kind", "int"), ("h", "long"), ("doc", "long"), ("start", "long"), ("windows", "long"))
REPEAT, OPEN = 0, 1


def _frames(batches: Iterator[pa.RecordBatch], rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _over(df: DataFrame, rows, schema) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: _frames(batches, rows, arrow), schema)


def meet(met: DataFrame) -> DataFrame:
    """REPEAT rows (whole repeats) and OPEN rows (the earliest of every distinct stretch of an anchor that has
    several). Streams the sorted rows of a partition; carries one row between batches."""
    def rows(batches):
        last = None  # (h, sig) of the last row
        pending = None  # the only distinct stretch so far of the last h
        for batch in batches:
            h, sig, doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            packed = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            blobs = [batch.column(4)[i].as_py() for i in np.flatnonzero(packed).tolist()]
            known_doc, known_at = np.repeat(doc[packed], [len(b) // 8 for b in blobs]), np.frombuffer(b"".join(blobs), np.int64)
            h, sig, doc, at = h[~packed], sig[~packed], doc[~packed], at[~packed]
            if not len(h):
                if len(known_doc):
                    yield (np.full(len(known_doc), REPEAT, np.int32), np.zeros(len(known_doc), np.int64), known_doc,
                           known_at // WINDOWS, known_at % WINDOWS)
                continue
            prev_h, prev_sig = (np.r_[x[:1] if last is None else [last[i]], x[:-1]] for i, x in ((0, h), (1, sig)))
            new_h = h != prev_h
            new = new_h | (sig != prev_sig)
            if last is None:
                new_h[0] = new[0] = True
            last = (int(h[-1]), int(sig[-1]))
            # whole repeats: later rows, and those that came packed
            doc_r, at_r = [doc[~new], known_doc], [at[~new], known_at]
            # distinct stretches of anchors that have several
            f = np.flatnonzero(new)
            before = np.r_[not new_h[f[0]] if len(f) else False, (h[f][1:] == h[f][:-1])][:len(f)] if len(f) else np.zeros(0, bool)
            after = np.r_[h[f][1:] == h[f][:-1], False][:len(f)] if len(f) else np.zeros(0, bool)
            open_ = before | after
            h_o, doc_o, at_o = [h[f][open_]], [doc[f][open_]], [at[f][open_]]
            if pending is not None and len(f):
                if not new_h[f[0]] and h[f[0]] == pending[0]:
                    for held, value in zip((h_o, doc_o, at_o), pending):
                        held.append(np.array([value]))
                    pending = None
                elif h[f[-1]] != pending[0]:
                    pending = None
            if len(f) and not open_[-1]:
                pending = (int(h[f[-1]]), int(doc[f[-1]]), int(at[f[-1]]))
            elif len(f) and open_[-1]:
                pending = None
            doc_r, at_r, h_o, doc_o, at_o = map(np.concatenate, (doc_r, at_r, h_o, doc_o, at_o))
            n, m = len(doc_r), len(h_o)
            if n + m:
                at_all = np.r_[at_r, at_o]
                yield (np.r_[np.full(n, REPEAT), np.full(m, OPEN)].astype(np.int32), np.r_[np.zeros(n, np.int64), h_o],
                       np.r_[doc_r, doc_o], at_all // WINDOWS, at_all % WINDOWS)

    return _over(met.repartition("h").sortWithinPartitions("h", "sig", "doc", "at"), rows, struct_of(*FOUND))


def repeated_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of each stretch (in text order) also stands earlier in ``data``.

    ``data`` is the stretches' concatenation; stretch i begins at starts[i] and has windows[i] windows.
    """
    # ranks of all strings of 8, 16, ... bytes by prefix doubling, and of ``length`` bytes by two overlapping ones
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for b in range(8):
        key = key << np.uint64(8) | wide[b:len(data) + b]
    rank = _ranks(key)
    n = 8
    while n * 2 <= length:
        rank = _ranks(rank[:-n].astype(np.uint64) << np.uint64(32) | rank[n:].astype(np.uint64))
        n *= 2
    at = np.repeat(starts, windows) + _ramp(windows)  # the windows, in text order
    if length > n:
        rank = _ranks(rank[at].astype(np.uint64) << np.uint64(32) | rank[at + length - n].astype(np.uint64))
    else:
        rank = _ranks(rank[at])
    order = np.argsort(rank, kind="stable")  # the suffix array, equal windows in text order
    sorted_rank = rank[order]
    head = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])
    size = np.diff(np.r_[head, len(order)])
    inside = np.zeros(len(at), bool)  # whether a window has a predecessor in its stretch
    inside[1:] = at[1:] == at[:-1] + 1
    inside[np.concatenate(([0], np.cumsum(windows)[:-1]))] = False
    before = np.where(inside, data[at - 1], 256 + np.arange(len(at)) % 2)  # a stretch's begin never continues a run
    bwt = before[order]
    run_end = np.r_[False, (bwt[1:] != bwt[:-1]) | (bwt[1:] > 255)]  # a run starts at this row
    run_end[head] = False  # only those inside an interval count
    mixed = np.add.reduceat(run_end.astype(np.int64), head) > 0
    group = np.empty(len(at), np.int64)
    group[order] = np.repeat(np.arange(len(head)), size)
    sampled = ~inside | mixed[group]
    sampled[1:] |= size[group[1:]] != size[group[:-1]]
    # stream: sampled pointers lead to the interval's earliest window, the others follow their predecessor
    here = np.arange(len(at))
    from_ = np.maximum.accumulate(np.where(sampled, here, 0))
    earliest = order[head]  # equal windows are in text order
    pointer = earliest[group[from_]] + (here - from_)
    return pointer < here


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
    return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def indexed_repeats(open_: DataFrame, length: int) -> DataFrame:
    """(doc, start, windows) of runs of repeated windows among stretches (h, doc, start, windows, bytes)."""
    def rows(batches):
        held: list[tuple] = []
        size, last = 0, None

        def solve():
            data = np.frombuffer(b"".join(r[4] for r in held), np.uint8)
            windows = np.array([r[3] for r in held])
            starts = np.concatenate(([0], np.cumsum([len(r[4]) for r in held])[:-1]))
            hit = repeated_windows(data, starts, windows, length)
            which, offset = np.repeat(np.arange(len(held)), windows), _ramp(windows)
            at = np.flatnonzero(hit)
            if not len(at):
                return None
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])])
            doc, start = np.array([r[1] for r in held]), np.array([r[2] for r in held])
            return doc[which[at[first]]], start[which[at[first]]] + offset[at[first]], np.diff(np.r_[first, len(at)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[0] != last:
                    if (found := solve()) is not None:
                        yield found
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held and (found := solve()) is not None:
            yield found

    src = (open_.select("h", "doc", "start", "windows", "bytes").repartition("h")
           .sortWithinPartitions("h", "doc", "start"))
    return _over(src, rows, struct_of(("doc", "long"), ("start", "long"), ("windows", "long")))


def hashed_repeats(open_: DataFrame, length: int) -> DataFrame:
    """As ``indexed_repeats``, by two 64-bit hashes of every window."""
    def task():
        def each(batch: pa.RecordBatch):
            a, b, doc, start = [], [], [], []
            for d, s, n, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                for k in range(n):
                    w = t[k:k + length]
                    a.append(xxhash.xxh64_intdigest(w, 1))
                    b.append(xxhash.xxh64_intdigest(w, 2))
                    doc.append(d)
                    start.append(s + k)
            return {"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64), "doc": doc, "start": start}
        return each

    every = map_rows(open_.select("h", "doc", "start", "windows", "bytes"), task,
                     struct_of(("a", "long"), ("b", "long"), ("doc", "long"), ("start", "long")))
    first = every.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("first"))
    return (every.join(first, ["a", "b"]).where(F.struct("doc", "start") > F.col("first"))
            .select("doc", "start", F.lit(1).cast("long").alias("windows")))


def repeated_spans(docs: DataFrame, length: int = 100, hot: int = HOT_STRETCHES) -> DataFrame:
    """(doc, start, end): byte spans covered by repeats; they may overlap. ``docs`` is (doc, b) with
    distinct integer keys, whose order tells which text is earlier."""
    found = materialize(meet(anchored(docs, length)))
    open_ = found.where(F.col("kind") == OPEN)
    per_doc = open_.groupBy(F.col("doc").alias("k")).agg(F.collect_list(F.struct("start", "windows", "h")).alias("at"))

    def task():
        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in ("h", "doc", "start", "windows", "bytes")}
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                for x in at:
                    out["h"].append(x["h"])
                    out["doc"].append(doc)
                    out["start"].append(x["start"])
                    out["windows"].append(x["windows"])
                    out["bytes"].append(text[x["start"]:x["start"] + x["windows"] + length - 1])
            return out
        return each

    fetched = map_rows(docs.join(per_doc, docs["doc"] == per_doc["k"]).select("doc", "b", "at"), task,
                       struct_of(("h", "long"), ("doc", "long"), ("start", "long"), ("windows", "long"), ("bytes", "binary")))
    common = materialize(open_.groupBy("h").count().where(F.col("count") > hot).select(F.col("h").alias("hot_h")))
    if common.isEmpty():
        late = indexed_repeats(fetched, length)
    else:
        fetched = materialize(fetched)
        late = (indexed_repeats(fetched.join(common, fetched["h"] == common["hot_h"], "left_anti"), length)
                .union(hashed_repeats(fetched.join(common, fetched["h"] == common["hot_h"], "left_semi"), length)))
    whole = found.where(F.col("kind") == REPEAT).select("doc", "start", "windows")
    return whole.union(late).select("doc", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, b, doc_id) with integer keys ``doc`` in the order of doc_id, and one row (doc, b) per key.

    The key is doc_id itself where that is a key of the table. Otherwise rows are numbered in the order of
    doc_id (null last) and of a hash of their text; rows equal in both share a number and are one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b"))
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        rows = rows.select(F.col("doc_id").alias("doc"), "b", "doc_id")
        return rows, rows.select("doc", "b")
    rows = rows.withColumn("th", F.xxhash64("b"))
    keys = materialize(rows.select("doc_id", "th").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "th")
                       .select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").alias("k"), F.col("th").alias("kt")))
    rows = materialize(rows.join(keys, rows["doc_id"].eqNullSafe(keys["k"]) & (rows["th"] == keys["kt"])).select("doc", "b", "doc_id"))
    return rows, rows.dropDuplicates(["doc"]).select("doc", "b")


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT_STRETCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (maximal removed runs: start, end), kept (bytes).

    Texts are UTF-8 bytes, null ones empty. A text shorter than ``length`` has no spans. Rows that repeat
    doc_id and text are one document and get equal results; rows that repeat a doc_id with another text
    are documents of their own (see ``keyed``). An empty table gives an empty result.
    """
    if not GRAM <= length < WINDOWS:
        raise ValueError(f"length must be from {GRAM} to {WINDOWS - 1}")
    rows, one = keyed(docs)
    spans = materialize(repeated_spans(one, length, hot))
    per_doc = spans.groupBy(F.col("doc").alias("k")).agg(F.collect_list(F.struct("start", "end")).alias("cut"))

    def task():
        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {"n_bytes": [], "spans": [], "kept": []}
            for text, cut in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                merged: list[list[int]] = []
                for x in sorted((c["start"], c["end"]) for c in cut or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out["n_bytes"].append(len(text))
                out["spans"].append([{"start": a, "end": b} for a, b in merged])
                out["kept"].append(b"".join(kept))
            return {"doc_id": batch.column(0), **out}
        return each

    joined = rows.join(per_doc, rows["doc"] == per_doc["k"], "left").select("doc_id", "b", "cut")
    return map_rows(joined, task, struct_of(("doc_id", "long"), ("n_bytes", "long"),
                                            ("spans", "array<struct<start:bigint,end:bigint>>"), ("kept", "binary")))


def span_digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats`` rows."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digest_sql(length: int = 100) -> str:
    """DuckDB SQL of ``span_digest`` over the table ``documents``: every window of every text."""
    return f"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
windows AS (SELECT doc_id, i, md5(array_slice(t, i + 1, i + {length})) AS w
            FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - {length - 1})) AS i FROM docs WHERE octet_length(t) >= {length})),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= {length} THEN 0 ELSE 1 END AS begins FROM ranked WHERE nth > 1
           WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT s.doc_id, max(b), max(octet_length(t)) FROM spans s JOIN docs USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT g.doc_id, string_agg(hex(array_slice(t, a + 1, b)), '' ORDER BY a) FILTER (WHERE b > a) AS k FROM gaps g JOIN docs USING (doc_id)
         GROUP BY g.doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans FROM spans GROUP BY doc_id),
out AS (SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_spans, 0) AS n_spans,
               CASE WHEN n_spans IS NULL THEN hex(t) ELSE coalesce(k, '') END AS k
        FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id))
SELECT doc_id, n_bytes, n_bytes - length(k) // 2 AS n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM out"""
