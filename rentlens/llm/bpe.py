"""Byte-level BPE encoding and decoding.

Merging uses a rank queue: one bucket per merge rank holds the positions (in a
linked list of the current parts) at which a pair of that rank stood when it
was pushed, and a bitmap in two levels tells which buckets are filled. The next
merge is the first set bit; within a rank the leftmost position goes first.
Entries whose pair has changed since are stale and skipped. A text of n bytes
costs O(n) pushes, each with one find-first-set, so very long pre-tokens (runs
of letters without a space) do not turn quadratic.

``merge`` runs the queue over one pre-token. ``merge_many`` runs one queue over
all new pre-tokens of a group of texts: as pre-tokens do not touch each other,
the lowest rank of the whole queue is the lowest of every pre-token in its
bucket, so a bucket's leftmost position of every pre-token is merged at once.

Texts are cut into chunks (an optional space and the characters up to the next
white space) of which each is a whole number of pre-tokens; the ids of short
chunks are remembered in a bounded table per Python worker.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import give_back, ship, struct_of

#: Unicode White_Space, which ``\s`` stands for in the tokenizer's pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks and pre-tokens longer than this are encoded but not remembered.
REMEMBER_CHARS = 40
#: The table of remembered chunks is emptied before a group of texts when it holds so many.
REMEMBER_ENTRIES = 250_000
#: Characters of texts encoded as one group, and chunks of a long text taken at a time.
GROUP_CHARS = 1 << 22
STRETCH = 1 << 18
#: Rows decoded at a time.
ROWS = 256
NO_PAIR = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bytes_table(path: str) -> pa.BinaryArray:
    """The bytes of every id (null where an id is not used)."""
    by_id = {r: t for t, r in read_ranks(path).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())


class Numbers(dict):
    """Chunks by number; a chunk not met before gets the next number and joins ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.count = 0

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = self.count
        self.count += 1
        self.fresh.append(chunk)
        return n


class Vocabulary:
    """Ranks of a rank file (one base64 token and its rank a line) and the merges that they imply."""

    def __init__(self, path: str, pattern: str):
        ranks = self.ranks = read_ranks(path)
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: rank of the pair (a, b) under the key a << 20 | b, for every split of every token into two tokens
        self.pairs = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t))
                      if t[:i] in ranks and t[i:] in ranks}
        self.chunk = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
        spelled = pattern.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
        self.pretoken = regex.compile(spelled)
        order = sorted(self.pairs)
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in order], np.int32)
        self.forget()

    def forget(self) -> None:
        """Empties the table of remembered chunks: their numbers, and the ids by number."""
        self.known = Numbers()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank first, the leftmost pair of that rank first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs, n = self.pairs, len(piece)
        part = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        summary = 0
        for i in range(n - 1):
            r = pairs.get(part[i] << 20 | part[i + 1])
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 6
                    words[w] = words.get(w, 0) | 1 << (r & 63)
                    summary |= 1 << w
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            r = w << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                bits &= bits - 1
                words[w] = bits
                if not bits:
                    summary ^= 1 << w
            j = after[i]
            if part[i] < 0 or j >= n or pairs.get(part[i] << 20 | part[j]) != r:
                continue
            k = after[j]
            part[i], part[j], after[i] = r, -1, k
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    q = pairs.get(part[a] << 20 | part[b])
                    if q is not None:
                        if q in buckets:
                            heappush(buckets[q], a)
                        else:
                            buckets[q] = [a]
                            x = q >> 6
                            words[x] = words.get(x, 0) | 1 << (q & 63)
                            summary |= 1 << x
        return [p for p in part if p >= 0]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NO_PAIR))

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in order, number of ids of each), by one rank queue over all of them."""
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        n = int(ends[-1])  # stands for no position
        part = np.append(np.array(self.single, np.int32)[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(-1))
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = before[ends - sizes] = n
        rank = np.full(n + 1, NO_PAIR, np.int32)
        inner = np.flatnonzero(after[:n] < n).astype(np.int32)
        rank[inner] = self._rank_of(part[inner], part[after[inner]])
        buckets: dict[int, list[np.ndarray]] = {}  # by word, that is, 64 ranks
        summary = 0

        def push(at: np.ndarray) -> int:
            word = rank[at] >> 6
            order = np.argsort(word, kind="stable")
            at, word = at[order], word[order]
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            filled = 0
            for w, lo, hi in zip(word[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(at)]):
                buckets.setdefault(w, []).append(at[lo:hi])
                filled |= 1 << w
            return filled

        if len(some := inner[rank[inner] < NO_PAIR]):
            summary = push(some)
        while summary:
            w = (summary & -summary).bit_length() - 1
            held = buckets.pop(w)
            at = np.concatenate(held) if len(held) > 1 else held[0]
            ranks = rank[at]
            r = int(ranks.min(initial=NO_PAIR, where=ranks >> 6 == w))  # the first set bit of the word
            if r >> 6 != w:  # only stale entries were left
                summary ^= 1 << w
                continue
            rest = at[(ranks != r) & (ranks >> 6 == w)]
            at = np.unique(at[ranks == r])
            leftmost = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            buckets[w] = [x for x in (rest, at[~leftmost]) if len(x)]
            if not buckets[w]:
                del buckets[w]
                summary ^= 1 << w
            at = at[leftmost]
            middle = after[at]
            right, left = after[middle], before[at]
            part[at], part[middle], after[at], before[right] = r, -1, right, at
            rank[middle] = rank[at] = NO_PAIR
            has = at[right < n]
            rank[has] = self._rank_of(part[has], part[after[has]])
            to = left[left < n]
            rank[to] = self._rank_of(part[to], part[after[to]])
            new = np.concatenate([has, to])
            new = new[rank[new] < NO_PAIR]
            if len(new):
                summary |= push(new)
        part = part[:n]
        alive = part >= 0
        return part[alive], np.bincount(owner[alive], minlength=len(pieces))

    def _learn(self) -> None:
        """Adds the ids of the fresh chunks to the table. Long ones are merged one by one and keep
        their number for the present group only."""
        chunks, self.known.fresh = self.known.fresh, []
        if not chunks:
            return
        long = [k for k, c in enumerate(chunks) if len(c) > REMEMBER_CHARS]
        own = [[i for p in self.pretoken.findall(chunks[k]) for i in self.merge(p.encode())] for k in long]
        for k in long:
            del self.known[chunks[k]]
            chunks[k] = ""
        pieces = [self.pretoken.findall(c) for c in chunks]
        number = {p: k for k, p in enumerate(dict.fromkeys(chain.from_iterable(pieces)))}
        per_chunk = np.array([len(x) for x in pieces])
        at = np.array([number[p] for x in pieces for p in x], np.int64)
        del pieces
        raw = [p.encode() for p in number]
        whole = [self.ranks.get(p) for p in raw]
        is_open = np.array([r is None for r in whole], bool)
        sizes = np.ones(len(raw), np.int64)
        merged = np.zeros(0, np.int32)
        if is_open.any():
            merged, sizes[is_open] = self.merge_many([p for p, r in zip(raw, whole) if r is None])
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        flat[np.repeat(is_open, sizes)] = merged
        flat[starts[~is_open]] = [r for r in whole if r is not None]
        chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
        lengths = np.bincount(chunk_of, sizes[at], minlength=len(chunks)).astype(np.int64)
        lengths[long] = [len(x) for x in own]
        is_long = np.zeros(len(chunks), bool)
        is_long[long] = True
        new = np.empty(int(lengths.sum()), np.int32)
        of_long = np.repeat(is_long, lengths)
        new[~of_long] = _gather(flat, starts[at], sizes[at])
        new[of_long] = np.fromiter(chain.from_iterable(own), np.int32)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.sizes = np.concatenate([self.sizes, lengths])
        self.flat = np.concatenate([self.flat, new])

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each whole text, without special tokens. Texts are worked on in groups, long ones in
        stretches of chunks, so only the ids grow with a text's length."""
        held: list[tuple[np.ndarray, bool]] = []  # numbers of chunks, and whether they end a text
        size, parts = 0, []

        def flush() -> Iterator[np.ndarray]:
            nonlocal parts
            self._learn()
            for numbers, ends in held:
                parts.append(_gather(self.flat, self.starts[numbers], self.sizes[numbers]))
                if ends:
                    yield np.concatenate(parts)
                    parts = []
            if self.known.count >= REMEMBER_ENTRIES or len(self.flat) > 16 * REMEMBER_ENTRIES:
                self.forget()

        for text in texts:
            found = (m[0] for m in self.chunk.finditer(text)) if len(text) > STRETCH else iter(self.chunk.findall(text))
            ends = False
            while not ends:
                chunks = list(islice(found, STRETCH))
                ends = len(chunks) < STRETCH
                held.append((np.fromiter(map(self.known.__getitem__, chunks), np.int32, len(chunks)), ends))
                size += sum(map(len, chunks)) if len(text) > STRETCH else len(text)
                if size >= GROUP_CHARS:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start:start + size]."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """doc_id and the ids (array of int) of every row's whole text.

    A null or empty text has no ids. Rows that repeat are encoded alike; an
    empty table gives an empty result; further columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), (out, "array<int>"))
    arrow = to_arrow_schema(schema)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(vocabulary, pattern)
        try:
            yield from encoded(vocab, batches)
        finally:
            del vocab
            give_back()

    def encoded(vocab: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for part in _slices(batch) for t in part.column(1).to_pylist())
            lo, held, size = 0, [], 0
            for n, ids in enumerate(vocab.encode_all(texts), 1):
                held.append(ids)
                size += len(ids)
                if size >= GROUP_CHARS // 4 or n == batch.num_rows:
                    offsets = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n - lo), lists.cast(arrow.field(1).type)], schema=arrow)
                    lo, held, size = n, [], 0

    src = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns of ``tokens`` and the bytes that its ids stand for (null ids: no bytes).

    An id outside the vocabulary raises an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    position = tokens.columns.index(ids)
    schema = struct_of(*((f.name, f.dataType) for f in tokens.schema), (out, "binary"))
    arrow = to_arrow_schema(schema)
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_table(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                decoded = []
                for row in part.column(position):
                    got = table.take(row.values) if row.is_valid else table.slice(0, 0)
                    if got.null_count:
                        raise ValueError("an id is not in the vocabulary")
                    _, offsets, data = got.buffers()
                    at = np.frombuffer(offsets, np.int32)[[got.offset, got.offset + len(got)]] if len(got) else (0, 0)
                    decoded.append(bytes(memoryview(data)[at[0]:at[1]]) if len(got) else b"")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], schema=arrow)

    return tokens.mapInArrow(run, schema)


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows with ids and decoded bytes."""
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
