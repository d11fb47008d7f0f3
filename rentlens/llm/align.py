"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often in the corpus.

1. *Encode and align*: every text is encoded by both tokenizers, token lengths
   in bytes give both sets of cut positions. Every stretch between neighbouring
   cuts (of either) is one link: exactly one token of each side covers it.
   Positions where both cut end a group. Ids are written; a task also hands on
   the id pairs that it meets for the first time.
2. *Minimal perfect hash* of the distinct pairs: pairs are dealt into buckets,
   each bucket builds cascaded bitmaps in its own task (a pair is placed on the
   first level where no other pair of the bucket shares its bit); a pair's
   number is the rank of its bit. The pairs in that order verify every look-up.
3. *Count*: each task re-aligns its documents from the written ids and adds up
   one dense vector, indexed by the hash. Vectors are summed up a tree of
   ``FAN`` children a node, block by block.
4. *Look up*: documents are aligned again and add up the counts of their links.

Distinct pairs are bounded by the two vocabularies, not by the corpus. Still,
no task or broadcast holds more than SLICE_BUCKETS x BUCKET_KEYS of them:
buckets beyond that are counted and looked up in further passes of the same kind.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.bpe import _gather
from rentlens.llm.common import give_back, map_rows, ship, struct_of
from rentlens.session import materialize

#: Pairs of a bucket on average, and buckets whose pairs are held at a time.
BUCKET_KEYS, SLICE_BUCKETS = 1 << 16, 64
#: Children of a node of the summing tree, and counts of a block of a vector.
FAN, BLOCK = 16, 1 << 16
#: Characters of texts that are encoded and aligned as one group.
GROUP_CHARS = 1 << 18
#: Runs of white space on which tiktoken's pattern engine may give up.
LONG_BLANK = re.compile(r"\s{10000}")
#: The pattern of the plain byte-level pre-tokenizer.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A task forgets the words whose ids it knows when they are so many, or hold so many characters.
KNOWN_WORDS, KNOWN_CHARS = 1 << 18, 1 << 22
#: A task forgets the pairs that it has handed on when they are so many (they may then be handed on again).
SEEN_PAIRS = 1 << 22
#: Bits of the hash's first level for each pair of a bucket.
GAMMA = 2
#: Factor and modulus that deal pairs into buckets, and the constants of the splitmix64 finaliser.
FACTOR, MODULUS = 402653189, 4294967291
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


# --- tokenizers ---------------------------------------------------------------

class Tokenizer:
    """Ids of texts, and the bytes that every id stands for."""

    #: Whether no token crosses a space between two characters that are neither white space nor "▁", and what stands
    #: on its other side changes no token: then a text's tokens are those of its stretches between such spaces.
    by_words = False

    def __init__(self, raw: list[bytes]):
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each, whether the joined token bytes of each are the text's)."""
        ids = [np.array(self.ids(t), np.int32) for t in texts]
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        return flat, counts, self.spells(flat, counts, texts)

    def spells(self, flat: np.ndarray, counts: np.ndarray, texts: list[str]) -> np.ndarray:
        spelled = [t.encode() for t in texts]
        to = np.concatenate([[0], np.cumsum(self.sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])]
        joined = _gather(self.raw, self.starts[flat], self.sizes[flat]).tobytes()
        return np.array([joined[lo:hi] == want for lo, hi, want in zip(to, to[1:], spelled)], bool)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` of words with a space before each, none with white space or "▁" at an end: as one text if that
        can be cut into them again."""
        text = " " + " ".join(words)
        flat, _, (right,) = self.encode([text])
        if right:
            spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
            to = np.concatenate([[0], np.cumsum(self.sizes[flat])])
            at = np.searchsorted(to, spaces)
            if np.array_equal(to[at], spaces):
                return flat, np.diff(at, append=len(flat)), np.ones(len(words), bool)
        return self.encode([" " + w for w in words])


class Words:
    """Texts encoded by several tokenizers, each word once while it is remembered."""

    def __init__(self, *sides: Tokenizer):
        self.sides = sides
        self.by_words = all(s.by_words for s in sides)
        self.forget()

    def forget(self) -> None:
        #: number of each known word; -1: one that is not cut off its neighbours
        self.known: dict[str, int] = {}
        self.n_words = self.n_chars = 0
        #: of each side: ids of the known words one after the other, number of ids of each, whether their bytes are the word's
        self.held = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in self.sides]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``Tokenizer.encode`` of each side. Every text starts with a space."""
        if not self.by_words or not texts:
            return [s.encode(texts) for s in self.sides]
        if len(self.known) > KNOWN_WORDS or self.n_chars > KNOWN_CHARS:
            self.forget()
        split = [t[1:].split(" ") for t in texts]
        words = [w for s in split for w in s]
        self.learn(list(set(words).difference(self.known)))
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n_words = np.array([len(s) for s in split])
        first = np.cumsum(n_words) - n_words
        cut = np.ones(len(words), bool)
        cut[1:] = (number[1:] >= 0) & (number[:-1] >= 0)
        cut[first] = True
        units = np.flatnonzero(cut)  # the first word of every stretch
        ends = np.append(units[1:], len(words))
        odd = np.flatnonzero((number[units] < 0) | (ends - units > 1))
        stretches = [" " + " ".join(words[units[k]:ends[k]]) for k in odd]
        number, first = number[units], np.searchsorted(units, first)
        number[odd] = self.n_words + np.arange(len(odd))
        return [self._joined(s, held, stretches, number, first, texts) for s, held in zip(self.sides, self.held)]

    @staticmethod
    def _joined(side: Tokenizer, held: tuple, stretches: list[str], number: np.ndarray, first: np.ndarray, texts: list[str]):
        if stretches:
            held = tuple(map(np.concatenate, zip(held, side.encode(stretches))))
        store, counts, right = held
        sizes = counts[number]
        flat, n_ids = _gather(store, (np.cumsum(counts) - counts)[number], sizes), np.add.reduceat(sizes, first)
        good = np.logical_and.reduceat(right[number], first)
        if not good.all():  # the bytes of such a text as a whole decide
            bad = np.flatnonzero(~good)
            good[bad] = side.spells(flat[np.repeat(~good, n_ids)], n_ids[bad], [texts[k] for k in bad])
        return flat, n_ids, good

    def learn(self, words: list[str]) -> None:
        whole = [w for w in words if w and w.strip() == w]
        if "▁" in "".join(whole):
            whole = [w for w in whole if w.strip("▁") == w]
        if len(whole) < len(words):
            self.known.update(dict.fromkeys(words, -1))
        if whole:
            self.known.update(zip(whole, range(self.n_words, self.n_words + len(whole))))
            self.n_words += len(whole)
            self.held = [tuple(map(np.concatenate, zip(held, s.encode_words(whole)))) for s, held in zip(self.sides, self.held)]
        self.n_chars += sum(map(len, words))


class ByteLevel(Tokenizer):
    """A byte-level BPE file of the ``tokenizers`` library; special tokens in texts are plain text.

    Where the file's merges make the ids 256, 257, ... in order and its pre-tokenizer is the plain byte-level one,
    tiktoken encodes by the file's own vocabulary, several times faster; tests hold both libraries equal.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"] | {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        table = byte_level_table(vocab)
        super().__init__(table)
        self.path, pre, merges = path, made.get("pre_tokenizer") or {}, made["model"].get("merges", [])
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and not made.get("normalizer") and all(vocab.get("".join(m)) == 256 + n for n, m in enumerate(pairs)))
        self.fast = self.library = None
        if plain:
            import tiktoken
            ranks = {table[i]: i for t, i in made["model"]["vocab"].items()}
            self.fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.by_words = pattern == GPT2_PATTERN  # a space is a match's first character or in a run of white space

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not LONG_BLANK.search(text):
            return self.fast.encode_ordinary(text)
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Library
            self.library = Library.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


def byte_level_table(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of every id: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


class Pieces(Tokenizer):
    """A sentencepiece model that puts a space before the text. ``ids`` takes texts with that space in front."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        from sentencepiece import sentencepiece_model_pb2
        made = sentencepiece_model_pb2.ModelProto.FromString(m.serialized_model_proto())
        train, norm, kind = made.trainer_spec, made.normalizer_spec, made.SentencePiece
        # merges only, nothing normalised, and a space only ever before a piece's other characters
        self.by_words = (train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
                         and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
                         and not norm.remove_extra_whitespaces and not made.denormalizer_spec.precompiled_charsmap
                         and all(p.type in (kind.NORMAL, kind.BYTE, kind.UNKNOWN, kind.CONTROL) for p in made.pieces)
                         and not any("▁" in p.lstrip("▁") for p in pieces))

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


# --- alignment ----------------------------------------------------------------

def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the a token, number of the b token, whether a group ends) of every link, in order. ``a`` and ``b``
    are the ids of the same bytes."""
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    if not len(a):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    cut_a, cut_b = np.zeros(int(ends_a[-1]) + 1, bool), np.zeros(int(ends_a[-1]) + 1, bool)
    cut_a[ends_a], cut_b[ends_b] = True, True
    at = np.flatnonzero(cut_a | cut_b)
    cut_a, cut_b = cut_a[at], cut_b[at]
    return np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b, cut_a & cut_b


class Decimal:
    """Decimal ids, each with a character behind it, as rows of bytes filled up with zero bytes."""

    def __init__(self, n: int):
        width = len(str(n)) + 1
        text = [f"{i},".encode() for i in range(n)]
        self.rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in text), np.uint8).reshape(n, width)
        self.sizes = np.array([len(x) for x in text], np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(``a1,a2|b1;a3|b2;`` of all groups, end of every group in it); last_*: number of tokens to each group's end."""
        size_a, size_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + np.repeat(last_b - size_b, size_a)] = a
        ids[np.arange(len(b)) + np.repeat(last_a, size_b)] = b
        rows, sizes = self.rows.take(ids, axis=0), self.sizes.take(ids)
        end = last_a + last_b - 1
        rows[end - size_b, sizes[end - size_b] - 1] = ord("|")
        rows[end, sizes[end] - 1] = ord(";")
        return rows.tobytes().translate(None, b"\0"), np.cumsum(sizes)[end]


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: str) -> DataFrame:
    """One row per row of ``docs``: row (a number), doc_id, ids a and b, n_groups, n_links, groups_sha256, and the
    id pairs (a * number of b ids + b) that the row's task has not handed on before, on the last row of a group.

    A null or empty text, or one that either tokenizer does not give back byte for byte, has no tokens. Rows that
    repeat are rows of their own; an empty table gives an empty result; further columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = struct_of(("row", "bigint"), ("doc_id", docs.schema["doc_id"].dataType), ("a", "array<int>"), ("b", "array<int>"),
                       ("n_groups", "bigint"), ("n_links", "bigint"), ("groups_sha256", "string"), ("pairs", "array<bigint>"))

    arrow = to_arrow_schema(schema)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        try:
            for batch in batches:
                lo, size = 0, 0
                for n, length in enumerate(pc.utf8_length(batch.column(2)).to_pylist(), 1):
                    size += length + 8
                    if size >= GROUP_CHARS or n == batch.num_rows:
                        yield work(batch.slice(lo, n - lo))
                        lo, size = n, 0
        finally:
            del work
            give_back()

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        one, two = ByteLevel(byte_level, pattern), Pieces(pieces)
        decimal = Decimal(max(len(one.sizes), len(two.sizes)))
        base, seen = len(two.sizes), np.zeros(0, np.int64)
        words = Words(one, two)

        def group(texts: list[str]) -> list[tuple]:
            nonlocal seen
            spaced = [" " + t for t in texts]
            (a, n_a, right_a), (b, n_b, right_b) = words.encode(spaced)
            good = right_a & right_b & np.array([bool(t) for t in texts])
            a, n_a = a[np.repeat(good, n_a)], np.where(good, n_a, 0)
            b, n_b = b[np.repeat(good, n_b)], np.where(good, n_b, 0)
            ia, ib, last = links(a, b, one.sizes, two.sizes)
            codes = np.unique(a[ia].astype(np.int64) * base + b[ib])
            if len(seen):
                codes = codes[seen[np.minimum(np.searchsorted(seen, codes), len(seen) - 1)] != codes]
            seen = codes if len(seen) > SEEN_PAIRS else np.sort(np.concatenate([seen, codes]), kind="stable")
            last_a, last_b = ia[last] + 1, ib[last] + 1
            spelled, ends = decimal.groups(a, b, last_a, last_b) if len(a) else (b"", np.zeros(0, np.int64))
            to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
            to_link = np.searchsorted(ia, to_a)  # links up to the end of each text
            n_links, n_groups = np.diff(to_link, prepend=0), np.diff(np.searchsorted(last_a, to_a, "right"), prepend=0)
            stop = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_groups)])]
            out = []
            for k in range(len(texts)):
                piece = spelled[stop[k]:stop[k + 1] - 1] if good[k] else b""
                out.append((a[to_a[k] - n_a[k]:to_a[k]], b[to_b[k] - n_b[k]:to_b[k]], int(n_groups[k]), int(n_links[k]),
                            hashlib.sha256(piece).hexdigest() if good[k] else "", codes if k == len(texts) - 1 else None))
            return out

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b, groups, linked, sha, codes = zip(*group(batch.column(2).to_pylist()))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(a, pa.int32()), lists(b, pa.int32()), pa.array(groups, pa.int64()),
                 pa.array(linked, pa.int64()), pa.array(sha),
                 lists([np.zeros(0, np.int64) if c is None else c for c in codes], pa.int64())], schema=arrow)

        return each

    def lists(arrays, kind):
        kind_of = pa.list_(pa.field("element", kind))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind)).cast(kind_of)

    src = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return src.mapInArrow(run, schema)


# --- the minimal perfect hash -------------------------------------------------

def bucket_of(keys, buckets: int):
    """The bucket of pairs below 2^34; numpy numbers and Spark columns alike."""
    return keys * FACTOR % MODULUS % buckets


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((MIX[0] * (level + 1)) % (1 << 64))
        x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[1])
        x = (x ^ x >> np.uint64(27)) * np.uint64(MIX[2])
        return x ^ x >> np.uint64(31)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits as 64-bit words, the keys in the order of their numbers) of distinct keys."""
    sizes, words, order = [], [], []
    while len(keys):
        size = max(64, -(-GAMMA * len(keys) // 64) * 64)
        at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        order.append(keys[placed][np.argsort(at[placed])])
        sizes.append(size)
        keys = keys[~placed]
    return sizes, np.concatenate(words), np.concatenate(order)


class PerfectHash:
    """Numbers 0, 1, ... of the pairs in some neighbouring buckets."""

    def __init__(self, buckets: int, first: int, parts: list[tuple[list[int], bytes, bytes]]):
        """parts: of the buckets from ``first`` on, the levels' bits, their words and the keys."""
        self.buckets, self.first, self.n = buckets, first, len(parts)
        self.levels = max((len(p[0]) for p in parts), default=0)
        self.size = np.ones((self.n, self.levels), np.uint64)
        self.base = np.zeros((self.n, self.levels), np.int64)
        base = 0
        for k, (sizes, _, _) in enumerate(parts):
            for level, size in enumerate(sizes):
                self.size[k, level], self.base[k, level] = size, base
                base += size
        self.words = np.frombuffer(b"".join(p[1] for p in parts) + bytes(8), np.uint64)
        self.keys = np.frombuffer(b"".join(p[2] for p in parts), np.int64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(counts) - counts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key (all of them among the pairs hashed); each is verified against the stored pair."""
        out = np.full(len(keys), -1, np.int64)
        open_, left = np.arange(len(keys)), keys
        of = bucket_of(keys, self.buckets) - self.first
        for level in range(self.levels):
            at = self.base[of, level] + (mixed(left, level) % self.size[of, level]).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.ranks[at[hit] >> 6] + below
            open_, left, of = open_[~hit], left[~hit], of[~hit]
            if not len(left):
                break
        if len(left) or not np.array_equal(self.keys[out], keys):
            raise ValueError("a pair is not in the hash")
        return out


def hash_parts(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sizes, words, keys): the hash of every bucket of the distinct ``pairs`` (one column, pair)."""
    schema = struct_of(("bucket", "bigint"), ("sizes", "array<bigint>"), ("words", "binary"), ("keys", "binary"))
    ship(pairs.sparkSession)

    def one(table: pa.Table) -> pa.Table:
        sizes, words, order = build(table.column("pair").to_numpy())
        return pa.table({"bucket": table.column("bucket")[:1].combine_chunks(), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "words": pa.array([words.tobytes()], pa.binary()), "keys": pa.array([order.astype(np.int64).tobytes()], pa.binary())})

    dealt = pairs.select("pair", bucket_of(F.col("pair"), buckets).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(one, schema)


# --- counts -------------------------------------------------------------------

def _pairs_of(batch: pa.RecordBatch, a: int, b: int, size_a, size_b, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of every link, links up to the end of every row) of a batch with id columns number ``a`` and ``b``."""
    ids = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (a, b)]
    ia, ib, _ = links(*ids, size_a, size_b)
    ends = np.cumsum(np.diff(batch.column(a).offsets.to_numpy()))
    return ids[0][ia].astype(np.int64) * base + ids[1][ib], np.searchsorted(ia, ends)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct codes, the place of every code among them). Codes are below 2^34: with a place of their own below
    them they sort as plain numbers."""
    bits = len(codes).bit_length()
    if bits > 29:
        return np.unique(codes, return_inverse=True)
    packed = np.sort(codes << bits | np.arange(len(codes)))
    codes, at = packed >> bits, packed & ((1 << bits) - 1)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    of = np.empty(len(codes), np.int64)
    of[at] = np.cumsum(new) - 1
    return codes[new], of


def tally(aligned: DataFrame, held, in_slice, sizes) -> DataFrame:
    """(leaf, block, counts): each task's dense vector of link counts, cut into blocks."""
    schema = struct_of(("leaf", "bigint"), ("block", "bigint"), ("counts", "binary"))
    ship(aligned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (size_a, size_b) = held.value, sizes.value
        total = np.zeros(len(table.keys), np.int64)
        for batch in batches:
            codes, _ = _pairs_of(batch, 0, 1, size_a, size_b, len(size_b))
            some, n = np.unique(in_slice(codes), return_counts=True)
            total[table.find(some)] += n
        leaf = TaskContext.get().partitionId()
        for block in range(0, len(total) if total.any() else 0, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([block // BLOCK], pa.int64()),
                                              pa.array([total[block:block + BLOCK].tobytes()], pa.binary())], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return aligned.select("a", "b").mapInArrow(run, schema)


def tree_sum(vectors: DataFrame, leaves: int) -> DataFrame:
    """(block, counts) summed over the leaves, FAN nodes at a time."""
    schema = vectors.schema

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("counts").to_pylist():
            x = np.frombuffer(x, np.int64)
            total = x.copy() if total is None else total + x
        return pa.table({"leaf": table.column("leaf")[:1].combine_chunks(), "block": table.column("block")[:1].combine_chunks(),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    while leaves > FAN:
        vectors = vectors.withColumn("leaf", F.floor(F.col("leaf") / FAN)).groupBy("leaf", "block").applyInArrow(add, schema)
        leaves = -(-leaves // FAN)
    vectors = vectors.withColumn("leaf", F.lit(0).cast("long")).groupBy("leaf", "block").applyInArrow(add, schema)
    return vectors.select("block", "counts")


def alignment_counts(docs: DataFrame, byte_level: str, pattern: str, pieces: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a token of each side that share a byte; a pair's count is its links in the whole corpus; n_best counts
    links whose pair has the highest count of its b id (ties included); count_sum adds up the links' counts. See
    ``align`` for nulls, texts without tokens, repeated rows and empty tables.
    """
    spark = docs.sparkSession
    aligned = materialize(align(docs, byte_level, pattern, pieces))
    pairs = materialize(aligned.select(F.explode("pairs").alias("pair")).distinct())
    n_pairs = pairs.count()
    buckets = -(-n_pairs // BUCKET_KEYS) or 1
    parts = materialize(hash_parts(pairs, buckets))
    sizes = spark.sparkContext.broadcast(tuple(t.sizes for t in (ByteLevel(byte_level, pattern), Pieces(pieces))))
    if any((s == 0).any() for s in sizes.value):
        raise ValueError("a token stands for no byte")
    base = len(sizes.value[1])
    leaves = aligned.select("a").rdd.getNumPartitions() if n_pairs else 0
    slices, best = [], np.zeros(base, np.int64)
    for first in range(0, buckets, SLICE_BUCKETS):
        some = parts.where(F.col("bucket").between(first, first + SLICE_BUCKETS - 1)).orderBy("bucket")
        got = {r.bucket: (list(r.sizes), bytes(r["words"]), bytes(r["keys"])) for r in some.collect()}
        none = ([], b"", b"")
        held = spark.sparkContext.broadcast(PerfectHash(buckets, first, [got.get(first + k, none) for k in range(min(SLICE_BUCKETS, buckets - first))]))
        del got

        def in_slice(codes: np.ndarray, first: int = first) -> np.ndarray:
            if buckets <= SLICE_BUCKETS:
                return codes
            of = bucket_of(codes, buckets)
            return codes[(of >= first) & (of < first + SLICE_BUCKETS)]

        counts = materialize(tree_sum(tally(aligned, held, in_slice, sizes), leaves))
        for r in _best(counts, held, base).collect():  # one row per b id at most
            best[r.b] = max(best[r.b], r.top)
        slices.append((first, held, counts))
    best = spark.sparkContext.broadcast(best)
    found = None
    for first, held, counts in slices:
        vector = np.zeros(len(held.value.keys), np.int64)
        for r in counts.toLocalIterator():
            vector[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
        one = _looked_up(aligned, held, spark.sparkContext.broadcast(vector), best, sizes, buckets, first)
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    left = aligned.select(F.col("row").alias("__row"), "doc_id", F.size("a").cast("long").alias("n_a"),
                          F.size("b").cast("long").alias("n_b"), "n_groups", "n_links", "groups_sha256")
    return left.join(found, F.col("__row") == F.col("row")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _best(counts: DataFrame, held, base: int) -> DataFrame:
    """(b, top): the highest count of every b id."""

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            top = np.zeros(base, np.int64)
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.maximum.at(top, held.value.keys[block * BLOCK:(block + 1) * BLOCK] % base, np.frombuffer(x, np.int64))
            b = np.flatnonzero(top)
            return {"b": pa.array(b), "top": pa.array(top[b])}
        return each

    return map_rows(counts, start, struct_of(("b", "bigint"), ("top", "bigint"))).groupBy("b").agg(F.max("top").alias("top"))


def _looked_up(aligned: DataFrame, held, vector, best, sizes, buckets: int, first: int) -> DataFrame:
    """(row, n_best, count_sum) over the links whose pairs are in the slice."""

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            size_a, size_b = sizes.value
            codes, ends = _pairs_of(batch, 1, 2, size_a, size_b, len(size_b))
            if buckets > SLICE_BUCKETS:
                bucket = bucket_of(codes, buckets)
                inside = (bucket >= first) & (bucket < first + SLICE_BUCKETS)
                codes, ends = codes[inside], np.concatenate([[0], np.cumsum(inside)])[ends]
            some, of = _distinct(codes)
            counts = vector.value[held.value.find(some)]
            top = counts == best.value[some % len(size_b)]

            def summed(values: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values[of], dtype=np.int64)])[ends], prepend=0))

            return {"row": batch.column(0), "n_best": summed(top), "count_sum": summed(counts)}
        return each

    return map_rows(aligned.select("row", "a", "b"), start, struct_of(("row", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint")))
