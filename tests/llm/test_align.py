"""Alignment against the two tokenizer libraries and a brute-force count of overlapping tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rentlens.llm import align, queries

from helpers import SF

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NASTY = ["", None, " ", "  ", "a", " a", "a ", "a  b", "\n\n x\t y \r\n", "it's we'll DON'T 1234567 ",
         "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁▁bar", "ÅﬁΩ é é 漢字 😀   x\x00\x07\x85",
         "x" * 3000, "ab " * 2000, "  " * 500, "the the the", "the the the"]


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_LEVEL)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = list(zip(a.ids, (bytes(self.byte[c] for c in t) for t in a.tokens)))
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
             for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        if not all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b)):
            return [], []
        return a, b


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(docs):
    lib, all_links, rows = Brute(), [], []
    for d, text in docs:
        a, b = map(spans, lib.tokens(text))
        found, lo = [], 0
        for i, s, e in a:
            while lo < len(b) and b[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(b) and b[k][1] < e:
                found.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        by_a, by_b = defaultdict(list), defaultdict(list)
        for side, to in ((a, by_a), (b, by_b)):
            k = 0
            for i, s, e in side:
                while e > cuts[k]:
                    k += 1
                to[k].append(str(i))
        groups = [",".join(by_a[k]) + "|" + ",".join(by_b[k]) for k in range(len(cuts))]
        all_links.append(found)
        rows.append([d, len(a), len(b), len(cuts), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(x for f in all_links for x in f)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return Counter((d, na, nb, g, n, sum(count[x] == top[x[1]] for x in f), sum(count[x] for x in f), sha)
                   for (d, na, nb, g, n, sha), f in zip(rows, all_links))


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op12_alignment(spark, SF)) == brute(docs)


def test_edge_rows(spark):
    """Empty, null and odd texts, lost bytes, very long words, repeated rows and ids, a null id, clashing columns."""
    docs = [(n // 2 if n % 5 else None, t) for n, t in enumerate(NASTY)] * 2
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id bigint, text string, row int, pairs string").repartition(5)
    assert rows_of(align.alignment_counts(df, BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)) == brute(docs)


@pytest.mark.parametrize("texts", [[], [""], [None, "▁"]])
def test_without_tokens(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(align.alignment_counts(df, BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)) == brute(docs)


def test_slices_and_tree(spark, monkeypatch):
    """Buckets in several slices and a tree of several rounds give the same rows; tables that forget, too."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    for name, value in (("BUCKET_KEYS", 500), ("SLICE_BUCKETS", 3), ("FAN", 2), ("BLOCK", 64)):
        monkeypatch.setattr(align, name, value)
    assert rows_of(align.alignment_counts(df, BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)) == brute(docs)


def test_byte_level_equals_the_library():
    """tiktoken over the file's vocabulary, on joined tokens, random bytes and characters, and long blanks."""
    rng = random.Random(1)
    mine, lib = align.ByteLevel(BYTE_LEVEL, public_tokenizers.PATTERN), Brute().a
    assert mine.fast is not None
    tokens = [bytes(mine.raw[s:s + n]).decode("utf-8", "replace") for s, n in zip(mine.starts, mine.sizes)]
    for k in range(4000):
        some = rng.choices(tokens, k=rng.randint(1, 8))
        if k % 3 == 0:
            some += [chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x2000, 0x2100), 32, 10])) for _ in range(9)]
        if k % 5 == 0:
            some += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 60)))]
        rng.shuffle(some)
        text = " " + "".join(some)
        assert list(mine.ids(text)) == lib.encode(text, add_special_tokens=False).ids, text
    for text in (" " * 30_000 + "a", "\n" * 20_000, "x" * 20_000, "  ab " * 3000):
        ids, counts, right = mine.encode([text])
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and right.all()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 33, 30_000))
    buckets = 7
    parts = {k: align.build(keys[align.bucket_of(keys, buckets) == k]) for k in range(2, 6)}
    table = align.PerfectHash(buckets, 2, [(p[0], p[1].tobytes(), p[2].tobytes()) for _, p in sorted(parts.items())])
    mine = keys[np.isin(align.bucket_of(keys, buckets), range(2, 6))]
    found = table.find(mine)
    assert sorted(found) == list(range(len(mine)))
    other = np.setdiff1d(np.arange(5000), keys)
    other = other[np.isin(align.bucket_of(other, buckets), range(2, 6))]
    with pytest.raises(ValueError):
        table.find(other)


def test_words_are_encoded_once_and_give_the_ids_of_whole_texts(monkeypatch):
    """Texts cut at spaces have the ids of whole texts, whatever stands around a space; a known word is not encoded again."""
    rng = random.Random(3)
    sides = align.ByteLevel(BYTE_LEVEL, public_tokenizers.PATTERN), align.Pieces(PIECES)
    assert all(s.by_words for s in sides)
    tokens = [bytes(s.raw[a:a + n]).decode("utf-8", "replace") for s in sides for a, n in zip(s.starts, s.sizes)]
    between = [" ", " ", "  ", "   ", "\n", "\n ", " \n", "\t \n", "▁", "▁ ", " ▁", "\x1c", " \x1c", "\xa0 ", "　 ", "'s", "' s", ""]
    monkeypatch.setattr(align, "KNOWN_WORDS", 500)
    words = align.Words(*sides)
    for _ in range(80):
        texts = [" " + (t or "") for t in rng.sample(NASTY, 3)]
        texts += [" " + "".join(rng.choice(tokens) + rng.choice(between) for _ in range(rng.randint(0, 12))) for _ in range(15)]
        for side, got in zip(sides, words.encode(texts)):
            for x, y in zip(got, side.encode(texts)):
                assert x.tolist() == y.tolist()
    words.forget()
    words.encode([" the ship left", " the harbour"])
    read = []
    monkeypatch.setattr(align.Tokenizer, "encode", lambda self, texts: read.append(texts))
    assert [[x.tolist() for x in got[1:]] for got in words.encode([" left the", " harbour"])] and not read


def test_lookups_ask_for_each_pair_once():
    """The hash is asked for the distinct pairs of a batch, not for every link."""
    codes = np.array([7, 5, 7, 7, 5, 1 << 33])
    some, of = align._distinct(codes)
    assert some.tolist() == [5, 7, 1 << 33] and some[of].tolist() == codes.tolist()
    assert [len(x) for x in align._distinct(codes[:0])] == [0, 0]
