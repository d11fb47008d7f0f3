"""License scan by a positional rare-token index.

Templates (licence names, notices and openings) are word sequences. A corpus
pass counts in how many documents every licence word occurs; the rarest words
of a template (highest inverse document frequency) index it: word -> postings
(template, position). A file looks up its licence words from the rarest on;
every occurrence votes for the template at the relative position that its
posting implies. Where all indexed words of a template agree on a position,
the template is aligned there, its mandatory key phrases are verified word by
word inside the aligned window, and the share of its words found in order
gives the score. A template that is one phrase must match in full, so every
place of a phrase is found: each holds the phrase's rarest word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import map_rows, struct_of, text_bytes

#: Bytes that separate words: all of ASCII but digits and letters. A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text: maximal runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    #: phrases that must stand inside the aligned window; none: the whole text is the phrase
    keys: tuple[str, ...] = ()
    base: bool = False


#: Base phrases and labels (fixed values of the contract).
BASE = (
    Template("base-mit", "mit", "under the mit license", base=True),
    Template("base-apache-2", "apache-2", "apache license version 2", base=True),
    Template("base-cc-by-nc", "cc-by-nc", "cc by nc", base=True),
)

#: Further templates: opening words of well-known public licences and notices, with their key phrases.
NOTICES = (
    Template("mit-text", "mit",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("isc-text", "isc",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("with or without fee",)),
    Template("bsd-text", "bsd",
             "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache-header", "apache-2",
             "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
             ("apache license version 2 0",)),
    Template("gpl-notice", "gpl",
             "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl-name", "lgpl", "gnu lesser general public license"),
    Template("agpl-name", "agpl", "gnu affero general public license"),
    Template("gpl-name", "gpl", "gnu general public license"),
    Template("gpl-3", "gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gpl-2", "gnu general public license version 2"),
    Template("mpl-2", "mpl-2", "mozilla public license version 2 0"),
    Template("mpl-notice", "mpl-2",
             "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("cc-by-4", "cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa", "cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc-by-nd", "cc by nd"),
    Template("cc-by-nc-4", "cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-nc-sa", "cc-by-nc-sa", "cc by nc sa"),
    Template("cc0", "cc0", "cc0 1 0 universal"),
    Template("cc-long", "creative-commons",
             "this work is licensed under a creative commons attribution international license",
             ("creative commons attribution",)),
    Template("unlicense", "unlicense",
             "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("mit-name", "mit", "the mit license"),
    Template("bsl", "boost", "boost software license version 1 0"),
    Template("epl", "epl", "eclipse public license"),
    Template("rights", "all-rights-reserved", "all rights reserved"),
)


class Index:
    """Postings of the rarest words of every template."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], rare: int = 4):
        self.templates = templates
        self.words = [t.text.encode().split() for t in templates]
        self.keys = [[k.encode().split() for k in t.keys] for t in templates]
        self.idf = idf
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: (template) -> how many postings must agree on one relative position
        self.needed = []
        for n, words in enumerate(self.words):
            # ties go to the word that comes first in the alphabet
            chosen = sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))[:1 if not self.keys[n] else rare]
            at = [p for p, w in enumerate(words) if w in chosen]
            for p in at:
                self.postings[words[p]].append((n, p))
            self.needed.append(max(1, math.ceil(len(at) / 2)) if self.keys[n] else 1)
        self.vocabulary = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of every verified place, score being the share of template words in order."""
        present = self.vocabulary.intersection(words)
        if not present:
            return []
        where = defaultdict(list)
        for p, w in enumerate(words):
            if w in present:
                where[w].append(p)
        votes: Counter = Counter()
        for w in sorted(present, key=lambda x: (-self.idf.get(x, 0.0), x)):
            for n, p in self.postings[w]:
                for at in where[w]:
                    votes[n, at - p] += 1
        found = []
        for (n, start), got in votes.items():
            mine = self.words[n]
            if self.keys[n]:
                if got < self.needed[n]:
                    continue
                lo, hi = max(0, start - 8), max(0, start + len(mine) + 8)
                window = words[lo:hi]
                if all(_places(window, k) for k in self.keys[n]):
                    found.append((n, max(0, start), _in_order(mine, window) / len(mine)))
            elif start >= 0 and words[start:start + len(mine)] == mine:
                found.append((n, start, 1.0))
        return found


def _places(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i, w in enumerate(words) if w == phrase[0])


def _in_order(template: list[bytes], window: list[bytes]) -> int:
    """Length of the longest common subsequence (both sides are bounded by the template)."""
    row = [0] * (len(window) + 1)
    for w in template:
        last = 0
        for j, x in enumerate(window, 1):
            last, row[j] = row[j], last + 1 if w == x else max(row[j], row[j - 1])
    return row[-1]


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Rows of ``docs`` and, for each licence word, the rows in which it occurs. The result is
    bounded by the templates' vocabulary."""
    def task():
        def each(batch: pa.RecordBatch):
            n: Counter = Counter()
            for t in batch.column(0):
                n.update(vocabulary.intersection(words_of(t.as_py())))
            n[b""] = batch.num_rows
            return {"word": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())}
        return each

    counts = map_rows(docs.select(text_bytes().alias("b")), task, struct_of(("word", "binary"), ("n", "long")))
    df = {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return df.pop(b"", 0), df


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, rare: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places (template, label, base, start, score).

    Null texts are empty: no words, no places. Repeated rows give repeated
    results; an empty table gives an empty result; further columns are ignored.
    """
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())
    rows, df = document_frequencies(docs, vocabulary)
    idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) for w in vocabulary}

    def task():
        index = Index(templates, idf, rare)

        def each(batch: pa.RecordBatch):
            n_words, places = [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                n_words.append(len(words))
                places.append([{"template": templates[n].name, "label": templates[n].label, "base": templates[n].base,
                                "start": at, "score": s} for n, at, s in sorted(index.scan(words))])
            return {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "places": places}
        return each

    place = "array<struct<template:string,label:string,base:boolean,start:bigint,score:double>>"
    return map_rows(docs.select("doc_id", text_bytes().alias("b")), task,
                    struct_of(("doc_id", docs.schema["doc_id"].dataType), ("n_words", "long"), ("places", place)))


def license_summary(scanned: DataFrame) -> DataFrame:
    """The digest of ``license_scan`` rows: places of base phrases, labels and the best score."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    joined = lambda places: F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))
