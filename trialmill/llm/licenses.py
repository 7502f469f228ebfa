"""Licence scan with a positional rare-token index.

Templates are known notices and names of licences.  Their postings list, for every word, the templates
and places that have it.  A file looks up the highest-IDF words that it has of each template; every
such place and posting gives a start at which the template would stand, and the rest of the template
is intersected at the same relative positions.  A template is found where enough of its words stand in
their place (all of them for a name) and its mandatory key phrases stand there in full.

IDF counts every document of the table.  It needs the template words only, so what is collected and
broadcast has at most as many rows as the templates have words.

Defined cases: null, empty and wordless texts find nothing (score 0, null places); repeated rows get
equal results; an empty table stays empty; columns that clash with added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import chunks, utf8

#: Lower-cases A-Z and blanks every other ASCII character that is neither a letter nor a digit.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Names whose places are counted, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, notice as published, key phrases that must stand in it.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction", ["permission is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["except in compliance with the license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl-3", "gnu general public license version 3", ["license version 3"]),
    ("gpl-2", "gnu general public license version 2", ["license version 2"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("apache-2", "apache license version 2 0", ["license version 2 0"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "cc by nc 4 0", ["by nc"]),
    ("cc-by-sa", "cc by sa 4 0", ["by sa"]),
    ("cc-by-nd", "cc by nd 4 0", ["by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]


@dataclass
class Template:
    label: str
    words: list[int]
    keys: list[tuple[int, ...]]
    base: bool


class Index:
    """Postings of the templates by word number; -1 is any other word."""

    def __init__(self, phrases: Mapping[str, str] = BASE_PHRASES, notices=NOTICES) -> None:
        texts = [(label, text, [text], True) for text, label in phrases.items()]
        texts += [(label, text, keys, False) for label, text, keys in notices]
        self.words: dict[bytes, int] = {}
        for _, text, _, _ in texts:
            for w in text.encode().split():
                self.words.setdefault(w, len(self.words))
        number = lambda text: [self.words[w] for w in text.encode().split()]
        self.templates = [Template(label, number(text), [tuple(number(k)) for k in keys], base) for label, text, keys, base in texts]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for place, w in enumerate(template.words):
                self.postings.setdefault(w, []).append((t, place))

    def numbers(self, text: bytes) -> np.ndarray:
        found = text.translate(ALNUM).split()
        get = self.words.get
        return np.fromiter((get(w, -1) for w in found), np.int32, len(found))


def document_frequencies(docs: DataFrame, index: Index) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, and how many documents there are."""
    names = list(index.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names), np.int64), 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                found = np.unique(index.numbers(text))
                total[found[found >= 0]] += 1
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(names)), -1]), pa.array([*total.tolist(), n])], names=["word", "df"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word bigint, df bigint")
    rows = counted.groupBy("word").agg(F.sum("df").alias("df")).collect()  # at most as many as template words
    found = {r.word: r.df for r in rows}
    return {w: found.get(i, 0) for w, i in index.words.items()}, found.get(-1, 0)


def idf(frequencies: Mapping[bytes, int], documents: int) -> list[float]:
    return [math.log((1 + documents) / (1 + n)) + 1 for n in frequencies.values()]


def _phrase_at(ids: np.ndarray, phrase: tuple[int, ...], start: int, stop: int) -> bool:
    """Whether the phrase stands in full between two places."""
    part = ids[max(0, start) : stop]
    hits = np.ones(max(0, len(part) - len(phrase) + 1), bool)
    for j, w in enumerate(phrase):
        hits &= part[j : j + len(hits)] == w
    return bool(hits.any())


class Scanner:
    """An index with the weights of its words and the share of a template that must stand in place."""

    def __init__(self, index: Index, weights: list[float], share: float = 0.8, rare: int = 3, slack: int = 4) -> None:
        self.index, self.weights, self.rare, self.slack = index, weights, rare, slack
        self.mass = np.zeros((len(index.templates), len(index.words)))
        for t, template in enumerate(index.templates):
            for w in template.words:
                self.mass[t, w] += weights[w]
        self.whole = self.mass.sum(axis=1)
        self.least = self.whole * np.array([1 - 1e-9 if t.base else share for t in index.templates])

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(template number, start, share of its weight in place) of every template found."""
        places = np.flatnonzero(ids >= 0)
        have = np.zeros(len(self.weights), bool)
        have[ids[places]] = True
        out: list[tuple[int, int, float]] = []
        for t in np.flatnonzero(self.mass @ have >= self.least).tolist():
            template = self.index.templates[t]
            rarest = sorted({w for w in template.words if have[w]}, key=lambda w: (-self.weights[w], w))
            rarest = rarest[: 1 if template.base else self.rare]
            starts = np.unique(np.concatenate([np.flatnonzero(ids == w) - p for w in rarest for u, p in self.index.postings[w] if u == t]))
            if template.base:
                starts = starts[(starts >= 0) & (starts + len(template.words) <= len(ids))]
                for j, w in enumerate(template.words):
                    starts = starts[ids[starts + j] == w]
                out.extend((t, s, 1.0) for s in starts.tolist())
            else:
                out.extend(self._notice(t, template, ids, starts))
        return out

    def _notice(self, t: int, template: Template, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, float]]:
        slack = self.slack if len(template.words) > 2 * self.slack else 0  # a word more or less on the way
        got = np.zeros(len(starts))
        for j, w in enumerate(template.words):
            near = np.zeros(len(starts), bool)
            for at in (starts + j + shift for shift in range(-slack, slack + 1)):
                ok = (at >= 0) & (at < len(ids))
                near[ok] |= ids[at[ok]] == w
            got += near * self.weights[w]
        for s, g in zip(starts.tolist(), got.tolist()):
            if g >= self.least[t] and all(_phrase_at(ids, k, s - slack, s + len(template.words) + slack) for k in template.keys):
                yield t, max(0, s), round(g / self.whole[t], 9)


def scan_licenses(docs: DataFrame, index: Index | None = None, share: float = 0.8) -> DataFrame:
    """`docs` with n_words, found (array of label, start, share, base) for every template that stands in the text."""
    index = index or Index()
    frequencies, documents = document_frequencies(docs, index)
    scanner = Scanner(index, idf(frequencies, documents), share)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("found", pa.list_(pa.struct([
            ("label", pa.string()), ("start", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())])))])
        for column in texts:
            batch = utf8(column)
            parts = []
            for part in chunks(batch):
                for text in batch[part.start : part.stop]:
                    ids = index.numbers(text)
                    found = [
                        {"label": index.templates[t].label, "start": s, "share": g, "base": index.templates[t].base}
                        for t, s, g in scanner.scan(ids)
                    ]
                    parts.append({"n_words": len(ids), "found": found})
            yield pa.array(parts, kind)

    look = F.arrow_udf(run, "n_words bigint, found array<struct<label: string, start: bigint, share: double, base: boolean>>")
    docs = docs.drop("n_words", "found", "_scan")
    return docs.withColumn("_scan", look(F.col("text").cast("string"))).select(*docs.columns, "_scan.n_words", "_scan.found")


def digest(scanned: DataFrame) -> DataFrame:
    """n_base, first_word, last_word, base_labels, labels and score from `found`."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
