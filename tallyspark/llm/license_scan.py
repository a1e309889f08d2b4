"""License scans: an exact join of sets of words between text blocks and license templates by containment.

A document's blocks are windows over its terms, one grid for each size class of templates: width is the power of two
from twice the longest template of the class (16 at least), the step half of that, so each passage of up to half a
window stands whole in a block. A block meets a template if it holds at least `least` of the template's distinct words.

The join never compares a block with all templates. Words are ordered by the number of blocks that hold them over all
documents, rare ones first. A template of t words, of which a = ceil(least * t) must be shared, is indexed under its
t - a + 1 rarest words only (prefix filter); a block looks up its words except its a - 1 most frequent ones; blocks of fewer than
a words can't match (length filter); and at a shared word what is left on both sides bounds the overlap (positional
filter). Pairs that pass are counted exactly, so none is lost and none is wrong. Words that no template has can't be shared and are dropped first.
Only templates are broadcast (MAX_TEMPLATES words at most); blocks are dealt out by themselves, and a document of many
blocks is many rows.

Words are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words, no blocks, no labels and a score of 0; a very long text is cut into
pieces for hashing and gives as many blocks as it takes; each row is scanned by itself, so repeated rows and null
doc_ids give a row each; templates that tie are all reported; an empty table gives an empty result; other columns than
doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words
from tallyspark.session import written

#: share of a template's distinct words that a block must hold
LEAST = 0.85
#: words of all templates together that are broadcast at most
MAX_TEMPLATES = 1_000_000

#: fixed values: phrases of the base rule and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: fixed values: openings and notices of public licenses, with their labels
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "Licensed under the Apache License, Version"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial International License"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("reserved", "Copyright. All rights reserved"),
]


def needed(size: int, least: float) -> int:
    """How many of a template's `size` distinct words a block must hold."""
    return max(1, math.ceil(size * least - 1e-9))


def plain_terms(text: str) -> list[str]:
    """The words of a template, as the contract has them."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def width_of(count: int) -> int:
    """The window of a template of `count` words."""
    return max(16, 1 << (2 * count - 1).bit_length())


def vocabulary(templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> np.ndarray:
    """The hashes of all words of templates and phrases, sorted; a word's number is its place."""
    found = words.term_hashes([t for _, t in templates] + [p for p, _ in phrases])
    if sum(map(len, found)) > MAX_TEMPLATES:
        raise ValueError("templates hold more words than are broadcast")
    return np.unique(np.concatenate(found))


def scanner(templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: float):
    """A function over Arrow batches (doc_id, text) that gives each row's words, base places and blocks."""
    known = vocabulary(templates, phrases)
    number = lambda text: np.searchsorted(known, words.term_hashes([text])[0])
    kinds: dict[int, tuple[set[int], int]] = {}  # width -> words of its templates, the least overlap of any
    for _, text in templates:
        own = number(text)
        ids, low = kinds.get(width_of(len(own)), (set(), 1 << 30))
        kinds[width_of(len(own))] = (ids | set(own.tolist()), min(low, needed(len(set(own.tolist())), least)))
    grids = [(w, np.isin(np.arange(len(known)), sorted(ids)), low) for w, (ids, low) in sorted(kinds.items())]
    base = [(number(p), label) for p, label in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, bounds in words.terms(batch.column("text")):
                docs = b - a
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                word, doc = at[hit], np.searchsorted(bounds, hit, "right") - 1
                pos = hit - bounds[doc]
                n_base, first, last = np.zeros(docs, np.int64), np.full(docs, np.iinfo(np.int64).max), np.full(docs, -1)
                has = []
                for phrase, label in base:
                    m = max(len(word) - len(phrase) + 1, 0)
                    ok = np.ones(m, bool)
                    for i, w in enumerate(phrase):
                        ok &= (word[i : i + m] == w) & (hit[i : i + m] == hit[:m] + i) & (doc[i : i + m] == doc[:m])
                    d, p = doc[:m][ok], pos[:m][ok]
                    np.add.at(n_base, d, 1)
                    np.minimum.at(first, d, p)
                    np.maximum.at(last, d, p)
                    has.append((np.bincount(d, minlength=docs) > 0, label))
                labels = [sorted({label for found, label in has if found[i]}) for i in range(docs)]
                rows, widths, sets = _blocks(doc, pos, word, grids)
                cut = np.searchsorted(rows, np.arange(docs + 1))
                blocks = [[{"width": int(widths[i]), "words": sets[i]} for i in range(x, y)] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, docs),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(n_base),
                        pa.array(first, mask=none),
                        pa.array(last.astype(np.int64), mask=none),
                        pa.array(labels, pa.list_(pa.string())),
                        pa.array(blocks, pa.list_(pa.struct([("width", pa.int32()), ("words", pa.list_(pa.int32()))]))),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    return scan


def _blocks(doc: np.ndarray, pos: np.ndarray, word: np.ndarray, grids: list) -> tuple[np.ndarray, np.ndarray, list]:
    """The blocks of some documents that hold enough words for any template of their width: document, width, words."""
    docs, widths, sets = [], [], []
    for width, member, low in grids:
        step, own = width // 2, member[word]
        d, p, w = doc[own], pos[own] // step, word[own]
        d, p, w = np.concatenate([d, d]), np.concatenate([p, p - 1]), np.concatenate([w, w])
        ok = p >= 0
        d, p, w = d[ok], p[ok], w[ok]
        order = np.lexsort((w, p, d))
        d, p, w = d[order], p[order], w[order]
        fresh = np.ones(len(d), bool)  # each word once a block
        fresh[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (w[1:] != w[:-1])
        d, p, w = d[fresh], p[fresh], w[fresh]
        edge = np.ones(len(d), bool)
        edge[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(d)))
        for s, n in zip(start[size >= low], size[size >= low], strict=True):
            docs.append(d[s])
            widths.append(width)
            sets.append(w[s : s + n].tolist())
    order = np.argsort(np.array(docs, np.int64), kind="stable")
    return np.array(docs, np.int64)[order], np.array(widths, np.int64)[order], [sets[i] for i in order]


SCANNED = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<width:int, words:array<int>>>"


def matches(blocks: DataFrame, templates: DataFrame, least: float, size: int) -> DataFrame:
    """row, label, containment: the exact join of blocks (row, block, width, words) with templates (template, label,
    width, words) by the share of the template's words that the block holds. Words are numbers below `size`."""
    spark = blocks.sparkSession
    held = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    every = spark.range(size).select(F.col("id").cast("int").alias("word")).join(held, "word", "left").fillna(0, ["df"])
    # how many blocks hold each word, by the word's number: one array of the size of the vocabulary
    counts = every.agg(F.array_sort(F.collect_list(F.struct("word", "df")))["df"].alias("counts"))
    rare_first = F.array_sort(F.transform("words", lambda w: F.struct(F.get("counts", w).alias("df"), w.alias("word"))))["word"]
    ordered = lambda df: df.withColumn("counts", counts.scalar()).withColumn("words", rare_first).drop("counts")

    t = ordered(templates).withColumns({"t": F.size("words"), "need": F.greatest(F.ceil(F.size("words") * F.lit(least) - 1e-9), F.lit(1)).cast("int")})
    index = t.select("label", F.col("width").alias("t_width"), "t", "need", F.col("words").alias("t_words"), F.posexplode("words").alias("i", "word")).filter("i <= t - need")
    probes = ordered(blocks).select("row", "width", F.size("words").alias("b"), "words", F.posexplode("words").alias("j", "word"))
    met = probes.join(F.broadcast(index), (probes["word"] == index["word"]) & (F.col("width") == F.col("t_width"))).drop(index["word"])
    met = met.filter("b >= need and j <= b - need")
    upto = F.size(F.array_intersect(F.slice("t_words", F.lit(1), F.col("i") + 1), F.slice("words", F.lit(1), F.col("j") + 1)))
    met = met.filter(upto + F.least(F.col("t") - F.col("i"), F.col("b") - F.col("j")) - 1 >= F.col("need"))
    # a pair counts where its first shared word stands, so once
    met = met.withColumn("shared", F.array_intersect("t_words", "words")).filter((F.col("shared")[0] == F.col("word")) & (F.size("shared") >= F.col("need")))
    return met.select("row", "label", (F.size("shared") / F.col("t")).alias("containment"))


def template_rows(spark, templates: list[tuple[str, str]], known: np.ndarray) -> DataFrame:
    rows = []
    for i, (label, text) in enumerate(templates):
        own = np.searchsorted(known, words.term_hashes([text])[0])
        rows.append((i, label, width_of(len(own)), sorted(set(own.tolist()))))
    return spark.createDataFrame(rows, "template int, label string, width int, words array<int>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the greatest containment that meets
    the threshold, 0 if none does), a row for each row of docs."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCANNED}"
    rows = docs.select("doc_id", "text").mapInArrow(scanner(templates, phrases, least), schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "x")).select("row", "block", "x.width", "x.words")
    known = vocabulary(templates, phrases)
    found = matches(blocks, template_rows(spark, templates, known), least, len(known))
    best = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    out = rows.drop("blocks").join(best, "row", "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
