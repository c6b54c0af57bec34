"""Licence scans by diagonal voting.

Words of a text are its lower-cased (A-Z) runs of digits, small letters and characters beyond ASCII. Every run of
GRAM words is hashed, and Spark joins all those hashes with the template positions that have them. A match at word
p of a text and word q of a template votes for the diagonal p - q. Votes are summed by (text, template, diagonal);
neighbouring diagonals, which insertions and deletions give, are merged; a span is verified by the share of the
template's positions that it holds, every one of them for the base phrases, whose places are thus exact. A run whose
hash a template has is held against the template's words before it may vote, so a span's votes are of equal words.

Scale: a text's hashes leave Python as one array and are exploded in the JVM into a join with the broadcast
template positions, which are a fixed parameter; only matches are shuffled, by text.

Edge cases: a null or empty text has no words, no places and no labels; a very long text is whole; rows are told apart
by a row number, so repeated ids stay apart; further columns are left out, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.textkit import LOWER, NOT_ALNUM, Words, blocks, window_hashes

#: Words of a gram; no base phrase has fewer.
GRAM = 3
#: Diagonals at most so far apart are merged.
SLACK = 3
#: The share of a licence text's positions that a span holds at least, unless its template says otherwise: all of
#: them where a word tells a licence from its relatives.
SHARE = 0.8


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False
    share: float = SHARE


#: The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Passages by which public licences are known, from their published texts.
TEXTS = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    Template("gpl", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", share=1.0),
    Template("lgpl", "free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", share=1.0),
    Template("agpl", "free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", share=1.0),
    Template("cc-by", "Creative Commons Attribution 4.0 International License", share=1.0),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", share=1.0),
    Template("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License", share=1.0),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", share=1.0),
    Template("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", share=1.0),
    Template("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", share=1.0),
)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of consecutive texts, and the hash of the gram that starts at each (if so many are left)."""
    words = Words(LOWER[data], offsets, NOT_ALNUM)
    return words, window_hashes(words.hashes(), GRAM)


def spelt(words: Words, p: int) -> bytes:
    """The gram at a word, in words."""
    return b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[p : p + GRAM], words.end[p : p + GRAM], strict=True))


class Position(NamedTuple):
    gram: int
    template: int
    q: int
    n: int
    label: str
    exact: bool
    share: float


def positions(templates: tuple[Template, ...]) -> tuple[list[Position], dict[int, bytes]]:
    """Every gram of the templates where it stands, and the words of each."""
    rows: list[Position] = []
    known: dict[int, bytes] = {}
    for k, t in enumerate(templates):
        for _, _, data, offsets in blocks(pa.array([t.text])):
            words, grams = cut(data, offsets)
            n = len(words) - GRAM + 1
            if n < 1:
                raise ValueError(f"a template has fewer than {GRAM} words: {t.text}")
            for q, g in enumerate(grams[:n].view(np.int64).tolist()):
                if g == 0 or known.setdefault(g, spelt(words, q)) != spelt(words, q):
                    raise ValueError(f"a template's gram has the hash of another: {t.text}")
                rows.append(Position(g, k, q, n, t.label, t.exact, 1.0 if t.exact else t.share))
    return rows, known


def verified(words: Words, grams: np.ndarray, known: dict[int, bytes]) -> np.ndarray:
    """The hashes, but 0 where one is a template's and the words aren't."""
    hits = np.flatnonzero(np.isin(grams, np.fromiter(known, np.int64, len(known))) & (words.left() >= GRAM))
    wrong = [p for p in hits.tolist() if spelt(words, p) != known[int(grams[p])]]
    if wrong:
        grams = grams.copy()
        grams[wrong] = 0
    return grams


def grams(docs: DataFrame, keys: list[str], known: dict[int, bytes], text: str = "text") -> DataFrame:
    """keys, n_words and ``grams``: 0 and then the hashes of all grams of a row's text in order, those of the templates
    held against their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(len(keys))):
                words, h = cut(data, offsets)
                n = words.counts()
                fits = words.left() >= GRAM
                size = 1 + np.maximum(n - GRAM + 1, 0)
                ends = np.cumsum(size)
                values = np.zeros(ends[-1], np.int64)
                head = np.zeros(len(values), bool)
                head[ends - size] = True
                values[~head] = verified(words, h.view(np.int64), known)[fits]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keys))), pa.array(n, pa.int64()), lists], names=[*keys, "n_words", "grams"])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{own}, n_words bigint, grams array<bigint>")


def spans(docs: DataFrame, keys: list[str], text: str = "text", templates: tuple[Template, ...] = BASE + TEXTS) -> DataFrame:
    """A row for each verified span, and one without a label for each text: row, keys, n_words, label, exact, start
    (a word, from 0), score."""
    spark = docs.sparkSession
    places, known = positions(templates)
    found = spark.createDataFrame(places, "gram bigint, template int, q int, n int, label string, exact boolean, share double")
    rows = grams(docs, keys, known, text).withColumn("row", F.monotonically_increasing_id())
    own = ["row", *keys, "n_words"]
    each = rows.select(*own, F.posexplode("grams").alias("p", "gram"))
    met = each.join(F.broadcast(found), (each["gram"] == found["gram"]) & (each["p"] > 0), "left").where("p = 0 or template is not null")
    votes = met.groupBy(*own, "template", "n", "label", "exact", "share", (F.col("p") - 1 - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("held"))
    near = Window.partitionBy(*own, "template").orderBy("diagonal")
    step = F.when((F.col("diagonal") - F.lag("diagonal").over(near) <= SLACK) & ~F.col("exact"), 0).otherwise(1)
    chains = votes.withColumn("step", step).withColumn("chain", F.sum("step").over(near))
    merged = chains.groupBy(*own, "template", "n", "label", "exact", "share", "chain").agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("votes"))
    score = F.col("votes") / F.col("n")
    return merged.withColumn("score", score).where(F.col("label").isNull() | (score >= F.col("share"))).select(*own, "label", "exact", F.greatest("start", F.lit(0)).cast("bigint").alias("start"), "score")


def scan(docs: DataFrame, keys: list[str], text: str = "text", templates: tuple[Template, ...] = BASE + TEXTS) -> DataFrame:
    """A row for each text: keys, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("exact")

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")

    return (
        spans(docs, keys, text, templates)
        .groupBy("row", *keys, "n_words")
        .agg(
            F.count_if(base).cast("bigint").alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
