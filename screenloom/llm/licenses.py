"""License scans by diagonal voting.

Every rolling k-gram of a text's words is hashed and joined to the grams of the license templates.
A match of text position p and template position t votes for the diagonal p - t: a passage that
holds a template puts all its votes on one diagonal. Votes are summed by diagonal; neighbouring
diagonals, on which a passage goes on after a word was added or dropped, are merged. A match counts
only if the words themselves are equal: next to its hash a gram carries its words, where the hash
may be a template's (a small table of hash bits tells; all grams are joined all the same).

A phrase template is found only whole, that is, with every gram on one diagonal. For a passage the
matches are verified as a span: places in a row on a diagonal make a segment; segments follow one
another if text and template both go on, with at most the template's slack between their diagonals;
where the template starts again, so does the span. A span counts if it holds at least `least_cover` of
the template's grams and isn't longer than the template but for its slack. The slack is a fifth of the
template's words, and at most `slack` from one diagonal to the next, so short templates have none.

Words are runs of digits, of letters a-z after lower-casing A-Z, and of any characters beyond ASCII.
Defined results: null and empty texts have no words and no labels; repeated rows and null ids are
documents like others; overlapping places all count; an empty table gives no rows; columns other
than the id and the text are ignored. Templates are few (MAX_GRAMS bounds them), so they are sent to
every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, in_batches
from .hashing import Stretches, gram_hashes, parts, runs_of


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    whole: bool = False


PHRASES = (
    Template("mit", "mit license", whole=True),
    Template("apache", "apache license", whole=True),
    Template("gpl", "general public license", whole=True),
)
# Sentences of public licenses and the notices that refer to them.
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("lgpl", "modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("all-rights-reserved", "all rights reserved"),
)
K, SLACK, SLACK_PART, LEAST_COVER, MAX_GRAMS = 2, 3, 5, 0.8, 100_000
#: A text's row that tells its words, among its grams.
COUNT_ROW = -1
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased bytes."""
    text = Stretches(data)
    starts, ends = runs_of(IS_WORD[text.raw])
    return starts, ends, text.hashes(starts, ends)


def template_grams(templates: tuple[Template, ...], k: int) -> list[tuple[int, str, int, int]]:
    """(gram, its words, template, place in the template)."""
    out = []
    for t, template in enumerate(templates):
        data = template.words.encode().translate(LOWER_ASCII)
        starts, ends, words = word_spans(data)
        if len(words) < k:
            raise ValueError(f"a template has fewer than {k} words: {template.words}")
        for place, gram in enumerate(gram_hashes(words, k).tolist()):
            out.append((gram, b" ".join(data[starts[i] : ends[i]] for i in range(place, place + k)).decode(), t, place))
    if len(out) > MAX_GRAMS:
        raise ValueError(f"templates have over {MAX_GRAMS} grams")
    return out


def rolling_grams(docs: DataFrame, id_col: str, text_col: str, k: int, sought: list[int]) -> DataFrame:
    """(doc, id, pos, gram, words): a row for each k words in a row, and one for each document with
    its id and, as pos, its number of words."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    maybe = np.zeros(1 << 16, bool)
    maybe[np.array(sought, np.int64) & 0xFFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII) for t in batch.column(1)]
            for lo, hi in parts(texts):
                part = texts[lo:hi]
                data = b"\n".join(part)
                begins = np.cumsum([0, *(len(t) + 1 for t in part)])
                starts, ends, hashes = word_spans(data)
                first = np.searchsorted(starts, begins)
                of = np.searchsorted(begins, starts, side="right") - 1
                grams = gram_hashes(hashes, k)
                inside = of[: len(grams)] == of[k - 1 :][: len(grams)]
                at = np.flatnonzero(inside)
                grams, n = grams[at], len(part)
                told = np.flatnonzero(maybe[grams & 0xFFFF])
                words = [b" ".join(data[starts[i] : ends[i]] for i in range(p, p + k)).decode("utf-8", "surrogatepass") for p in at[told].tolist()]
                index = np.full(len(at) + n, -1)
                index[told] = np.arange(len(words))
                index[len(at) :] = len(words)
                words.append("")
                ids = np.full(len(at) + n, -1)
                ids[len(at) :] = np.arange(lo, lo + n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((of[at], np.arange(n))) + (doc + lo)),
                        batch.column(0).take(pa.array(ids, mask=ids < 0)),
                        pa.array(np.concatenate((at - first[of[at]], np.diff(first)))),
                        pa.array(np.concatenate((grams, np.full(n, COUNT_ROW)))),
                        pa.array(words).take(pa.array(index, mask=index < 0)),
                    ],
                    ["doc", "id", "pos", "gram", "words"],
                )
            doc += len(texts)

    return in_batches(rows).mapInArrow(run, f"doc long, id {rows.schema[id_col].dataType.simpleString()}, pos long, gram long, words string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = PHRASES + PASSAGES, k: int = K, slack: int = SLACK, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row for each row of docs: id, n_words, and places: an array of (template, label, whole,
    first_word, end_word, cover), in order of first_word."""
    spark: SparkSession = docs.sparkSession
    sought = template_grams(templates, k)
    size = {t: len([g for g in sought if g[2] == t]) for t in range(len(templates))}
    table = spark.createDataFrame([*sought, (COUNT_ROW, "", -1, 0)], "gram long, t_words string, template int, place int")
    grams = rolling_grams(docs, id_col, text_col, k, [g[0] for g in sought])
    votes = grams.join(F.broadcast(table), "gram").filter(F.col("words") == F.col("t_words"))
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("place")).repartition("doc").dropDuplicates(["doc", "template", "diagonal", "place"])
    facts = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.whole).alias("whole"), F.lit(size[i]).alias("grams"), F.lit(0 if t.whole else (size[i] + k - 1) // SLACK_PART).alias("extra")) for i, t in enumerate(templates)))
    votes = votes.withColumn("t", F.get(facts, F.col("template"))).withColumn("slack", F.least(F.lit(slack), F.col("t.extra")))
    along = Window.partitionBy("doc", "template").orderBy("diagonal", "place")
    goes_on = (F.col("diagonal") == F.lag("diagonal").over(along)) & (F.col("place") == F.lag("place").over(along) + 1)
    votes = votes.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("segment", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    segments = votes.groupBy("doc", "template", "segment").agg(F.max("id").alias("id"), F.first("t").alias("t"), F.first("slack").alias("slack"), F.min("diagonal").alias("diagonal"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    segments = segments.withColumn("start", F.col("diagonal") + F.col("place")).withColumn("end", F.col("start") + F.col("n"))
    # a segment inside a longer one is a repeated gram of the template; then the rest are chained
    in_text = Window.partitionBy("doc", "template").orderBy("start", F.desc("end"), "diagonal")
    inside = F.col("end") <= F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    segments = segments.withColumn("_inside", F.coalesce(inside, F.lit(False))).filter("NOT _inside OR t.whole")
    before = lambda c: F.lag(c).over(in_text)
    follows = (F.col("place") >= before("place") + before("n")) & (F.col("start") >= before("end")) & (F.abs(F.col("diagonal") - before("diagonal")) <= F.col("slack")) & ~F.col("t.whole")
    segments = segments.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("_new").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = segments.groupBy("doc", "template", "span").agg(F.max("id").alias("id"), F.first("t").alias("t"), F.min("diagonal").alias("diagonal"), F.min("start").alias("first_word"), (F.max("end") + k - 1).alias("end_word"), F.sum("n").alias("n"))
    spans = spans.withColumn("cover", F.col("n") / F.col("t.grams"))
    place = F.struct("first_word", "end_word", "template", F.col("t.label").alias("label"), F.col("t.whole").alias("whole"), "cover")
    fits = F.col("end_word") - F.col("first_word") <= F.col("t.grams") + k - 1 + F.col("t.extra")
    found = (F.col("template") >= 0) & fits & (F.col("cover") >= F.when(F.col("t.whole"), 1.0).otherwise(least_cover))
    counts = F.col("template") == -1
    out = spans.groupBy("doc").agg(
        F.max("id").alias("id"),
        F.max(F.when(counts, F.col("diagonal"))).alias("n_words"),
        F.array_sort(F.collect_list(F.when(found, place))).alias("places"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", "places")


def labels_of(places: str, whole_only: bool = False):
    chosen = F.filter(places, lambda p: p["whole"]) if whole_only else F.col(places)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda p: p["label"]))), ",")


