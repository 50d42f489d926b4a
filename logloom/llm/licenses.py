"""License notices by diagonal voting.

The hashes of all rolling word pairs of a text are joined to their places in the templates. Each hit votes for the diagonal
(place in the text minus place in the template) it lies on. Neighbouring diagonals are merged, which bridges a few words
put in or left out, and a merged span counts if it covers enough of the template in a fitting length. A phrase is verified
where one diagonal has the votes of all its pairs: its words stand there consecutively.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm import words
from logloom.session import cut_lineage

PAIR = 2
# fixed values: phrases and their labels
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# fixed values: public wordings of license notices and the labels this module adds
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files", "mit",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted", "isc",
    ),
)
NEIGHBOURS = 2  # diagonals this near to each other are merged
COVERAGE = 0.8  # of a notice, and one pair may always be missing
# fixed values: word pairs of short notices that hold the licence's name and version; one of each group must stand in the text.
# The pairs inside a name with relatives (LGPL, CC BY-NC-SA) stand alone: a word between them names another licence.
NEEDED = {
    "licensed under the apache license version 2 0": (("the apache", "apache license"), ("2 0",)),
    "released under the mit license": (("the mit", "mit license"),),
    "licensed under cc by nc 4 0": (("cc by",), ("by nc",), ("nc 4",), ("4 0",)),
    "licensed under the gnu general public license version 3": (("gnu general",), ("version 3",)),
    "licensed under the gnu general public license version 2": (("gnu general",), ("version 2",)),
}


def _pairs(phrase: str) -> np.ndarray:
    (_, hashes, _), *_ = words.hashed(pa.array([phrase]), words.ALPHANUMERIC)
    return words.gram_hashes(hashes, PAIR)


def _templates() -> list[tuple[int, str, bool, int, int, int]]:
    """(template, label, is a phrase, pairs, gram, place) for all word pairs of all templates."""
    return [
        (t, label, t < len(PHRASES), len(grams), int(g), place)
        for t, (phrase, label) in enumerate(PHRASES + NOTICES)
        for grams in [_pairs(phrase).view(np.int64)]
        for place, g in enumerate(grams)
    ]


def _named() -> Column:
    """Whether the voted places of a template hold the licence's name and version."""
    held = F.lit(True)
    for t, (phrase, _) in enumerate(PHRASES + NOTICES):
        pairs = list(zip(phrase.split(), phrase.split()[1:]))
        for group in NEEDED.get(phrase, ()):
            places = F.array(*(F.lit(pairs.index(tuple(pair.split()))) for pair in group))
            held = held & ((F.col("template") != t) | F.arrays_overlap("voted", places))
    return held


def _hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, grams, places): the word pairs of every text that stand in a template."""
    wanted = np.unique(np.array([t[4] for t in _templates()], np.int64).view(np.uint64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, grams, places = [], [], []
            for _, hashes, first in words.hashed(batch.column(1), words.ALPHANUMERIC):
                pairs = words.gram_hashes(hashes, PAIR)
                found = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)] == pairs)
                edge = np.searchsorted(found, first)
                for a, b, lo, hi in zip(first[:-1], first[1:], edge[:-1], edge[1:]):
                    own = found[lo:hi]
                    own = own[own + PAIR <= b]
                    sizes.append(int(b - a))
                    grams.append(pairs[own].view(np.int64))
                    places.append(own - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(batch.num_rows)), batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_words", "grams", "places"],
            )
            row += batch.num_rows

    return docs.select("doc_id", "text").mapInArrow(
        run, f"row bigint, doc_id {kind}, n_words bigint, grams array<bigint>, places array<bigint>"
    )


def _spans(hits: DataFrame) -> DataFrame:
    """(row, label, phrase, start, end, coverage) of every verified span."""
    spark = hits.sparkSession
    templates = spark.createDataFrame(
        _templates(), "template int, label string, phrase boolean, pairs int, gram bigint, at int"
    )
    votes = (
        hits.select("row", F.explode(F.arrays_zip("grams", "places")).alias("hit"))
        .select("row", F.col("hit.grams").alias("gram"), F.col("hit.places").alias("place"))
        .join(F.broadcast(templates), "gram")  # the word pairs of the fixed templates
        .groupBy("row", "template", "label", "phrase", "pairs", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("voted"), F.min("place").alias("start"), (F.max("place") + PAIR).alias("end"))
    )
    phrases = votes.where(F.col("phrase") & (F.size("voted") == F.col("pairs")))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    merged = (
        votes.where(~F.col("phrase"))
        .withColumn("_new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS).cast("int"), F.lit(1)))
        .withColumn("cluster", F.sum("_new").over(along))
        .groupBy("row", "template", "label", "phrase", "pairs", "cluster")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("voted"))).alias("voted"),
            F.min("start").alias("start"), F.max("end").alias("end"),
        )
    )
    coverage = (F.size("voted") / F.col("pairs")).alias("coverage")
    needed = F.least(COVERAGE * F.col("pairs"), F.col("pairs") - F.lit(1.0))
    fitting = (F.size("voted") >= needed) & _named() & (F.col("end") - F.col("start") <= 1.3 * F.col("pairs") + 2)
    columns = ["row", "label", "phrase", "start", "end", coverage]
    return phrases.select(*columns).union(merged.where(fitting).select(*columns))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its phrases and notices.

    doc_id, n_words, n_base (places of all phrases), first_word and last_word (smallest and largest of their starts, null if
    there are none), base_labels (the phrases' labels), labels (those of notices too), score (largest share of a template
    that a verified span covers, 0 if there is none) and spans (label, start, end, coverage; words from 0). A null text is
    an empty one. Null and repeated doc_ids are rows like any other, further columns are left out.
    """
    hits = cut_lineage(_hits(docs))

    def listed(only: bool):
        label = F.when(F.col("phrase"), F.col("label")) if only else F.col("label")
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    start = F.when(F.col("phrase"), F.col("start"))
    found = _spans(hits.where(F.size("grams") > 0)).groupBy("row").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        listed(True).alias("base_labels"), listed(False).alias("labels"), F.max("coverage").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "coverage"))).alias("spans"),
    )
    return hits.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
