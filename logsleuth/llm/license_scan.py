"""Licence scans by diagonal voting.

All runs of k words of all documents meet the runs of k words of licence templates in one
join on their hashes. A hit lies on the diagonal "place in the document minus place in the
template"; a copied passage is a row of hits on one diagonal, a passage with words put in or
left out a row of hits on a few neighbouring ones. Votes are counted by diagonal,
neighbouring diagonals merge, and the spans found are verified against the template.

Templates are few and their runs are counted before they are broadcast; documents are read
once and only hits are shuffled.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Phrases that name a licence, with the label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening passages of public licences, with the label.
PASSAGES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version.""",
    "gpl-3-notice": """This work is licensed under the GNU General Public License, version 3.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
International License""",
}

#: What lies between words, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple
    #: Phrases must stand word for word; passages need only so large a part of their runs.
    base: bool
    share: float


def template_words(text: str) -> tuple:
    clean = "".join(c.lower() if c.isascii() else c for c in text)
    return tuple("".join(c if c.isalnum() or not c.isascii() else " " for c in clean).split())


def templates(share: float = 0.6) -> list[Template]:
    """The fixed phrases and passages."""
    found = [Template(label, template_words(text), True, 1.0) for text, label in PHRASES.items()]
    for name, text in PASSAGES.items():
        label = name.removesuffix("-notice")
        found.append(Template(label, template_words(text), False, share))
    return found


#: Words in a run, how far neighbouring diagonals may lie apart, and runs of all templates
#: that may be broadcast (an ordinary join takes more).
RUN, DRIFT, BROADCAST_RUNS = 3, 2, 100_000


def word_runs(words: str, k: int) -> Column:
    """All runs of k words of an array column, joined by spaces; shorter ones at its end."""
    return F.transform(
        words, lambda w, i: F.concat_ws(" ", w, *(F.get(F.col(words), i + j) for j in range(1, k)))
    )


def template_runs(spark: SparkSession, found: list[Template], k: int) -> DataFrame:
    """Runs of all templates: template number, place, hash and what is asked of a match."""
    if any(len(t.words) < k for t in found):
        raise ValueError(f"a template has fewer than {k} words")
    rows = [
        (i, t.label, t.base, len(t.words) - k + 1, t.share, place, " ".join(t.words[place : place + k]))
        for i, t in enumerate(found)
        for place in range(len(t.words) - k + 1)
    ]
    schema = "template int, label string, base boolean, runs int, share double, place int, own string"
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64("own"))


def text_words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none.

    Lower-casing everything is quicker and moves no word border, once the two signs whose
    small form is made of ASCII letters are set aside.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9"))
    return F.filter(F.split(F.lower(plain), GAP), lambda w: w != "")


def license_hits(docs: DataFrame, found: list[Template], k: int) -> DataFrame:
    """Places where runs of documents and templates meet, and one row for each document.

    The row of a document has no template. Runs are joined by hash and compared as text, so
    every hit is word for word.
    """
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_words(F.col("text")).alias("words"),
    )
    runs = read.select(
        "row_id",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), word_runs("words", k))).alias("at", "run"),
    ).withColumn("hash", F.xxhash64("run"))
    table = template_runs(docs.sparkSession, found, k)
    if sum(len(t.words) for t in found) <= BROADCAST_RUNS:
        table = F.broadcast(table)
    same = (runs["hash"] == table["hash"]) & (runs["run"] == table["own"])
    return (
        runs.join(table, same, "left")
        .filter((F.col("at") == 0) | F.col("template").isNotNull())
        .select("row_id", "doc_id", "n_words", "template", "label", "base", "runs", "share", "place", (F.col("at").cast("long") - 1).alias("at"))
    )


def license_spans(
    docs: DataFrame, found: list[Template] | None = None, k: int = RUN, drift: int = DRIFT
) -> DataFrame:
    """Verified licence spans of every row of ``docs``.

    Returns row_id, doc_id, n_words and spans: an array of structs of label, base, first and
    last (words from 0), share (of the template's runs found), ordered by first, label. A
    phrase needs all its runs on one diagonal; a passage needs its share of distinct runs
    on diagonals at most ``drift`` apart. Null and empty texts have no words and no spans;
    repeated rows and null ids stay apart by row_id, which numbers the rows of the scan.
    """
    found = templates() if found is None else found
    # Everything after the join goes by document: one shuffle of hits.
    hits = license_hits(docs, found, k).repartition("row_id")
    keys = ["row_id", "doc_id", "n_words", "template", "label", "base", "runs", "share"]
    votes = hits.groupBy(*keys, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    order = Window.partitionBy("row_id", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > drift)
    merged = (
        votes.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("band", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "band")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    share = F.col("hits") / F.col("runs")
    span = F.struct("first", "label", "base", (F.col("last") + (k - 1)).alias("last"), share.alias("share"))
    verified = F.when(F.col("template").isNotNull() & (share >= F.col("share")), span)
    return merged.groupBy("row_id", "doc_id", "n_words").agg(
        F.sort_array(F.collect_list(verified)).alias("spans")
    )


def license_scan(docs: DataFrame, found: list[Template] | None = None) -> DataFrame:
    """Licence labels of every row: base phrases, all labels and a score from 0 to 1.

    The score is 1 with a base phrase, else the best share of a passage found.
    """
    spans = license_spans(docs, found)
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])

    def labels(chosen: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda s: s["label"]))), ",")

    best = F.array_max(F.transform("spans", lambda s: s["share"]))
    return spans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        "spans",
    )
