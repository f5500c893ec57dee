"""License scans by diagonal voting, in DataFrame functions alone.

Every pair of neighbouring words of a text is hashed; hashes that no template has
go at once, inside the row, so the work is linear in a text's length. The others
are joined to the places of the templates that hold them and checked word by
word. A hit votes for its diagonal, the offset between text and template. Votes
are added up by diagonal, neighbouring diagonals (words put in or left out) are
merged, and a merged span counts if it holds enough of the template and of itself.

The templates are a constant of the program, so their join is a broadcast of
known size. All rows of a text come from one row of the scan, keyed by the
number of that row, and meet in one shuffle. A text without words or hits comes
through by one row of its own.

Base labels are phrases found whole; others come from longer templates at
``coverage`` of their pairs. Defined results: null text is empty; each row of a
repeated doc_id has its own result; a null doc_id is scanned like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.vectors import bind

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Notices and openings of common licences; several templates may share a label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Pairs of these words stand in any prose and don't vote for a template.
COMMON = {"a", "and", "any", "at", "by", "for", "in", "is", "it", "of", "or", "that", "the", "this", "to", "under", "with", "you"}


def _votes() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, whether it is a phrase, its votes, place, word, next word)."""
    out = []
    for t, (label, text, phrase) in enumerate([*((label, p, True) for label, p in PHRASES.items()), *((*x, False) for x in TEMPLATES)], 1):
        w = text.split()
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(w, w[1:])) if phrase or not {a, b} <= COMMON]
        out += [(t, label, phrase, len(pairs), i, a, b) for i, a, b in pairs]
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """A-Z alone: letters outside ASCII stay; without any the quicker function does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def scan(docs: DataFrame, coverage: float = 0.75, slack: int = 3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    spark = docs.sparkSession
    votes = _votes()
    values = ", ".join(f"({t}, '{label}', {str(p).lower()}, {n}, {i}, '{a}', '{b}')" for t, label, p, n, i, a, b in votes)
    places = spark.sql(f"SELECT *, xxhash64(a, b) AS h FROM VALUES {values} AS v(t, label, phrase, votes, i, a, b)")
    both = sorted({(a, b) for *_, a, b in votes})
    wanted = [r.h for r in spark.sql(f"SELECT xxhash64(a, b) AS h FROM VALUES {', '.join(str(x) for x in both)} AS v(a, b)").collect()]  # a row for each pair of the templates

    def met(w: Column) -> Column:
        """How many words, and the places whose pair some template has."""
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)).isin(wanted))
        pairs = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(w, i).alias("x"), F.get(w, i + 1).alias("y")))
        return F.struct(F.size(w).alias("n_words"), pairs.alias("pairs"))

    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), bind(F.regexp_extract_all(_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0), met).alias("m"))
    flat = words.select("doc_id", "row", "m.n_words", F.explode_outer("m.pairs").alias("p"))
    flat = flat.select("doc_id", "row", "n_words", "p.*").withColumn("h", F.when(F.col("pos").isNotNull(), F.xxhash64("x", "y")))
    hits = flat.join(F.broadcast(places), (flat.h == places.h) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left")
    hits = hits.select("doc_id", "row", "n_words", "t", "label", "phrase", "votes", "pos", (F.col("pos") - F.col("i")).alias("diagonal")).repartition("row")
    lines = hits.groupBy("row", "t", "diagonal").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "phrase", "votes")], F.count("*").alias("got"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    # neighbouring diagonals of a template are one span; a phrase keeps each of its own
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(by), F.lit(-(2**30))) > slack)
    islands = lines.withColumn("cut", apart.cast("int")).withColumn("island", F.sum("cut").over(by))
    spans = islands.groupBy("row", "t", "island").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "phrase", "votes")], F.sum("got").alias("got"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"))
    share = F.least(F.col("got") / F.col("votes"), F.lit(1.0))
    # a span is real if its votes cover the template and don't lie scattered over the text
    dense = F.col("got") * 2 >= F.col("high") - F.col("low") + 1
    found = F.col("t").isNotNull() & F.when(F.col("phrase"), F.col("got") == F.col("votes")).otherwise((share >= coverage) & dense)
    base: Column = found & F.col("phrase")
    listed = lambda x: F.array_join(F.array_sort(F.collect_set(F.when(x, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("t").isNotNull() & (base | ~F.col("phrase")) & (F.col("phrase") | dense), share)), F.lit(0.0)).alias("score"),
    ).drop("row")
