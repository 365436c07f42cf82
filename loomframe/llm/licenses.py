"""Licence scans by diagonal voting, with DataFrame functions only.

Every document becomes its words.  The hash of each pair of neighbouring words
(the rolling k-gram, k = 2) is joined to the places of the same pair in a table of
notices.  Hits vote for the diagonal ``document place - notice place``.  A base
phrase stands where one diagonal holds every pair of it.  For the other notices,
diagonals at most ``gap`` apart are merged, so that a notice with a few words put in,
left out or changed still gathers its votes, and the span is verified: it counts if
it holds at least ``least`` of the notice's *different* places, each by its two words.
A pair that a text repeats, such as "of the", votes for one place however often it stands.

Pairs whose hash no notice has leave the array of a text's pairs before it is
exploded, in the one scan of the texts; so do all pairs of a text that has none of any notice's
*telling* pairs.  Those are so many of its places, its longest words first, that no span can reach ``least`` without one of them.  Broadcast: only the notice table, a constant of
this module (about 1,300 places).  What is shuffled is votes, summed before the
shuffle, and one marker a row with its word count.

A document is told by its id and a hash of its text, so rows that repeat an id are
documents of their own; equal rows are scanned once and returned as often as they stand.

Defined cases: null text is empty; without a word or a hit a document has zero
counts, null places, empty labels and score 0; the score is the best share of a
notice's places found in one span; ties need no order, as labels are sorted and counts
are sums; a null id is an id; a very long text is one array of its words in one task;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases whose every place is counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices and their labels.
NOTICES = {
    "Released under the MIT license": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "mit",
    "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl-3.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl-3.0",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under the Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at": "mpl-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License": "epl",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1.0",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of a notice are bits of MASKS longs.
BITS, MASKS = 60, 2


def notice_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def notice_table() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, base, words) of every phrase and notice."""
    return [(i, label, i < len(BASE), notice_words(text)) for i, (text, label) in enumerate([*BASE.items(), *NOTICES.items()])]


def ascii_lower(c: Column) -> Column:
    """A-Z only.  lower() does the same but for two letters outside ASCII that it maps into it."""
    odd = F.contains(c, F.lit("K")) | F.contains(c, F.lit("İ"))
    return F.when(odd, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def _words(text: Column) -> Column:
    """Words of a text; the last element is an empty string if separators end the text."""
    return F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "^" + SEPARATORS, ""), SEPARATORS)


def telling(words: list[str], least: float) -> list[int]:
    """Places of a notice of which any span with a share of ``least`` holds one."""
    pairs = len(words) - 1
    spare = pairs - math.ceil(least * pairs - 1e-9)
    return sorted(range(pairs), key=lambda p: (-min(len(words[p]), len(words[p + 1])), -len(words[p]) - len(words[p + 1]), p))[: spare + 1]


def _votes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """Votes by id, fp, n_words, notice and diagonal; the row without a notice has the number of equal rows in ``copies``."""
    spark = docs.sparkSession
    rows = [(i, label, base, len(w) - 1, p, w[p], w[p + 1], base or p in telling(w, least)) for i, label, base, w in notice_table() for p in range(len(w) - 1)]
    table = spark.createDataFrame(rows, "t int, label string, base boolean, pairs int, at int, a string, b string, tells boolean").withColumn("h", F.xxhash64("a", "b"))
    hashes = table.select("h", "tells").collect()
    known, tells = sorted({r["h"] for r in hashes}), sorted({r["h"] for r in hashes if r["tells"]})
    w = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), _words(F.col(text_col)).alias("w"))
    w = w.withColumn("n_words", (F.size("w") - F.when(F.get("w", F.size("w") - 1) == "", 1).otherwise(0)).cast("long"))
    pair = lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1))
    places = F.when(F.col("n_words") > 1, F.filter(F.sequence(F.lit(0), F.col("n_words").cast("int") - 2), lambda i: pair(i).isin(known)))
    places = F.get(F.transform(F.array(places), lambda x: F.when(F.exists(x, lambda i: pair(i).isin(tells)), x)), 0)
    hit = F.transform(places, lambda i: F.struct(i.alias("p"), F.get(F.col("w"), i).alias("a"), F.get(F.col("w"), i + 1).alias("b")))
    marker = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    hits = w.select("id", "fp", "n_words", F.explode(F.concat(marker, F.coalesce(hit, F.array().cast("array<struct<p:int,a:string,b:string>>")))).alias("x")).select("id", "fp", "n_words", "x.*")
    hits = hits.withColumn("h", F.xxhash64("a", "b")).join(F.broadcast(table), ["h", "a", "b"], "left").drop("tells")
    bit = lambda k: F.when(F.floor(F.col("at") / BITS) == k, F.expr(f"shiftleft(1L, at % {BITS})")).otherwise(F.lit(0).cast("long"))
    return hits.groupBy("id", "fp", "n_words", "t", "label", "base", "pairs", (F.col("p") - F.col("at")).alias("diagonal")).agg(
        *(F.bit_or(bit(k)).alias(f"m{k}") for k in range(MASKS)), F.min("p").alias("lo"), F.max("p").alias("hi"), F.count_if(F.col("p") < 0).alias("copies"))


def _spans(docs: DataFrame, id_col: str, text_col: str, gap: int, least: float) -> DataFrame:
    """Merged diagonals, verified (``good``) or not, and the markers."""
    votes = _votes(docs, id_col, text_col, least)
    own = Window.partitionBy("id", "fp", "t").orderBy("diagonal")
    opens = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(own) > gap), 1).otherwise(0)
    spans = votes.withColumn("o", opens).withColumn("g", F.sum("o").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "fp", "n_words", "t", "label", "base", "pairs", "g").agg(
        *(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(MASKS)), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("copies").alias("copies"))
    n = sum((F.bit_count(f"m{k}") for k in range(MASKS)), F.lit(0))
    share = F.col("n") / F.col("pairs")
    good = F.coalesce(F.when(F.col("base"), F.col("n") == F.col("pairs")).otherwise(share >= least), F.lit(False))
    return spans.withColumn("n", n).withColumn("share", share).withColumn("good", good)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, least: float = 0.75) -> DataFrame:
    """Spans of each distinct (id, text): id, notice, label, base, places found, share of the notice, first and last word of the span."""
    return _spans(docs, id_col, text_col, gap, least).filter("good").select(
        F.col("id").alias(id_col), "t", "label", "base", "n", "share", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + 1).cast("long").alias("last_word"))


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, least: float = 0.75) -> DataFrame:
    """One row per row: word count, base places, their labels, all labels and a score."""
    base, good = F.col("good") & F.col("base"), F.col("good")
    per = _spans(docs, id_col, text_col, gap, least).groupBy("id", "fp", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    out = [F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*out)
