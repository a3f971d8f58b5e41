"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A document's words, lower-cased, are cut into blocks of twice as many words as the longest template has, each half over the next, so that every stretch as
long as a template lies whole in a block wherever lines are broken. A block and a template are sets of words; a template is found in a block that holds at least
`alpha` of its words, a share `threshold` of them (all, for a template under SHORT words), its required words included.

Words are ordered by the number of blocks they are in, the rarest first. If a block shares alpha words with a template, the first word they share is among the first
size - alpha + 1 of both (prefix filter), both have alpha words (length filter), and as many words are left behind it in both as are still needed
(positional filter). So blocks are exploded into the words of their prefixes only, and met with the templates' prefixes by a broadcast join: templates are a
parameter, with MAX_WORDS words in all. A pair is counted at the first word that it shares, in the row where it met: nothing is shuffled before it is found.
Only words that templates have are kept of a block, as no other can be shared.

A template whose words are all in another one found in the same block gives way to that one.

Phrases are found as consecutive words, beside the templates: a document gets the labels of both.

Edges: a null or empty text has no words and no labels; very long texts are cut into blocks of the same size; rows that repeat a doc_id, or have none, are
judged each, as rows are numbered; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.llm.common import written

#: What separates words, as Java writes it.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Templates of fewer words have to be there whole.
SHORT = 8
MAX_WORDS = 20_000
#: phrase: its label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    name: str
    label: str
    text: str
    required: str


TEMPLATES = [
    Template("mit-notice", "mit", "released under the MIT License", "mit license"),
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "permission granted software restriction"),
    Template("apache-2-notice", "apache-2", "licensed under the Apache License, Version 2.0", "apache license 2"),
    Template("apache-2-terms", "apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license 2"),
    Template("bsd-terms", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary forms"),
    Template("bsd-notice", "bsd", "licensed under the BSD license", "bsd license"),
    Template("gpl-3-notice", "gpl-3", "this work is licensed under the GNU General Public License, version 3", "gnu general public license 3"),
    Template("gpl-3-terms", "gpl-3", "free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License", "gnu general public license 3"),
    Template("gpl-2-notice", "gpl-2", "this work is licensed under the GNU General Public License, version 2", "gnu general public license 2"),
    Template("lgpl-3-notice", "lgpl-3", "this work is licensed under the GNU Lesser General Public License, version 3", "gnu lesser general public license 3"),
    Template("agpl-3-notice", "agpl-3", "this work is licensed under the GNU Affero General Public License, version 3", "gnu affero general public license 3"),
    Template("mpl-2-notice", "mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "mozilla public license 2"),
    Template("cc-by-notice", "cc-by", "licensed under CC BY 4.0", "cc by 4"),
    Template("cc-by-sa-notice", "cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa 4"),
    Template("cc-by-nc-notice", "cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc 4"),
    Template("cc-by-nd-notice", "cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd 4"),
    Template("cc-by-terms", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    Template("cc-by-sa-terms", "cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    Template("cc-by-nc-terms", "cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "creative commons attribution noncommercial"),
    Template("public-domain", "public-domain", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide", "dedicated copyright public domain"),
]


def words_in(text: str) -> list[str]:
    """The words of a template or a phrase, as words_of() cuts them."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def places(words: Column, phrase: list[str]) -> Column:
    """Where a phrase's words stand consecutively; the search is left out where one of them is not there at all."""
    there = F.lit(True)
    for w in sorted(set(phrase), key=lambda w: (-len(w), w)):
        there = there & F.array_contains(words, w)
    last = F.size(words) - len(phrase)

    def stands(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(phrase):
            same = same & (F.get(words, i + k) == w)
        return same

    return F.when(there & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)).otherwise(F.array().cast("array<int>"))


def alpha_of(n: int, threshold: float) -> int:
    return n if n < SHORT else max(math.ceil(n * threshold - 1e-9), 1)


def scanned(docs: DataFrame, templates: list[Template], phrases: dict[str, str], threshold: float, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, base, blocks (block, tokens): all that is read of a text."""
    sets = [set(words_in(t.text)) for t in templates]
    vocabulary = sorted(set().union(*sets))
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"templates have {len(vocabulary)} words, more than {MAX_WORDS}")
    half = max((len(words_in(t.text)) for t in templates), default=1)
    least = min((alpha_of(len(s), threshold) for s in sets), default=1)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    words, n = F.col("words"), F.size("words")

    def block(k: Column) -> Column:
        own = F.filter(F.slice(words, k * half + 1, 2 * half), lambda w: w.isin(vocabulary))
        return F.struct(k.alias("block"), F.array_distinct(own).alias("tokens"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - half, F.lit(0)) / half).cast("int")), block)
    found = [(places(words, words_in(p)), label) for p, label in phrases.items()]
    named = [f"__p{i}" for i in range(len(found))]
    rows = rows.select("doc_id", n.cast("long").alias("n_words"), F.filter(blocks, lambda b: F.size(b["tokens"]) >= least).alias("blocks"), *(p.alias(c) for c, (p, _) in zip(named, found, strict=True)))
    every = F.flatten(F.array(*named)) if named else F.array().cast("array<int>")
    base = F.array(*(F.when(F.size(c) > 0, label) for c, (_, label) in zip(named, found, strict=True))) if named else F.array().cast("array<string>")
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(base).alias("base"), "blocks",
    )


def template_rows(spark: SparkSession, templates: list[Template], threshold: float) -> DataFrame:
    """name, label, words, required, alpha, wider (the templates that have all of its words and more)."""
    sets = {t.name: set(words_in(t.text)) for t in templates}
    rows = [(t.name, t.label, sorted(sets[t.name]), sorted(set(words_in(t.required))), alpha_of(len(sets[t.name]), threshold), [o for o in sets if sets[o] > sets[t.name]]) for t in templates]
    return spark.createDataFrame(rows, "name string, label string, words array<string>, required array<string>, alpha int, wider array<string>")


def found_templates(rows: DataFrame, templates: list[Template], threshold: float) -> DataFrame:
    """row, block, name, label, containment: a row for each template found in a block; rows: a table as scanned() gives."""
    spark = rows.sparkSession
    own = template_rows(spark, templates, threshold)
    least = min((alpha_of(len(set(words_in(t.text))), threshold) for t in templates), default=1)
    # How many blocks a word is in; a row for each word of the templates, 0 where no block has it.
    seen = rows.select(F.explode("blocks").alias("b")).select(F.explode("b.tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    every = seen.union(own.select(F.explode("words").alias("w"), F.lit(0).cast("long").alias("n"))).groupBy("w").agg(F.sum("n").alias("n"))
    order = written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("order")), "license_words")
    # array_intersect keeps the order of its first array: a set's words, the rarest first. The order is one row.
    sorted_own = own.crossJoin(order).select("name", "label", "required", "alpha", "wider", F.array_intersect("order", "words").alias("t"))
    heads = sorted_own.select("*", F.posexplode(F.expr("slice(t, 1, size(t) - alpha + 1)")).alias("p", "w"))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens").crossJoin(F.broadcast(order))
    blocks = blocks.select("row", "block", F.array_intersect("order", "tokens").alias("b"))
    blocks = blocks.select("*", F.posexplode(F.expr(f"slice(b, 1, size(b) - {least} + 1)")).alias("q", "w"))
    left = F.expr("size(b) >= alpha and 1 + least(size(t) - p - 1, size(b) - q - 1) >= alpha")
    met = blocks.join(F.broadcast(heads), "w").where(left).withColumn("both", F.array_intersect("t", "b"))
    met = met.where("both[0] = w and size(both) >= alpha and size(array_except(required, b)) = 0")
    met = met.select("row", "block", "name", "label", "wider", (F.size("both") / F.size("t")).alias("containment"))
    one = met.groupBy("row", "block").agg(F.collect_list(F.struct("name", "label", "wider", "containment")).alias("found"), F.collect_list("name").alias("names"))
    return one.select("row", "block", F.inline(F.filter("found", lambda x: ~F.arrays_overlap(x["wider"], F.col("names"))))).drop("wider")


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks: a row for each document.

    score: the largest share of a template that a block of the document holds, of those found, 0 without any; n_blocks: how many blocks hold one.
    """
    rows = written(scanned(docs, templates, phrases, threshold, id_col, text_col), "license_blocks")
    found = found_templates(rows, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"), F.count_distinct("block").alias("n_blocks"))
    both = rows.drop("blocks").join(found, "row", "left")
    some = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    every = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", some(F.col("base")).alias("base_labels"), some(every).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
