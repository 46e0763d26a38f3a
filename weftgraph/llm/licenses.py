"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a line of a text, or for each template a window of successive words that runs over line ends, as notices are
wrapped; its length is that of the template over THRESHOLD, so that as many words may be put in. A block belongs to a template when it holds THRESHOLD of the template's distinct words or
more. Template words are ordered by how many documents hold them, the rarest first; a qualifying block holds one of the
template's first `size - needed + 1` words (prefix), has `needed` distinct words (length), and its first shared word
leaves enough words behind it (position). Blocks that pass all three are counted in full, so none is missed. Of the
windows those around each prefix word are counted, one for each first word that the template holds.

Templates are a parameter of bounded size; documents are scanned twice and never shuffled. Nulls count as empty texts,
which have no words. Repeated rows get equal results; a row with a null key is scanned like any other. Of templates that
tie all labels are given. Texts of any length are scanned whole, an empty table gives an empty result, and only the key
and the text of a table are read, so other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .native import let

#: Fixed phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Notices in the words of widely used licenses, by label.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: Templates together may have this many distinct words; they become part of the plan.
MAX_VOCABULARY = 5000


def _words(text: Column) -> Column:
    """The words, one space apart; case is kept."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def ordered_templates(docs: DataFrame, templates: dict[str, list[str]], text: str, threshold: float) -> list[dict]:
    """label, words (the rarest first by the number of documents that hold them, ties by word), words needed and window of each template."""
    sets = [(label, set(t.split()), len(t.split())) for label, texts in templates.items() for t in texts if t.split()]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"templates of over {MAX_VOCABULARY} distinct words")
    held = F.array_intersect(F.split(F.lower(_words(F.coalesce(F.col(text).cast("string"), F.lit("")))), " "), _strings(vocabulary))
    counts = dict(docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()) if vocabulary else {}
    out = []
    for label, own, length in sets:
        ranked = sorted(own, key=lambda w: (counts.get(w, 0), w))
        out.append({"label": label, "words": ranked, "needed": max(1, math.ceil(threshold * len(ranked) - 1e-9)), "window": math.ceil(length / threshold - 1e-9)})
    return out


def scanned(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is 1 with a base phrase, else the highest share of a template that a qualifying block holds, else 0.
    """
    known = ordered_templates(docs, templates, text, threshold)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    phrase = r"(?i)(?<![^ ])(?:" + "|".join(PHRASES) + r")(?![^ ])"

    def base(x: Column) -> Column:
        own = F.struct(F.regexp_extract_all(x, F.lit(phrase), F.lit(0)).alias("found"), F.split(x, phrase, -1).alias("gaps"))

        def placed(o: Column) -> Column:
            last = _spaces(x) - _spaces(F.element_at(o["gaps"], -1)) - _spaces(F.element_at(o["found"], -1))
            return F.struct(
                F.size(o["found"]).cast("long").alias("n"), _spaces(o["gaps"][0]).cast("long").alias("first"), last.cast("long").alias("last"),
                F.array_distinct(F.transform(o["found"], lambda w: F.lower(w))).alias("phrases"),
            )

        return F.when(x.rlike(phrase), let(own, placed))

    prefixes = sorted({w for t in known for w in t["words"][: len(t["words"]) - t["needed"] + 1]})
    some = r"(?i)(?<![^ ])(?:" + "|".join(prefixes) + r")(?![^ ])" if prefixes else r"(?!)"

    def hit(t: dict, block: Column) -> Column:
        size, needed = len(t["words"]), t["needed"]

        def counted(n: Column) -> Column:
            return F.when(n >= needed, F.struct(F.lit(t["label"]).alias("label"), (n / size).alias("share")))

        def verified(held: Column) -> Column:
            position = F.array_position(held, True) - 1
            return F.when(size - position >= needed, let(F.size(F.filter(held, lambda h: h)), counted))

        held = F.transform(_strings(t["words"]), lambda w: F.array_contains(block, w))
        return F.when((F.size(block) >= needed) & F.arrays_overlap(block, _strings(t["words"][: size - needed + 1])), let(held, verified))

    def block_hits(block: Column) -> Column:
        """array<struct<label, share>> of the templates that a block (its distinct words) belongs to."""
        rows = [hit(t, block) for t in known]
        return F.filter(F.array(*rows), lambda r: r.isNotNull())

    def window_hit(t: dict, words: Column, places: Column) -> Column:
        """The best share of a window of the words; places are those of words that are a prefix word of some template."""
        size, needed, window = len(t["words"]), t["needed"], t["window"]
        own, prefix = _strings(t["words"]), _strings(t["words"][: size - needed + 1])

        def around(place: Column) -> Column:
            """Most distinct template words of a window that holds this place, or 0 where even all of them together have too few."""
            first = F.greatest(place - window + 1, F.lit(0))

            def counted(near: Column) -> Column:
                starts = F.filter(F.sequence(F.lit(1), place - first + 1), lambda i: F.array_contains(own, F.element_at(near, i)))
                held = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(near, i, F.lit(window)), own)))
                return F.when(F.size(F.array_intersect(near, own)) >= needed, F.array_max(held)).otherwise(F.lit(0))

            return let(F.slice(words, first + 1, place - first + window), counted)

        def best(n: Column) -> Column:
            return F.when(n >= needed, F.struct(F.lit(t["label"]).alias("label"), (n / size).alias("share")))

        at = F.filter(places, lambda i: F.array_contains(prefix, words[i]))
        return let(F.array_max(F.transform(at, around)), best)

    def window_hits(words: Column) -> Column:
        def found(places: Column) -> Column:
            return F.filter(F.array(*(window_hit(t, words, places) for t in known)), lambda r: r.isNotNull())

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(_strings(prefixes), words[i]))
        return let(places, found)

    def joined(text: Column) -> Column:
        blocks = F.transform(F.split(text, "\n"), lambda line: F.array_distinct(F.split(F.lower(_words(line)), " ")))
        lines = F.flatten(F.transform(F.filter(blocks, lambda b: F.arrays_overlap(b, _strings(prefixes))), block_hits))
        return F.concat(lines, let(F.split(F.lower(_words(text)), " "), window_hits))

    nothing = F.array().cast("array<struct<label:string,share:double>>")
    hits = F.when(F.col("words").rlike(some), joined(F.col("text"))).otherwise(nothing) if known else nothing
    own = chosen.select("doc_id", "text", _words(F.col("text")).alias("words"))
    own = own.select("doc_id", "words", F.array(base(F.col("words"))).alias("bases"), F.array(F.struct(hits.alias("hits"))).alias("found"))

    def result(x: Column) -> Column:
        phrases = F.coalesce(x["base"]["phrases"], F.array().cast("array<string>"))
        names = F.create_map(*(F.lit(v) for pair in PHRASES.items() for v in pair))
        labels = F.array_sort(F.array_distinct(F.transform(phrases, lambda p: F.element_at(names, p))))
        best = F.coalesce(F.array_max(F.transform(x["hits"], lambda h: h["share"])), F.lit(0.0))
        return F.struct(
            F.when(x["words"] == "", F.lit(0)).otherwise(_spaces(x["words"]) + 1).cast("long").alias("n_words"),
            F.coalesce(x["base"]["n"], F.lit(0).cast("long")).alias("n_base"), x["base"]["first"].alias("first_word"), x["base"]["last"].alias("last_word"),
            F.array_join(labels, ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.transform(x["hits"], lambda h: h["label"])))), ",").alias("labels"),
            F.when(x["base"]["n"] > 0, F.lit(1.0)).otherwise(best).alias("score"),
        )

    row = F.struct("words", F.col("bases")[0].alias("base"), F.col("found")[0]["hits"].alias("hits"))
    return own.select("doc_id", let(row, result).alias("r")).select("doc_id", "r.*")
