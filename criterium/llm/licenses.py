"""License scans: an exact set-similarity join of text blocks with license templates, native.

Words are runs of letters (A-Z as a-z), digits and all other than ASCII; what is compared are sets of word
pairs, two words that follow each other, so that a template's words scattered over prose are none of it. A block
is a window of 2 x L pairs that begins at every L-th pair, L being the number of pairs of the longest template, so
that whatever stands in L pairs, over line ends and comment marks, lies whole in some block. A template is found in
a block that holds at least ``threshold`` of the template's distinct pairs. Such a block lacks no more of the
template's words than of its pairs, which says how many words it needs. Template words are ordered by document
frequency over the whole corpus, rarest first; a block can only hold enough words of a template if it holds one
of the template's first (size - need + 1) words (prefix filter), has enough template words (length filter), and has
enough of them left after the match (positional filter). Texts with a block that passes are verified exactly, by pairs.

A row is scanned where it stands, against the templates as literals: no text, block or link is
shuffled, so no source or group of copies is hot. A first pass counts template words.

Defined cases: a null text is an empty one and has no words; a text that repeats a phrase counts every
place of it; an empty table gives no rows; very long texts have as many blocks as they need; repeated
rows give a row each; other columns are left aside; a template of one word is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Of a notice of 24 words two pairs may be broken, of one of five none. Below 0.87 a notice of the gpl would be one of the lgpl.
THRESHOLD = 0.9

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wordings of public licenses and notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "all rights reserved"),
]


#: ASCII characters that end a word.
ENDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words of a text, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + ENDS, LOWER + " " * len(ENDS))
    return F.array_remove(F.split(plain, " "), "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def pairs(tokens: Column) -> Column:
    """Every two words that follow each other, in order."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def pairs_of(text: str) -> list[str]:
    """A template's pairs."""
    own = text.split()
    if len(own) < 2:
        raise ValueError(f"a template needs two words: {text!r}")
    return [f"{a} {b}" for a, b in zip(own, own[1:])]


def places(tokens: Column, phrase: str) -> Column:
    """Starts of a phrase among the words."""
    parts = phrase.split()
    here = lambda i: F.array_join(F.slice(tokens, i + 1, len(parts)), " ") == phrase
    first = F.filter(F.sequence(F.lit(0), F.size(tokens) - len(parts)), lambda i: (F.get(tokens, i) == parts[0]) & here(i))
    return F.when(F.size(tokens) >= len(parts), first).otherwise(F.array().cast("array<int>"))


class Index:
    """Templates with their words rarest first; ``span`` is the number of the longest one's pairs.

    Where a block lacks m of a template's pairs it lacks m of its words at most, so blocks that lack more words are passed over.
    """

    def __init__(self, templates: list[tuple[str, str]], threshold: float, frequency: dict[str, int]):
        self.span = max((len(pairs_of(t)) for _, t in templates), default=1)
        self.order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: k for k, w in enumerate(self.order)}
        self.rows, self.pairs = [], []
        for label, text in templates:
            own, two = sorted({*text.split()}, key=rank.__getitem__), sorted({*pairs_of(text)})
            enough = max(1, math.ceil(threshold * len(two) - 1e-9))
            need = max(1, len(own) - (len(two) - enough))
            self.rows.append((label, own, need, own[: len(own) - need + 1]))
            self.pairs.append((label, two, enough))
        self.probes = sorted({w for *_, prefix in self.rows for w in prefix})

    def literal(self) -> Column:
        return F.array(*(F.struct(strings(own).alias("own"), F.lit(need).alias("need"), strings(prefix).alias("prefix")) for _, own, need, prefix in self.rows))

    def blocks(self, tokens: Column, size: int) -> Column:
        """Windows of ``size`` that begin at every ``span``-th word or pair."""
        begins = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / self.span).cast("int"))
        return F.transform(begins, lambda k: F.slice(tokens, k * self.span + 1, size))

    def may_hold(self, tokens: Column) -> Column:
        """Whether the words of a block let some template through the prefix, length and positional filters, and enough of them are there."""

        def passes(block: Column, t: Column) -> Column:
            def place(p: Column, i: Column) -> Column:
                j = F.array_position(block, p).cast("int") - 1
                rest = 1 + F.least(F.size(t["own"]) - i - 1, F.size(block) - j - 1)
                return F.when(j >= 0, rest + F.least(i, j) >= t["need"]).otherwise(False)

            return (F.size(block) >= t["need"]) & F.exists(F.transform(t["prefix"], place), lambda x: x) & (F.size(F.array_intersect(block, t["own"])) >= t["need"])

        probed = F.filter(self.blocks(tokens, 2 * self.span + 1), lambda b: F.arrays_overlap(b, strings(self.probes)))
        return F.exists(probed, lambda b: F.exists(self.literal(), lambda t: passes(F.array_intersect(strings(self.order), b), t)))

    def found(self, tokens: Column) -> Column:
        """(label, containment) of the templates that a block of the pairs holds."""
        templates = F.array(*(F.struct(F.lit(label).alias("label"), strings(two).alias("own"), F.lit(enough).alias("need")) for label, two, enough in self.pairs))
        held = lambda b: F.transform(templates, lambda t: F.struct(t["label"].alias("label"), F.size(F.array_intersect(b, t["own"])).alias("n"), t["need"].alias("need"), F.size(t["own"]).alias("of")))
        every = F.filter(F.flatten(F.transform(self.blocks(pairs(tokens), 2 * self.span), held)), lambda x: x["n"] >= x["need"])
        return F.transform(every, lambda x: F.struct(x["label"].alias("label"), (x["n"] / x["of"]).alias("containment")))


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest containment of a template, 1 where a base phrase stands, else 0.
    """
    templates = templates or TEMPLATES
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counted = docs.select(F.explode(F.array_intersect(strings(vocabulary), words(F.col("text")))).alias("word")).groupBy("word").count()
    index = Index(templates, threshold, {r["word"]: r["count"] for r in counted.collect()})  # template words alone

    tokens = F.col("tokens")
    rows = docs.select("doc_id", words(F.col("text")).alias("tokens"))
    heads = sorted({p.split()[-1] for p in PHRASES})
    rows = rows.select("doc_id", "tokens", F.arrays_overlap(tokens, strings(heads)).alias("may"), F.arrays_overlap(tokens, strings(index.probes)).alias("probed"))
    none = "array<struct<label:string,containment:double>>"
    found = F.when(F.when(F.col("probed"), index.may_hold(tokens)).otherwise(False), index.found(tokens)).otherwise(F.array().cast(none))
    base = [F.when(F.col("may"), places(tokens, p)).otherwise(F.array().cast("array<int>")).alias(label) for p, label in PHRASES.items()]
    rows = rows.select("doc_id", F.size(tokens).cast("long").alias("n_words"), *base, found.alias("found"))
    every = F.concat(*(F.col(label) for label in PHRASES.values()))
    named = F.array_compact(F.array(*(F.when(F.size(label) > 0, F.lit(label)) for label in PHRASES.values())))
    rows = rows.select("doc_id", "n_words", every.alias("every"), named.alias("named"), F.array_distinct(F.col("found.label")).alias("found"), F.array_max(F.col("found.containment")).alias("containment"))
    return rows.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("named"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("named", "found")), ",").alias("labels"),
        F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
