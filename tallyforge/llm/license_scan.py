"""License scans by an exact set-similarity join of text blocks with templates, in SQL functions only.

A document's words are cut into overlapping blocks.  The templates' tokens are ordered by their number in all documents,
the rarest first.  A block that holds enough of a template must hold a token of the template's prefix among its own first
tokens, and enough tokens of the template (length) of which enough are left from the matched place on (position); what
passes is counted exactly.  Blocks are at most as long as two of the longest template, so a row is small, and they meet
the templates, a short list, where they are cut: nothing is shuffled by token.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public license notices and the labels of the method.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Least share of a template's tokens that a block must hold.
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), lambda w: w != "")


def _plain(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def places(w: Column) -> Column:
    """Array of (at, label): where the words of a phrase stand one after another."""
    def starts(phrase: str, label: str) -> Column:
        here = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == t for k, t in enumerate(phrase.split())])
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), here), lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    found = [starts(p, lab) for p, lab in PHRASES.items()]
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(F.arrays_overlap(w, F.array(*[F.lit(p.split()[-1]) for p in PHRASES])), F.concat(*found)).otherwise(none)


def template_sets(templates: list[tuple[str, str]], share: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct tokens, tokens that a block must hold) of each template."""
    sets = [(lab, list(dict.fromkeys(_plain(t)))) for lab, t in templates]
    return [(lab, toks, max(1, ceil(share * len(toks) - 1e-9))) for lab, toks in sets if toks]


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, the rarest in all documents first; one number a token of the templates reaches the driver."""
    each = docs.select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    n = {r["w"]: r["count"] for r in each.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def similar_blocks(blocks: DataFrame, sets: list[tuple[str, list[str], int]], order: list[str], keep: list[str]) -> DataFrame:
    """Pairs of blocks and templates with enough shared tokens: (*keep, label, score).

    blocks: tokens (array, distinct).  order: the templates' tokens, the rarest first; other tokens cannot be shared and
    take no part.  Exact: every pair above the threshold is found once.
    """
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, toks, need in sets:
        mine = sorted(rank[w] for w in toks)
        # without need - 1 of its tokens a template cannot reach ``need``, so one of the first ones must be shared
        whole = F.array(*map(F.lit, mine))
        rows += [F.struct(F.lit(label).alias("label"), whole.alias("t"), F.lit(need).alias("need"), F.lit(r).alias("tok"), F.lit(i).alias("i")) for i, r in enumerate(mine[: len(mine) - need + 1])]
    prefix = F.broadcast(blocks.sparkSession.range(1).select(F.inline(F.array(*rows))))  # templates x their tokens at most
    numbers = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    ranks = F.array_sort(F.array_compact(F.transform("tokens", lambda w: F.element_at(numbers, w))))
    least = min(need for _, _, need in sets)
    b = blocks.select(*keep, ranks.alias("b")).where(F.size("b") >= least)
    # the block's prefix for the least need: later tokens leave too few behind them
    tokens = b.select(*keep, "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("j", "tok"))
    met = tokens.join(prefix, "tok").where((F.size("b") >= F.col("need")) & (F.least(F.size("b") - F.col("j"), F.size("t") - F.col("i")) >= F.col("need")))
    shared = F.array_intersect("b", "t")
    # a pair stands at its first shared token only; that the count is enough puts that token in both prefixes
    met = met.withColumn("x", shared).where((F.get("x", F.lit(0)) == F.col("tok")) & (F.size("x") >= F.col("need")))
    return met.select(*keep, "label", (F.size("x") / F.size("t")).alias("score"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, share: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Blocks start every ``stride`` words and are two strides long, the stride being the longest template's words, so what
    is no longer than a template lies whole in a block.  score: 1 where a phrase stands, else the largest share of a
    template that a block holds, 0 below the threshold.  A null text is empty; empty texts have no words, no labels and
    score 0.  Repeated rows get the same result each; rows that share an id but not the text, or have none, are scanned
    on their own.  Of equal scores nothing is chosen: all labels stand.  A text of any length is cut into words where it
    is read.  An empty table gives no row.  Other columns are not read.  The templates are a short list, sent to every
    task.
    """
    sets = template_sets(templates, share)
    stride = max((len(_plain(t)) for _, t in templates), default=1)
    order = token_order(docs, sorted({w for _, toks, _ in sets for w in toks})) if sets else []
    rank = {w: i for i, w in enumerate(order)}
    rare = sorted({w for _, toks, need in sets for w in sorted(toks, key=rank.get)[: len(toks) - need + 1]}, key=rank.get)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))
    none = F.array().cast("array<array<string>>")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_w") / stride).cast("int") - 2))
    pieces = F.transform(starts, lambda i: F.array_distinct(F.slice("_w", i * stride + 1, F.lit(2 * stride))))
    rare_tokens = F.array(*[F.lit(w) for w in rare]).cast("array<string>")
    # a block without a token of any prefix is left behind where it is cut
    blocks = F.when(F.arrays_overlap("_w", rare_tokens), F.filter(pieces, lambda p: F.arrays_overlap(p, rare_tokens))).otherwise(none)
    rows = docs.select("doc_id", key.alias("_row"), words(F.col("text")).alias("_w"))
    rows = cut(rows.select("doc_id", "_row", F.size("_w").cast("bigint").alias("n_words"), places(F.col("_w")).alias("_base"), blocks.alias("_blocks")))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    names = F.transform("_base", lambda x: x["label"])
    out = lambda df, more, score: df.select(
        "doc_id", "n_words", F.size("_base").cast("bigint").alias("n_base"), F.array_min(F.transform("_base", lambda x: x["at"])).alias("first_word"), F.array_max(F.transform("_base", lambda x: x["at"])).alias("last_word"),
        joined(names).alias("base_labels"), joined(F.concat(names, more)).alias("labels"), F.round(F.when(F.size("_base") > 0, 1.0).otherwise(score), 6).alias("score"),
    )
    without = out(rows.where(F.size("_blocks") == 0), F.array().cast("array<string>"), F.lit(0.0))
    if not sets:
        return without
    near = similar_blocks(rows.select("_row", F.explode("_blocks").alias("tokens")), sets, order, ["_row"])
    near = near.groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("score").alias("_score"))  # as many labels as templates at most
    found = rows.where(F.size("_blocks") > 0).join(near, "_row", "left")
    return without.unionByName(out(found, F.coalesce("_more", F.array().cast("array<string>")), F.coalesce("_score", F.lit(0.0))))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, share: float = CONTAINMENT) -> str:
    """The same for DuckDB: every block against every template (documents with unique ids)."""
    sets = template_sets(templates, share)
    stride = max(len(_plain(t)) for _, t in templates)
    listed = ", ".join(f"('{lab}', [{', '.join(repr(w) for w in toks)}], {need})" for lab, toks, need in sets)
    every = " UNION ALL ".join(
        f"SELECT doc_id, i AS p0, '{lab}' AS label FROM (SELECT doc_id, w, unnest(range(len(w)::BIGINT)) AS i FROM d WHERE contains(t, '{p.split()[-1]}')) WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) for p, lab in PHRASES.items()
    )
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, t, list_filter(string_split_regex(t, '{GAP}'), lambda x: x <> '') AS w FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)),
base AS ({every}),
b AS (SELECT doc_id, count(*) AS n, min(p0) AS lo, max(p0) AS hi FROM base GROUP BY doc_id),
tpl(label, toks, need) AS (VALUES {listed}),
blk AS MATERIALIZED (SELECT doc_id, list_distinct(w[i * {stride} + 1 : i * {stride} + {2 * stride}]) AS toks FROM (SELECT doc_id, w, unnest(range(greatest(1, ceil(len(w) / {stride}.0)::BIGINT - 1))) AS i FROM d)),
hit AS (SELECT doc_id, label, len(list_intersect(blk.toks, tpl.toks)) / len(tpl.toks) AS score FROM blk, tpl WHERE len(list_intersect(blk.toks, tpl.toks)) >= need),
labs AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM base) GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(bl.l, '') AS base_labels, coalesce(labs.l, '') AS labels,
  round(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(sc.s, 0.0) END, 6)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN labs USING (doc_id) LEFT JOIN sc USING (doc_id)"""
