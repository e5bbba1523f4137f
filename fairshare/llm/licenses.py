"""License scan: rolling word k-grams joined to template positions, voted for by diagonal."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.llm.texts import lower_az

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Short statements that count where their words stand consecutively, beside the phrases.
STATEMENTS = [
    ("gpl", "under the gnu general public license"),
    ("lgpl", "under the gnu lesser general public license"),
    ("agpl", "under the gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("apache-2", "licensed under the apache license 2"),
    ("bsd", "under the bsd license"),
    ("bsd", "bsd 2 clause"),
    ("bsd", "bsd 3 clause"),
    ("isc", "under the isc license"),
    ("cc-by", "licensed under cc by 4"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0"),
    ("reserved", "all rights reserved"),
]

# Notices that count if most of their words stand together.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this "
     "file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the "
     "terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 "
     "international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 "
     "international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
]

MOST_WORDS = 1_000_000


def _templates(spark: SparkSession, phrases, statements, notices, k: int) -> DataFrame:
    """A row for each k-gram position of each template, and one that stands for every document."""
    kinds = ((phrases, True, True), (statements, False, True), (notices, False, False))
    listed = [(label, text, exact, strict) for pairs, exact, strict in kinds for label, text in pairs]
    if sum(len(text.split()) for _, text, *_ in listed) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words in all")
    if short := [text for _, text, *_ in listed if len(text.split()) < k]:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    rows = [
        F.struct(
            F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"),
            F.lit(strict).alias("strict"), F.lit(text).alias("text"),
        )
        for n, (label, text, exact, strict) in enumerate(listed)
    ]
    whole = spark.range(1).select(F.inline(F.array(*rows)))
    whole = whole.withColumn("t", F.split("text", " ")).withColumn("length", F.size("t"))
    grams = whole.select(
        "template", "label", "exact", "strict", "length", "t", F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("at")
    )
    at = [F.get("t", F.col("at") + j) for j in range(k)]
    grams = grams.select("template", "label", "exact", "strict", "length", "at", F.xxhash64(*at).alias("gram"), F.slice("t", F.col("at") + 1, k).alias("same"))
    document = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("exact"),
        F.lit(True).alias("strict"), F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gram"),
        F.lit(None).cast("array<string>").alias("same"),
    )
    return grams.unionByName(document)


def license_spans(
    docs: DataFrame,
    text: str = "text",
    phrases: Iterable[tuple[str, str]] = PHRASES,
    statements: Iterable[tuple[str, str]] = STATEMENTS,
    notices: Iterable[tuple[str, str]] = NOTICES,
    k: int = 3,
    slack: int = 3,
    share: float = 0.8,
) -> DataFrame:
    """The columns of ``docs`` but ``text`` in a struct ``doc``, with ``n_words`` and ``spans``.

    Words are taken from the whole text with A-Z lowered. All its rolling hashes of ``k`` words meet
    the template positions in one join; hits vote for the diagonal (place in the text less place
    in the template). A phrase or statement is found where its whole diagonal is. For notices, diagonals at
    most ``slack`` words apart merge, so words put in or left out do not part a span, and the span
    stays if the template's words in it, compared as words, are at least ``share`` of the template.

    ``spans`` is an array of (label, exact, start, end, coverage), ``exact`` for phrases alone, words from 0, end exclusive, in
    order of start. Rows stay as they are, repeated ones too; null and empty texts have no words
    and no spans. No Python runs on the rows. Templates are broadcast; they hold at most
    ``MOST_WORDS`` words.
    """
    templates = F.broadcast(_templates(docs.sparkSession, list(phrases), list(statements), list(notices), k))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        (F.struct(*kept) if kept else F.lit(None)).alias("doc"),
        F.regexp_extract_all(lower_az(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"),
    )
    # place -1 stands for the document itself, so that one without hits stays
    last = F.greatest(F.size("w") - k, F.lit(-1))
    places = words.select("row", "doc", "w", F.explode(F.sequence(F.lit(-1), last)).alias("place"))
    here = [F.get("w", F.col("place") + j) for j in range(k)]
    places = places.withColumn("g", F.when(F.col("place") < 0, F.lit(0)).otherwise(F.xxhash64(*here)))
    alike = F.lit(True)
    for j in range(k):
        alike = alike & (here[j] == F.get("same", F.lit(j)))
    document = F.col("template") < 0
    met = (F.col("g") == F.col("gram")) & F.when(F.col("place") < 0, document).otherwise(~document & alike)
    hits = places.join(templates, met).select(
        "row",
        F.when(document, F.col("doc")).alias("doc"),
        F.size("w").alias("n_words"),
        "template", "label", "exact", "strict", "length", "at", "place",
        (F.col("place") - F.col("at")).alias("diagonal"),
    )
    template = ["row", "template", "label", "exact", "strict", "length"]
    firsts = [F.first("doc", ignorenulls=True).alias("doc"), F.max("n_words").alias("n_words")]
    ends = [F.min("place").alias("start"), F.max("place").alias("last")]
    diagonals = hits.repartition("row").groupBy(*template, "diagonal")
    diagonals = diagonals.agg(*firsts, *ends, F.collect_list("at").alias("at"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = (F.col("strict") | gap.isNull() | (gap > slack)).cast("int")
    groups = diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(along))
    merged = groups.groupBy(*template, "group").agg(
        *firsts, F.min("start").alias("start"), F.max("last").alias("last"), F.flatten(F.collect_list("at")).alias("at")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + (k - 1))))))
    merged = merged.withColumn("coverage", F.when(~document, covered / F.col("length")))
    enough = F.when(F.col("strict"), F.lit(1.0)).otherwise(F.lit(share))
    held = merged.where(document | (F.col("coverage") >= enough))
    span = F.struct(
        F.col("start").cast("long").alias("start"), (F.col("last") + k).cast("long").alias("end"), "label", "exact", "coverage"
    )
    return held.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(~document, span))).alias("spans"),
    ).drop("row")
