"""License scans by diagonal voting. DataFrame functions only.

All rolling word 3-grams of all texts are hashed and joined with the positions of the same 3-grams in license templates. A match
votes for its diagonal, the offset between text and template. Votes are summed by diagonal, neighbouring diagonals
are merged into spans, and a span counts if the template words it covers, checked word by word, make up enough of the template.
A diagonal with all votes of a template is an exact place of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a text after A-Z became a-z, and the phrases of the base labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Further templates: opening words of public license texts and notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "cc-by-nc": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
GRAM = 3
#: Largest step between diagonals of one span, and the share of template words that a span must cover.
DRIFT, COVERED = 2, 0.7


def template_grams(spark: SparkSession, templates: list[tuple[str, bool, str]] | None = None, gram: int = GRAM) -> DataFrame:
    """(template, label, base, words, at, gram): one row a 3-gram of a template. As large as the templates, which are fixed texts."""
    given = templates or [(k, True, v) for k, v in BASE.items()] + [(k, False, v) for k, v in TEMPLATES.items()]
    rows = spark.createDataFrame([(k, label, base, text) for k, (label, base, text) in enumerate(given)], "template int, label string, base boolean, text string")
    rows = rows.withColumn("w", F.split("text", " ")).withColumn("words", F.size("w"))
    rows = rows.select("template", "label", "base", "words", "w", F.explode(F.sequence(F.lit(0), F.col("words") - gram)).alias("at"))
    parts = [F.element_at("w", (F.col("at") + k + 1).cast("int")) for k in range(gram)]
    return rows.select("template", "label", "base", "words", "at", F.xxhash64(*parts).alias("hash"), *[p.alias(f"t{k}") for k, p in enumerate(parts)])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, bool, str]] | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every input row; spans: rid, label, start, end, cover.

    Whole texts; a null text is empty. n_base counts the exact places of base templates, first_word and last_word are the smallest and
    largest start; a label is reported if a base phrase stands in the text or a span covers COVERED of one of its templates, score is the largest share
    covered. Texts shorter than a 3-gram have no labels. Repeated rows are scanned separately, a null doc_id is kept; an empty table gives
    an empty result. Other columns are not used.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("w"))
    grams = F.arrays_zip(F.col("w").alias("g0"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("g1"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("g2"))
    # an entry before the first word stands for the row itself, so that no second pass is needed
    head = F.array(F.struct(*[F.lit(None).cast("string").alias(f"g{k}") for k in range(GRAM)]))
    rows = base.select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(head, grams)).alias("pos", "g"))
    rows = rows.select("rid", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "g.*")
    rows = rows.where("pos < 0 or g2 is not null").withColumn("hash", F.when(F.col("pos") >= 0, F.xxhash64("g0", "g1", "g2")))
    known = F.broadcast(template_grams(spark, templates))
    same = (rows["hash"] == known["hash"]) & (rows["g0"] == known["t0"]) & (rows["g1"] == known["t1"]) & (rows["g2"] == known["t2"])
    votes = rows.join(known, same, "left").where("pos < 0 or template is not null")
    by_diagonal = votes.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("rid", "doc_id", "n_words", "template", "label", "base", "words", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    place = (F.size("ats") == F.col("words") - GRAM + 1) & F.col("base")
    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    stepped = by_diagonal.withColumn("place", F.coalesce(place, F.lit(False))).withColumn("step", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT).cast("int"), F.lit(0)))
    merged = stepped.withColumn("span", F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("rid", "doc_id", "n_words", "template", "label", "base", "words", "span").agg(
        F.min("start").alias("start"), (F.max("end") + GRAM - 1).alias("end"), F.flatten(F.collect_list("ats")).alias("ats"),
        F.count_if("place").alias("places"), F.min(F.when(F.col("place"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("place"), F.col("diagonal"))).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1)))))
    spans = spans.withColumn("cover", F.when(F.col("template").isNotNull(), covered / F.col("words")))
    hit = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("cover") >= COVERED)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    done = spans.groupBy("rid", "doc_id", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        joined(F.col("base") & (F.col("places") > 0)).alias("base_labels"), joined(hit).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    found = spans.where(hit).select("rid", "doc_id", "label", "start", "end", "cover")
    return done.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score"), found
