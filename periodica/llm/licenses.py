"""License scan by diagonal voting.

Templates are short phrases and longer notices. Every run of ``k`` words of a
document (2 for phrases, 4 for notices) is joined by its hash to the places of
that run in the templates. A match votes for its diagonal, the document's place minus the
template's. Votes are summed per diagonal, the diagonals of a notice that lie
near each other (words put in or left out) are merged, and spans with enough
votes are verified on the words: a phrase must stand as it is, a notice must be
covered to ``COVERED`` of its words in order.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
Null or empty texts have no words, no labels and score 0. Repeated rows are kept:
equal rows are scanned together and given once each. A null doc_id is a row like
others.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from periodica.llm.common import WordHashes, alnum_words, gram_hashes, list_array, null_safe, only_marked, signed, text_columns
from periodica.session import cut_lineage

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices as their licenses word them, and the labels they add.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution sharealike international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals of a notice this near are one; share of a notice's runs that must vote; share of its words that must be covered.
NEAR, VOTED, COVERED = 4, 0.4, 0.8

TEMPLATES = [(text.encode().split(), label, PHRASE_GRAM) for text, label in PHRASES] + [(text.encode().split(), label, NOTICE_GRAM) for text, label in NOTICES]
#: A document's own row passes the join under this hash.
OWN = 0


def template_grams(spark) -> DataFrame:
    """(g, template, at): the runs of all templates, and the row that each document meets once."""
    cache, rows = WordHashes(), [(OWN, -1, 0)]
    for number, (words, _, k) in enumerate(TEMPLATES):
        rows += [(int(g), number, at) for at, g in enumerate(signed(gram_hashes(cache.of(words), k)).tolist())]
    return spark.createDataFrame(rows, "g long, template int, at int")


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, template, diagonal, n, low, high): votes of each diagonal; template -1 has the number of words as diagonal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                short, grams = [], []
                for text in batch.column("text").to_pylist():
                    words = alnum_words(text)
                    h = cache.of(words)
                    two, four = gram_hashes(h, PHRASE_GRAM), gram_hashes(h, NOTICE_GRAM)
                    own = np.full(1, OWN, dtype=np.uint64)
                    grams.append(signed(np.concatenate([own, two, four])))
                    short.append(len(words))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "words": pa.array(short, pa.int32()), "grams": list_array(grams, pa.int64())})

    rows = docs.mapInArrow(run, "doc_id long, h long, words int, grams array<long>")
    placed = rows.select("doc_id", "h", "words", F.posexplode("grams").alias("i", "g"))
    met = placed.join(F.broadcast(template_grams(docs.sparkSession)), "g")
    runs = F.greatest(F.col("words") - (PHRASE_GRAM - 1), F.lit(0))
    place = F.when(F.col("i") <= runs, F.col("i") - 1).otherwise(F.col("i") - 1 - runs)
    diagonal = F.when(F.col("template") < 0, F.col("words")).otherwise(place - F.col("at"))
    return met.select("doc_id", "h", "template", diagonal.alias("diagonal"), place.alias("place")).groupBy("doc_id", "h", "template", "diagonal").agg(
        F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")
    )


def spans(voted: DataFrame) -> DataFrame:
    """(doc_id, h, template, low, high): spans of words with enough votes; neighbouring diagonals of a notice are one span."""
    w = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= NEAR, 0).otherwise(1)
    phrase = F.col("template") < len(PHRASES)
    marked = voted.where("template >= 0").withColumn("new", F.when(phrase, 1).otherwise(apart)).withColumn("run", F.sum("new").over(w))
    merged = marked.groupBy("doc_id", "h", "template", "run").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    need = F.lit([float(len(w) - k + 1) * (1.0 if k == PHRASE_GRAM else VOTED) for w, _, k in TEMPLATES])
    size = F.lit([k for _, _, k in TEMPLATES])
    return merged.where(F.col("n") >= F.element_at(need, F.col("template") + 1)).select("doc_id", "h", "template", "low", (F.col("high") + F.element_at(size, F.col("template") + 1)).alias("high"))


def covered(template: list[bytes], words: list[bytes]) -> float:
    """Share of the template's words that the span holds in order."""
    blocks = SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


def verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Facts of each document with candidate spans, from its words."""
    lists = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    kept = only_marked(docs, lists.select("doc_id")).dropDuplicates(["doc_id", "h"])
    both = kept.join(lists, null_safe(kept, lists, ["doc_id", "h"])).select(kept["doc_id"], kept["h"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = {"n_base": [], "first_word": [], "last_word": [], "base": [], "all": [], "score": []}
                for text, places in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    words, starts, base, every, best = alnum_words(text), [], set(), set(), 0.0
                    for p in places:
                        template, label, k = TEMPLATES[p["template"]]
                        span = words[p["low"] : p["high"]]
                        if k == PHRASE_GRAM:
                            if span == template:
                                starts.append(p["low"])
                                base.add(label)
                                best = 1.0
                        elif (share := covered(template, span)) >= COVERED:
                            every.add(label)
                            best = max(best, share)
                    out["n_base"].append(len(starts))
                    out["first_word"].append(min(starts, default=None))
                    out["last_word"].append(max(starts, default=None))
                    out["base"].append(",".join(sorted(base)))
                    out["all"].append(",".join(sorted(base | every)))
                    out["score"].append(best)
                kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base": pa.string(), "all": pa.string(), "score": pa.float64()}
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "h": batch.column("h")} | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    return both.mapInArrow(run, "doc_id long, h long, n_base long, first_word long, last_word long, base string, all string, score double")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: words, places and extent of phrases, labels, score."""
    texts = text_columns(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    voted = cut_lineage(votes(texts), "votes")
    facts = cut_lineage(verified(texts, spans(voted)), "facts")
    own = voted.where("template < 0").select("doc_id", "h", F.col("diagonal").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    rows = own.join(facts, null_safe(own, facts, ["doc_id", "h"]), "left")
    return rows.select(
        own["doc_id"], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base", F.lit("")).alias("base_labels"), F.coalesce("all", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
