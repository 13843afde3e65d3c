"""License scans by a positional rare-token index. Built-in functions only.

1. The words of the licence templates are counted in the corpus; each template
   enters its `rare` words of the highest inverse frequency into the index, with
   their positions in it. Words that the corpus lacks have no postings and are not entered. So the index is as small as the templates.
2. Files look their words up in the index; the positions of a word in file and
   template give a relative position, and postings that agree on it are
   intersected. No word is left out for a file: the templates bound the index.
3. A template is reported if, at one relative position, enough of its rare words
   agree and every mandatory key phrase stands where the template has it. The
   phrases are read in the file's own row: only postings at whole phrases are shuffled.

Base phrases are found by the same lookup, with their first word as the posting.

Defined results: null text is empty; files without a licence word have no label
and score 0; repeated rows are scanned alike; an empty table gives no rows; only
id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asciiwords import ascii_lower, phrase, raw_words, word_count
from .rows import keyed

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: label: (template, mandatory key phrases). The licences' own notices, lower-cased words only.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "associated documentation files"),
    ),
    "apache": ("licensed under the apache license version 2 0", ("under the apache license",)),
    "gpl": (
        "this work is licensed under the gnu general public license version 3 or any later version as published by the free software foundation",
        ("gnu general public license",),
    ),
    "lgpl": ("this library is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by": ("licensed under creative commons attribution 4 0 international", ("creative commons attribution",)),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "mpl": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "proprietary": ("all rights reserved no part may be reproduced without written permission", ("all rights reserved",)),
}
RARE = 6


def _templates(spark: SparkSession) -> DataFrame:
    """(label, place, word) of all template words."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.split(F.lit(t), " ").alias("words")) for k, (t, _) in TEMPLATES.items()])
    each = spark.range(1).select(F.explode(rows).alias("t"))
    return each.select("t.label", F.posexplode("t.words").alias("place", "word"))


def _phrases(spark: SparkSession) -> DataFrame:
    """(label, must, key_place, key_size): mandatory phrases, and where their templates have them."""
    rows = [
        F.struct(F.lit(label).alias("label"), F.lit(key).alias("must"), F.lit(len(text[: text.index(key)].split())).alias("key_place"), F.lit(len(key.split())).alias("key_size"))
        for label, (text, keys) in TEMPLATES.items() for key in keys
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def _words(docs: DataFrame) -> DataFrame:
    words = docs.select("key", "tag", raw_words(F.col("text")).alias("words"))
    return words.select("key", "tag", "words", F.posexplode("words").alias("pos", "raw")).withColumn("word", ascii_lower(F.col("raw"))).drop("raw")


def rare_index(keyed_docs: DataFrame, rare: int = RARE) -> DataFrame:
    """(word, label, idf, place, keys): the rare words of each template; at most templates times `rare` words."""
    spark = keyed_docs.sparkSession
    templates = _templates(spark)
    found = _words(keyed_docs).select("word").join(F.broadcast(templates.select("word").distinct()), "word").groupBy("word").count()
    counted = templates.select("label", "word").distinct().join(found, "word")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("count", "word"))
    chosen = counted.withColumn("rank", rank).filter(F.col("rank") <= rare).withColumn("idf", 1 / F.log(F.lit(2.718281828) + F.col("count")))
    keys = _phrases(spark).groupBy("label").agg(F.collect_list(F.struct("must", "key_place", "key_size")).alias("keys"))
    return templates.join(chosen.select("label", "word", "idf"), ["label", "word"]).join(keys, "label")


def scan(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    spark = docs.sparkSession
    rows = keyed(docs)
    index = cut_lineage(rare_index(rows, rare))
    weight = index.select("label", "word", "idf").distinct().groupBy("label").agg(F.sum("idf").alias("whole"), F.count("*").alias("entered"))
    look = index.join(weight, "label").select("word", "label", "idf", "place", "whole", "entered", "keys", F.lit(False).alias("base"))
    base = [
        F.struct(F.lit(text.split()[0]).alias("word"), F.lit(label).alias("label"), F.lit(text).alias("must"), F.lit(len(text.split())).alias("key_size"))
        for label, text in BASE.items()
    ]
    base = spark.range(1).select(F.explode(F.array(*base)).alias("b")).select(
        "b.word", "b.label", F.lit(0.0).alias("idf"), F.lit(0).alias("place"), F.lit(0.0).alias("whole"), F.lit(0).cast("long").alias("entered"),
        F.array(F.struct("b.must", F.lit(0).alias("key_place"), "b.key_size")).alias("keys"), F.lit(True).alias("base"),
    )
    # A place that lacks a mandatory phrase cannot be reported, so its postings end in their task. One word tells most of them.
    look = look.unionByName(base).withColumn("head", F.substring_index(F.col("keys")[0]["must"], " ", 1))
    shift = F.col("pos") - F.col("place")
    stands = ascii_lower(F.get("words", shift + F.col("keys")[0]["key_place"])) == F.col("head")
    for i in range(max(len(keys) for _, keys in TEMPLATES.values())):
        k = F.get("keys", F.lit(i))
        stands &= k.isNull() | (phrase(F.col("words"), shift + k["key_place"], k["key_size"]) == k["must"])
    found = (
        _words(rows).join(F.broadcast(look), "word").filter(stands)
        .select("key", "tag", "pos", "word", "label", "idf", "whole", "entered", "base", shift.alias("shift"))
    )
    found = cut_lineage(found.distinct())
    places = found.filter("base").select("key", "tag", "pos", "label").groupBy("key", "tag").agg(
        F.count("*").alias("n_base"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"),
        F.collect_set("label").alias("base_set"),
    )
    # at most `rare` words for each place
    agreed = (
        found.filter("not base")
        .groupBy("key", "tag", "label", "shift", "whole", "entered")
        .agg(F.collect_set(F.struct("word", "idf")).alias("words"))
        .filter("size(words) >= least(entered, 2)")
        .withColumn("idf", F.aggregate(F.array_sort("words"), F.lit(0.0), lambda total, x: total + x["idf"]))
        .groupBy("key", "tag")
        .agg(F.collect_set("label").alias("set"), F.max(F.least(F.col("idf") / F.col("whole"), F.lit(1.0))).alias("match"))
    )
    empty = F.array().cast("array<string>")
    base_set, own_set = F.coalesce("base_set", empty), F.coalesce("set", empty)
    counted = keyed(docs, "doc_id").select("key", "tag", "row.doc_id", word_count(raw_words(F.col("text"))).alias("n_words"))
    return (
        counted.join(places, ["key", "tag"], "left").join(agreed, ["key", "tag"], "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            F.array_join(F.sort_array(base_set), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.array_union(base_set, own_set)), ",").alias("labels"),
            F.coalesce("match", F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        )
    )
