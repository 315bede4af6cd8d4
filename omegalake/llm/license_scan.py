"""Licence scan by a positional rare-token index, in DataFrame functions only.

Licence texts are held as templates of words. The index holds, for each word that occurs in a
template, the templates and places where it stands. Of a file only the words of that
vocabulary are looked at. Of each template the words that fewest files have (highest inverse
document frequency, counted over the whole corpus) choose files and relative positions: so many that no place with
enough of the template's words can be without one of them. There all its indexed words are compared: a template
lies in the file where enough of them stand at the same distance from their places in the template. A
hit counts once the template's mandatory phrase is found in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Label and phrase of the base scan.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Label, mandatory key phrase and words of short licence notices, as their licensors word them.
TEMPLATES = (
    ("afl-3.0", "academic free license", "licensed under the academic free license version 3 0"),
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apsl-2.0", "apple public source license", "subject to the apple public source license version 2 0"),
    ("artistic-2.0", "artistic license", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("blueoak-1.0.0", "blue oak model license", "licensed under the blue oak model license 1 0 0"),
    ("bsd", "redistributions of source code", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", "person or organization obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("busl-1.1", "business source license", "use of this software is governed by the business source license"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "cc by nc nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-nd", "attribution noderivatives", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "public domain", "this work has been dedicated to the public domain under the creative commons zero licence"),
    ("cc0", "related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cddl-1.0", "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "common public license", "this program and the accompanying materials are made available under the terms of the common public license v1 0"),
    ("ecl-2.0", "educational community license", "licensed under the educational community license version 2 0"),
    ("elastic-2.0", "elastic license", "licensed under the elastic license 2 0"),
    ("epl-2.0", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("eupl-1.2", "european union public licence", "licensed under the european union public licence"),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lppl", "latex project public license", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-1.1", "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ms-pl", "microsoft public license", "licensed under the microsoft public license"),
    ("mulanpsl-2.0", "mulan psl", "is licensed under mulan psl v2"),
    ("ncsa", "ncsa open source license", "university of illinois ncsa open source license"),
    ("odbl", "open database license", "this database is made available under the open database license"),
    ("ofl-1.1", "open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("osl-3.0", "open software license", "licensed under the open software license version 3 0"),
    ("php-3.01", "php license", "this source file is subject to version 3 01 of the php license"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("psf-2.0", "python software foundation license", "licensed under the python software foundation license version 2"),
    ("qpl-1.0", "q public license", "may be distributed under the terms of the q public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("sspl-1.0", "server side public license", "under the terms of the server side public license version 1"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("upl-1.0", "universal permissive license", "licensed under the universal permissive license v 1 0"),
    ("w3c", "w3c software", "distributed under the w3c software notice and license"),
    ("wtfpl", "you want to public license", "do what the fuck you want to public license"),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("zlib", "held liable for any damages arising", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zpl-2.1", "zope public license", "this software is subject to the provisions of the zope public license version 2 1"),
)

#: What stands between words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Template words that running text has too; they are never looked up.
COMMON = ("0", "1", "2", "3", "4", "a", "above", "all", "an", "and", "any", "are", "as", "at", "be", "been", "by", "code", "copy", "do", "files", "for", "form", "forms", "from", "has", "in", "is", "it", "its", "law", "made", "may", "met", "must", "name", "names", "no", "not", "of", "open", "or", "other", "person", "source", "that", "the", "this", "to", "use", "used", "v", "want", "what", "will", "with", "work", "you")
#: The words of the templates that are looked up.
VOCABULARY = sorted({w for _, _, words in TEMPLATES for w in words.split()} - set(COMMON))
#: Share of a template's indexed words that must stand at one relative position.
MIN_SHARE = 0.6


def words_text(text: Column) -> Column:
    """The words of a text in lower case, each between two spaces of its own ('' if none).

    ``lower`` also lowers letters beyond ASCII; no such letter becomes one of a phrase.
    """
    spaced = F.btrim(F.regexp_replace(F.lower(text), _SEPARATORS, "  "))
    return F.when(spaced == "", "").otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def _n_words(spaced: Column) -> Column:
    """Words of a text or part of it in which every word has two spaces of its own."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _wide(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def _places(spaced: Column, phrase: str) -> Column:
    wide = _wide(phrase)
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(wide), F.lit("")))) / len(wide)).cast("long")


def base_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's word count, places of the base phrases, first and last of them, and labels.

    A place is a word number from 0. Null text is empty: no words, no places, no labels.
    ``phrases`` lists the mandatory phrases of templates that stand in the text, ``postings`` the
    places of its words that belong to the vocabulary of the templates. ``row`` tells rows apart.
    """
    s, firsts, lasts, counts, labels = F.col("s"), [], [], [], []
    for label, phrase in BASE:
        wide, n = _wide(phrase), len(phrase.split())
        has = s.contains(wide)
        counts.append(F.when(has, _places(s, phrase)).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(has, _n_words(F.substring_index(s, wide, 1))))
        lasts.append(F.when(has, _n_words(s) - _n_words(F.substring_index(s, wide, -1)) - n))
        labels.append(F.when(has, F.lit(label)))
    mandatory = sorted({phrase for _, phrase, _ in TEMPLATES})
    spaced = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), words_text(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    places = F.transform(F.split(F.btrim("s"), "  "), lambda w, at: F.struct(at.alias("at"), w.alias("word")))
    return spaced.select(
        "row", "doc_id", F.filter(places, lambda p: p["word"].isin(VOCABULARY)).alias("postings"), _n_words(s).alias("n_words"), (counts[0] + counts[1] + counts[2]).alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.array_compact(F.array(*(F.when(s.contains(_wide(p)), F.lit(p)) for p in mandatory))).alias("phrases"),
    )


def template_index(spark) -> DataFrame:
    """(template, label, phrase, word, place, of): the indexed words of all templates; ``of`` counts those of a template."""
    rows = []
    for number, (label, phrase, words) in enumerate(TEMPLATES):
        own = [(w, k) for k, w in enumerate(words.split()) if w not in COMMON]
        rows += [(number, label, phrase, w, k, len(own)) for w, k in own]
    return spark.createDataFrame(rows, "template int, label string, phrase string, word string, place int, of int")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the base scan and the labels of the index.

    n_words, n_base, first_word, last_word, base_labels as in ``base_scan``; labels: base labels
    and those of templates found; score: the best share of a template's indexed words found at one
    relative position (1 for a base phrase, else 0 if no template is found). Rows with the same key are scanned
    each by itself. Empty table: no rows.
    """
    index = template_index(docs.sparkSession)
    # Texts are read once. Few words of running text belong to the vocabulary, so this is a small part of the corpus.
    based = staged(base_scan(docs, key, text), "licence-postings")
    postings = based.select("row", F.explode("postings").alias("p")).select("row", "p.at", "p.word")
    frequency = postings.select("row", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("template").orderBy("df", "word", "place")
    # Of n words of which m must be found, one of any n - m + 1 is among those found.
    spare = F.floor(F.col("of") - F.col("of") * MIN_SHARE + 1e-9)
    seeds = index.join(F.broadcast(frequency), "word", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rarity", F.row_number().over(by_rarity))
    seeds = seeds.where(F.col("rarity") <= spare + 1).select("word", "template", "place")
    # Vocabulary and index are as large as the templates above, whatever the corpus.
    offset = (F.col("at") - F.col("place")).alias("offset")
    chosen = postings.join(F.broadcast(seeds), "word").select("row", "template", offset).distinct()
    shifted = postings.join(F.broadcast(index), "word").select("row", "template", "label", "phrase", "of", offset)
    # Rows of one document are spread by their offsets, however many words of the vocabulary it has.
    compared = shifted.join(chosen, ["row", "template", "offset"], "left_semi")
    hits = compared.groupBy("row", "template", "label", "phrase", "of", "offset").agg((F.count("*") / F.col("of")).alias("share"))
    # The best share of each label and phrase: as many for a document as there are templates.
    best = hits.where(F.col("share") >= MIN_SHARE).groupBy("row", "label", "phrase").agg(F.max("share").alias("share"))
    found = best.groupBy("row").agg(F.collect_list(F.struct("label", "phrase", "share")).alias("hits"))
    joined = based.drop("postings").join(found, "row", "left")
    kept = joined.withColumn("verified", F.filter(F.coalesce("hits", F.array().cast("array<struct<label:string,phrase:string,share:double>>")), lambda h: F.array_contains(F.col("phrases"), h["phrase"])))
    labels = F.array_union("base", F.transform("verified", lambda h: h["label"]))
    return kept.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("verified", lambda h: h["share"])), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    places, index = [], []
    for label, phrase in BASE:
        w = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(w))
        places.append(f"SELECT r, i - 1 AS place, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) - {len(w) - 2})) AS i FROM d) WHERE {test}")
    for number, (label, phrase, words) in enumerate(TEMPLATES):
        own = [(w, k) for k, w in enumerate(words.split()) if w not in COMMON]
        index += [f"({number}, '{label}', '{phrase}', '{w}', {k}, {len(own)})" for w, k in own]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ix(template, label, phrase, word, place, total) AS (VALUES {", ".join(index)}),
places AS ({" UNION ALL ".join(places)}),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY r),
postings AS (
  SELECT * FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS spot FROM d) WHERE word IN (SELECT word FROM ix)),
hits AS (
  SELECT r, template, label, phrase, count(*) * 1.0 / total AS share FROM postings JOIN ix USING (word)
  GROUP BY r, template, label, phrase, total, spot - place HAVING count(*) * 1.0 / total >= {MIN_SHARE}),
verified AS (
  SELECT h.* FROM hits h JOIN d USING (r) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')),
method AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels FROM verified GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN method m USING (r)
"""


ORACLE_SQL = _oracle()
