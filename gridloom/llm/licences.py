"""Licence scans in DataFrame functions only.

Templates are licence notices of any length.  Texts are read through overlapping
windows, of a width for each class of template lengths; MinHash bands of a
window's five-word shingles retrieve templates, and exact shingle containment
verifies them.  ``bands`` sets the number of bands so that a window around a true
match meets its template with a probability of at least 1 - ``MISS``.

Only windows with an anchor word are read.  Anchors are chosen so that under
``CONTAINED`` of any template's shingles are free of them: a text or window
without one cannot contain a template, so nothing is lost.
"""

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
SEPARATOR = r"[^\p{L}\p{N}]+"
# Widely used licence notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}
# Words too common to anchor a search.
COMMON = frozenset("a an and any are as at be by can for from in is it its may not of on or that the this to under use with without you your version 0 1 2 3 4 all either file later work copy above list source free following provided conditions terms".split())


def template_words(text):
    """Words as the scan sees them: lower-case runs of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


def anchors(templates):
    """Words one of which stands in more than 1 - CONTAINED of each template's shingles (a set, sorted)."""
    chosen = set()
    for text in templates.values():
        w = template_words(text)
        shingles = [set(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
        while sum(not s & chosen for s in shingles) >= CONTAINED * len(shingles):
            left = [s for s in shingles if not s & chosen]
            words = {x for s in left for x in s}
            chosen.add(min(words, key=lambda x: (x in COMMON, -sum(x in s for s in left), x)))
    return sorted(chosen)


def classes(templates):
    """Classes of template lengths in shingles: {class: (window width, stride, bands, templates)}.

    Lengths within a class differ by a quarter at most; a window covers its
    longest template at any offset.  ``bands`` follows from the smallest Jaccard
    similarity of a window around a match.
    """
    sizes = sorted((len(template_words(t)) - SHINGLE + 1, name) for name, t in templates.items())
    if sizes and sizes[0][0] < 1:
        raise ValueError(f"templates need {SHINGLE} words")
    out = {}
    while sizes:
        least = sizes[0][0]
        own = [x for x in sizes if x[0] <= max(least, least * 5 // 4)]
        sizes = sizes[len(own):]
        longest = own[-1][0]
        stride = max(1, longest // 4)
        width = longest + stride - 1
        jaccard = CONTAINED * least / (width + (1 - CONTAINED) * least)
        out[len(out)] = width, stride, bands(jaccard), [name for _, name in own]
    return out


def bands(jaccard):
    """Bands of one row that miss a pair of this similarity with probability MISS at most."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - jaccard))) if jaccard < 1 else 1


def _shingles(words):
    parts = lambda i: [F.get(words, i + k) for k in range(SHINGLE)]
    n = F.size(words)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*parts(i)))).otherwise(F.array().cast("array<bigint>"))


def _signature(shingles, n):
    """Smallest value of each of the hash functions."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, s))))


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """Licence notices in whole texts: doc_id, licence, containment, first_word, n_windows.

    One row for each document and template of which a window contains at least
    ``CONTAINED`` of the distinct shingles: the best containment, the first word
    of the first such window and the number of windows.  Null, empty and short
    texts hold none; rows that repeat an id are reported together; an empty table
    gives an empty result.  The templates (a fixed list) are broadcast.
    """
    templates = TEMPLATES if templates is None else templates
    spark, words, kinds = docs.sparkSession, anchors(templates), classes(templates)
    low = F.lower("text")
    has = F.lit(False)
    for a in words:
        has = has | low.contains(a)
    rows = docs.where(has).select("doc_id", F.array_remove(F.split(low, SEPARATOR), "").alias("w"))
    # no filter on derived arrays here: pushed down, it would split the text anew for every word
    rows = rows.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(x.isin(words), i).otherwise(-1)), lambda i: i >= 0))
    rows = rows.select("doc_id", "at", _shingles(F.col("w")).alias("h"))
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(w).alias("width"), F.lit(s).alias("stride"), F.lit(b).alias("bands")) for k, (w, s, b, _) in kinds.items()]))
    rows = rows.select("doc_id", "at", "h", kind.alias("c"))
    # windows whose words width + 4 include an anchor
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - F.col("c.width") - (SHINGLE - 2)) / F.col("c.stride"))).cast("int")
    last = lambda p: F.floor(p / F.col("c.stride")).cast("int")
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(first(p), last(p)))))
    windows = rows.select("doc_id", "c", "h", F.explode(starts).alias("k")).select(
        "doc_id", "c", (F.col("k") * F.col("c.stride")).alias("from"), F.slice("h", F.col("k") * F.col("c.stride") + 1, F.col("c.width")).alias("win"),
    )
    met = windows.select("doc_id", "c.id", "from", "win", F.posexplode(_signature(F.col("win"), F.col("c.bands"))).alias("band", "least"))
    known = spark.createDataFrame([(k, b, name, template_words(templates[name])) for k, (_, _, b, names) in kinds.items() for name in names], "id int, bands int, licence string, w array<string>")
    known = known.select("id", "bands", "licence", F.array_distinct(_shingles(F.col("w"))).alias("t"))
    index = known.select("id", "licence", "t", F.posexplode(_signature(F.col("t"), F.col("bands"))).alias("band", "least"))
    shared = F.size(F.array_intersect("t", "win")) / F.size("t")
    found = met.join(F.broadcast(index), ["id", "band", "least"]).withColumn("containment", shared).where(F.col("containment") >= CONTAINED)
    return found.groupBy("doc_id", "licence").agg(
        F.max("containment").alias("containment"), F.min("from").cast("long").alias("first_word"), F.countDistinct("from").alias("n_windows"),
    )


def scan_sql(templates=None):
    """SQL for ``scan`` over ``documents``: every window's containment, without anchors and bands."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join(
        f"('{name}', {width}, {stride}, '{' '.join(template_words(templates[name]))}')"
        for width, stride, _, names in classes(templates).values() for name in names
    )
    cut = "unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))"
    placed = "unnest(list_transform(range(1, len(w) - 3), lambda i: {'place': i - 1, 's': array_to_string(w[i:i + 4], ' ')}))"
    return (
        f"WITH known AS (SELECT * FROM (VALUES {rows}) v(licence, width, stride, t)), "
        f"pieces AS (SELECT licence, width, stride, {cut} AS s FROM (SELECT *, string_split(t, ' ') AS w FROM known)), "
        "sizes AS (SELECT licence, count(*) AS n FROM pieces GROUP BY licence), "
        "split AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), "
        f"placed AS (SELECT doc_id, x.place AS place, x.s AS s FROM (SELECT doc_id, {placed} AS x FROM split WHERE len(w) >= 5)), "
        "hit AS (SELECT doc_id, licence, stride, s, unnest(range(greatest(0, (place - width + stride) // stride), place // stride + 1)) AS k FROM placed JOIN pieces USING (s)), "
        "found AS (SELECT doc_id, licence, k * stride AS begin_at, count(DISTINCT s)::DOUBLE / any_value(n) AS containment FROM hit JOIN sizes USING (licence) GROUP BY doc_id, licence, k, stride) "
        "SELECT doc_id, licence, max(containment) AS containment, min(begin_at)::BIGINT AS first_word, count(*)::BIGINT AS n_windows "
        f"FROM found WHERE containment >= {CONTAINED} GROUP BY doc_id, licence"
    )
