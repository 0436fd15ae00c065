"""Licence notices found through their rarest words."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import documents
from arealis.llm.native_text import lower_ascii

# The phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices: words, label, and the key phrases that must stand at their places.
TEMPLATES = [
    ("released under the mit license", "mit", ["mit license"]),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ["permission is hereby granted", "any person obtaining a copy"]),
    ("licensed under the apache license version 2 0", "apache-2.0", ["apache license version 2 0"]),
    ("licensed under the gnu general public license version 2", "gpl-2.0", ["gnu general public license version 2"]),
    ("licensed under the gnu general public license version 3", "gpl-3.0", ["gnu general public license version 3"]),
    ("gnu lesser general public license", "lgpl", ["lesser general public license"]),
    ("gnu affero general public license", "agpl", ["affero general public license"]),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ["redistribution and use in source and binary forms"]),
    ("mozilla public license version 2 0", "mpl-2.0", ["mozilla public license"]),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ["cc by nc 4 0"]),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ["cc by sa 4 0"]),
    ("licensed under cc by 4 0", "cc-by-4.0", ["cc by 4 0"]),
    ("creative commons attribution license", "cc-by", ["creative commons attribution"]),
    ("permission to use copy modify and distribute this software for any purpose", "isc", ["permission to use copy modify"]),
]
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(_WORD), F.lit(0))


def _all_templates() -> list[tuple[list[str], str, list[str], bool]]:
    return [(p.split(), label, [p], True) for p, label in BASE.items()] + [(t.split(), label, keys, False) for t, label, keys in TEMPLATES]


def licence_idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all rows; as many values as words in the templates."""
    vocabulary = sorted({w for t, *_ in _all_templates() for w in t})
    found = docs.select(F.explode_outer(F.array_append(F.array_intersect(words(F.col("text").cast("string")), F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = counts.get("", 0)  # every row has this one
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _key_places(template: list[str], phrase: str) -> list[int]:
    p = phrase.split()
    start = next(i for i in range(len(template)) if template[i : i + len(p)] == p)
    return list(range(start, start + len(p)))


def scan_licences(docs: DataFrame, rare: int = 2) -> DataFrame:
    """One row for each row of ``docs``: words, places of base phrases, labels and a score.

    Each template is posted under its rarest word by document frequency. A file's words
    that are such postings give places where the template would begin; its other rare
    words (``rare`` in all) must stand at the same relative positions, and then every
    word of the mandatory key phrases. The score is the IDF share of the best found
    template's words that stand at their places.

    All of it is row by row in column expressions: no shuffle, and so no hot key; only
    the word counts of the templates are gathered. Nulls and edges: a null or empty text
    has no words and no labels; ids may be null or repeat; an empty table gives an empty
    result; other columns are ignored.
    """
    idf = licence_idf(docs)
    templates = _all_templates()
    posted, checks = [], []
    for tokens, _, keys, _ in templates:
        order = sorted(range(len(tokens)), key=lambda i: (-idf[tokens[i]], tokens[i], i))
        posted.append((tokens[order[0]], order[0]))
        checks.append(sorted({*order[:rare], *(i for k in keys for i in _key_places(tokens, k))}))
    anchors = sorted({w for w, _ in posted})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    hits = F.when(F.arrays_overlap("w", F.array(*map(F.lit, anchors))), F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h.w.isin(anchors)))
    rows = rows.select("doc_id", "w", hits.alias("hits")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.col("hits").isNotNull(), F.col("w")).alias("w"), "hits")

    def places(t: int) -> Column:
        tokens, (anchor, o) = templates[t][0], posted[t]
        fits = lambda h: reduce(Column.__and__, (F.get("w", h.i + (k - o)) == tokens[k] for k in checks[t] if k != o), h.w == anchor)
        return F.transform(F.filter("hits", fits), lambda h: (h.i - o).cast("long"))

    def share(t: int) -> Column:
        tokens, total = templates[t][0], sum(idf[x] for x in templates[t][0]) or 1.0
        one = lambda s: reduce(Column.__add__, (F.when(F.get("w", (s + k).cast("int")) == x, idf[x] / total).otherwise(0.0) for k, x in enumerate(tokens)))
        return F.array_max(F.transform(f"p{t}", one))

    n = range(len(templates))
    rows = rows.select("doc_id", "n_words", "w", *(places(t).alias(f"p{t}") for t in n))
    base = [t for t in n if templates[t][3]]
    starts = F.array_sort(F.flatten(F.array(*(F.coalesce(f"p{t}", F.array().cast("array<bigint>")) for t in base))))
    labelled = lambda which: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"p{t}") > 0, templates[t][1]) for t in which))))), ",")
    score = F.coalesce(F.greatest(*(share(t) for t in n)), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.get(starts, F.lit(0)).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labelled(base).alias("base_labels"),
        labelled(n).alias("labels"),
        F.least(score, F.lit(1.0)).alias("score"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))
