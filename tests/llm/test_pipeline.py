"""The pipeline's stages against plain versions, on the smallest tables."""

from collections import Counter

import numpy as np

import corpus_pipeline
from arealis.llm import toxicity
from test_ops import plain_lines, shingles

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [r for r in rows if toxicity.score_texts(model, [r[1]])[0] < 0.5]
    bench = [(r.item_id, shingles(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "line_dedup":
            want = [(i, "\n".join(k)) for i, _, k in plain_lines(want)]
        elif name == "ngram_jaccard":
            kept = []
            sets = [(i, t, shingles(t)) for i, t in want]
            root = {i: i for i, *_ in sets}
            for a, (i, _, s) in enumerate(sets):
                for j, _, u in sets[:a]:
                    if s and u and 100 * len(s & u) >= 75 * len(s | u) and root[i] != root[j]:
                        low, high = sorted((root[i], root[j]))
                        root = {k: low if r == high else r for k, r in root.items()}
            kept = [(i, t) for i, t, _ in sets if root[i] == i]
            want = kept
        elif name == "decontamination":
            want = [(i, t) for i, t in want if not any(b and 4 * len(b & shingles(t)) >= 3 * len(b) for _, b in bench)]
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want}
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= np.ceil(sum(fill.values()) / 4096) + 1
