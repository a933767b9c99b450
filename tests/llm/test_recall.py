"""Recall of the neighbour search where the table is larger than the sample its router knows."""

import numpy as np
from pyspark.sql import functions as F

from rostrum.llm.neighbours import search
from rostrum.llm.registry import table


def test_recall_beyond_the_sample(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert len(ids) > 3 * 512
    got = {}
    for r in search(vectors, F.col("vec_id") % 20 == 0, k=10, sample=512).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        assert len(got[q]) == 10
        hits, total = hits + len(want & got[q]), total + 10
    print(f"recall {hits}/{total}")
    assert hits / total >= 0.9
