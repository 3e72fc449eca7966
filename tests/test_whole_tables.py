"""Queries that must run over the whole table, against brute force."""

import numpy as np

from lumenfold.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_corr_matrix_all_holds_every_pair_of_every_label(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = {}
    for label, part in rows.groupby("label"):
        part = part.sort_values("vec_id")
        corr, ids = np.corrcoef(np.stack(part.embedding).astype(float)), part.vec_id.tolist()
        want |= {(label, a, b): corr[i, i + 1 + j] for i, a in enumerate(ids) for j, b in enumerate(ids[i + 1 :])}
    got = {(x["label"], x["a"], x["b"]): x["corr"] for x in plans.QUERIES["corr_matrix_all"](spark, SF).collect()}
    assert got.keys() == want.keys() and len({k[0] for k in got}) > 3
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6
