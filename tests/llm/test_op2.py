import random

import numpy as np
import pytest
from brute import repeats
from tidemark.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in df.select("_key", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def sort(rows):
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in rows)


def test_fingerprints_tell_runs_apart():
    data = np.frombuffer(b"abcabcabd" * 30, np.uint8)
    h = S.prints(data, 100)
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (data[i : i + 100].tobytes() == data[j : j + 100].tobytes())
    at = np.array([0, 5, 100, 170])
    assert (S.prints_at(data, at, 100) == h[at]).all()


def test_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = repeats(docs)
    got = S.op2_suffix_dedup(spark, SF).withColumnRenamed("doc_id", "_key")
    assert rows_of(got) == sort(want)
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("wide", [False, True])
def test_cases(spark, monkeypatch, wide):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    p, q = word(150), word(99)
    docs = [(5, p), (9, "x" + p + "y"), (3, word(40) + p[:120] + word(30)), (4, q), (6, q), (None, p[20:]), (7, "z" * 700), (8, None), (10, "")]
    docs += [(11, p), (12, p[:100] + q + p[50:]), (12, "other " + p[:110]), (13, q + "!" + q), (14, word(3000)), (15, word(500) + p)]
    if wide:
        monkeypatch.setattr(S, "wider", lambda total: 3)
    monkeypatch.setattr(S, "BLOCK", 600)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n_bytes")
    # Rows with the same id are taken by the digest of their text.
    import hashlib

    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    assert rows_of(S.repeats(df.repartition(3))) == sort(repeats_in_order(order))
    twice = spark.createDataFrame([(1, p), (1, p), (2, "s"), (2, "s")], "doc_id long, text string")
    assert [(r._key, r.n_removed) for r in S.repeats(twice).orderBy("_key", "n_removed").collect()] == [(1, 0), (1, len(p.encode())), (2, 0), (2, 0)]
    assert S.repeats(df.limit(0)).count() == 0


def repeats_in_order(rows):
    return [(k, *r[1:]) for (k, _), r in zip(rows, repeats([(i, t) for i, (_, t) in enumerate(rows)]), strict=True)]
