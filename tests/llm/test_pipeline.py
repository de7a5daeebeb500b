import hashlib

import brute
import corpus_pipeline as P
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tidemark.llm import byte_bpe

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_level_bpe"]
    steps = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    assert len(rows[1]) >= 0.99 * len(rows[0])
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows[1].items() for w in [brute_words(t)]}
    kept = near5(sets)
    assert set(rows[2]) == kept
    gone = {r[0]: r for r in brute.repeats(list(rows[2].items()))}
    assert sum(r[2] for r in gone.values()) > 0
    for d, t in rows[2].items():
        left = rows[3].get(d, "")
        assert 0 <= len(left.encode()) - (gone[d][1] - gone[d][2]) <= 6 * gone[d][3]
        assert (left == t) == (gone[d][2] == 0)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination(list(rows[3].items()), bench) if r[5]}
    assert set(rows[4]) == set(rows[3]) - bad
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANK_FILE))
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = steps[-1].collect()
    assert {r.doc_id for r in last} == set(rows[4])
    for r in last:
        assert list(r.ids) == real.encode_ordinary(rows[4][r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(rows[4][r.doc_id].encode()).hexdigest()
    for s in steps[1:-1]:
        assert s.columns == list(P.COLUMNS)
        assert s.filter(F.length("text") != F.col("n_chars")).count() == 0


def brute_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))


def near5(sets):
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {d for d in ids if root(d) == d}


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "of the and " * 30, "en", "a", 5), (None, "other words here", "en", "a", 5), (4, "of the and", "en", "a", 5), (4, "of the and", "en", "a", 5), (4, "in an on", "en", "b", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_k": F.lit(1), "block": F.lit(2), "spans": F.lit("x")})
    for _, stage in P.STAGES:
        got = stage(spark, d, SF).collect()
        assert len(got) <= len(rows)
        assert stage(spark, d.limit(0), SF).count() == 0


def test_unlike_rows_of_null_or_shared_ids_stay(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "changed"])
    unlike = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, "alpha"), (None, "beta"), (3, unlike[2]), (3, unlike[3]), (4, None), (4, "")]
    copies = [(5, " ".join(base)), (5, near), (7, " ".join(base)), (5, unlike[4]), (None, unlike[5]), (9, unlike[5])]
    for some in (rows, copies, rows + copies):
        d = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")
        got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, d, SF).collect()]
        group = [x for x in got if x[1] and x[1].startswith("w0 ")]
        assert len(group) == (some is not rows) and all(i == 5 for i, _ in group)
        want = [x for x in some if x not in copies or x in [(5, unlike[4]), (None, unlike[5])]]
        assert sorted(map(repr, (x for x in got if x not in group))) == sorted(map(repr, want))
