import zlib

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import language_id as L
from tidemark.llm import quality_knn as Q
from tidemark.llm import toxicity as T
from tidemark.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def held(rows, m, r):
    return [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % m == r]


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.op1_language_id(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == want.keys()
    assert np.mean([got[i].pred_lang == want[i] for i in want]) > 0.99
    assert np.mean([r.kept for r in got.values()]) > 0.99


def test_pages_equal_brute_force(spark):
    import re

    import __spark_entry__ as entry

    got = {r.page_id: r for r in entry.queries()["op1_language_id_pages"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    langs, table = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    n, rows = len(langs), []
    for r in pages:
        text = re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", r.html))
        host = (re.match(r"(?s).*?://([^/?#]*)", r.url) or ["", ""])[1].lower()
        end = re.search(r"\.([a-z]+)$", host)
        said = re.search(r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", r.html)
        rows.append((r.page_id, L.text_evidence(table, [text])[0], L.has_letter(text), host or None, end and end[1], said and said[1].lower()))
    assert all(h and s and d for *_, h, s, d in rows)
    soft = [np.exp(e) / np.exp(e).sum() if (e != 0).any() else np.zeros(n) for _, e, *_ in rows]
    total = lambda at: sum((p for p, r in zip(soft, rows, strict=True) if at(r)), np.zeros(n))
    smooth = lambda own, parent: (own + L.STRENGTH * parent) / (own.sum() + L.STRENGTH)
    base = (total(lambda r: True) + 1) / (total(lambda r: True) + 1).sum()
    trust = np.array([total(lambda r, d=d: r[5] == d) for d in langs]) + 0.5 + np.eye(n)
    trust = np.log(trust / trust.sum(0))
    assert len(got) == len(rows)
    for k, e, letters, host, end, said in rows:
        prior = smooth(total(lambda r: r[3:5] == (host, end)), smooth(total(lambda r: r[4] == end), base))
        p = e + np.log(prior) + (trust[langs.index(said)] if said in langs else 0)
        p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
        kept = bool(letters and p.max() >= L.LEAST)
        assert got[k].kept == kept and got[k].pred_lang == (langs[p.argmax()] if kept else "und")
        assert abs(got[k].confidence - (p.max() if letters else 0)) < 1e-6


def test_language_cases(spark):
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None, "h", "de"), (2, "", None, None), (3, "123 ?!", "h", None), (4, "Ouverture", "h", "fr"), (4, "Ouverture", "h", "fr"), (5, "an", None, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, said string").withColumns({c: F.lit(0) for c in ("s", "h", "_host", "_prior", "_lang", "_said", "_row", "_text", "p0", "a b")}).withColumn("lang", F.lit("xx"))
    got = L.identify(df, model, host=F.col("host"), suffix=F.lit("com"), declared=F.col("said")).collect()
    assert got[0]["_prior"] == 0 and got[0]["a b"] == 0 and got[0]["lang"] == "xx" and len([c for c in got[0].__fields__ if c == "_lang"]) == 1
    assert len(got) == 6 and {r.doc_id for r in got if not r._kept} >= {1, 2, 3}
    assert all(r._lang == "und" for r in got if not r._kept)
    assert L.identify(df.limit(0), model).count() == 0
    none = L.identify(df, L.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r._lang for r in none} == {"und"}


def test_few_labels_are_learnt_and_long_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    rows = [("abc " * 5, f"l{i % 5 if i < 50 else i % 2}") for i in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string")
    langs, table = L.fit(df)
    assert langs == ["l0", "l1"] and table.shape[1] == 2
    one, long = L.text_evidence(np.log(np.random.default_rng(1).random((L.BINS, 2))), ["abcd " * 10, "abcd " * 500_000])
    assert one.argmax() == long.argmax() and long.min() == -L.CEILING


def test_declarations_are_sought_in_the_whole_text(spark):
    said = {"de": "abab cdcd " * 20, "en": "efef ghgh " * 20}
    known = [(t, x, -1) for x, t in said.items()] + [(f"<html lang='{x}'> {t}", None, -1) for x, t in said.items()] * 20
    late = [("<!-- " + "- " * 3000 + f"--><html lang='{x}'> z", None, k) for k, x in enumerate(said)]
    rows = spark.createDataFrame(known + late, "text string, lang string, k int").withColumn("source", F.lit(None).cast("string"))
    got = {r.k: r._lang for r in L.of_documents(rows).filter("k >= 0").collect()}
    assert got == {0: "de", 1: "en"}


def test_hosts_and_declarations_decide_what_texts_do_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    model = L.fit(docs)
    known = docs.filter("lang = 'de'").limit(60).select("text", F.lit("a.example").alias("host"), F.lit("de").alias("said"))
    doubt = spark.createDataFrame([("en", "a.example", None), ("en", None, "de"), ("en", None, None)], "text string, host string, said string")
    got = L.identify(known.unionByName(doubt), model, host=F.col("host"), declared=F.col("said"))
    p = [(r.host, r.said, r._lang) for r in got.filter("text = 'en'").collect()]
    assert ("a.example", None, "de") in p


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = T.op5_toxicity_channel(spark, sf).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [r for r in held(rows, 5, 0) if r.doc_id in labels]
    assert all(r.held_out for r in test) and len(test) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.98


def best_of_all(token, lm):
    """Every path through the lattice."""
    paths = [(0.0, "", 0, 0)]
    for options in T.lattice(token):
        paths = [(p + cost, said + x, a, b) for p, said, a, b in paths for x, cost in options]
    def likely(path):
        p, said = path[0], path[1]
        a = b = 0
        for c in (*map(T.symbol, said), 0):
            p, a, b = p + lm(a, b, c), b, c
        return p
    return max(map(likely, paths)), {said for path in paths for said in [path[1]] if likely(path) >= max(map(likely, paths)) - 1e-9}


def test_toxicity_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    docs, labels = read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic")
    model = T.train(docs, labels, crc_mod("doc_id", 5) != 0)
    for token in ("1d10t", "i.d.i.o.t", "stuuupid", "$tup1d", "a-b.c", "l00k", "tr@$h!"):
        assert T.decode(token, model.lm) in best_of_all(token, model.lm)[1]
    seen = {}
    w0, w1, w2 = model.fit
    for r in T.op5_toxicity_channel(spark, sf).collect():
        seen[r.doc_id] = r.score
    for r in docs.collect():
        reader, low = T.Reader(model.lm), (r.text or "").lower()
        got = []
        for t in low.split():
            own = [model.weights.get(f, 0.0) for w in reader.words(t) for f in T.stems(w)]
            own += [model.weights.get(x + "$", 0.0) for run in reader.runs(t, model.reach) for a in range(len(run)) for b in range(a + 3, len(run) + 1) for x in [run[a:b]]]
            got.append(max(own, default=0.0))
        for run in reader.spaced(low, model.reach):
            got.append(max((model.weights.get(run[a:b] + "$", 0.0) for a in range(len(run)) for b in range(a + 3, len(run) + 1)), default=0.0))
        x = w0 + w1 * max(got, default=0.0) + w2 * np.log1p(sum(v for v in got if v > 0))
        assert abs(seen[r.doc_id] - 1 / (1 + np.exp(-np.clip(x, -60, 60)))) < 1e-9


def test_channel_is_undone(spark):
    lm = T.train_language_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))
    for told, meant in (("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("l0s3r", "loser")):
        assert T.decode(told, lm) == meant
    scorer = T.Scorer(lm, {"idiot$": 9.0, "stup": 8.0}, (-5.0, 1.0, 0.1))
    for bad in ("you i d i o t", "you i  d\ti\no t", "word " * 50_000 + "1d10t", "an IDIOT!", "so $tup1d,", "i-d-i-o-t"):
        assert scorer.score(bad) > 0.5, bad
    for fine in ("", None, "the idea", "call 555-1234 now", "mail a.b@c.de"):
        assert scorer.score(fine) < 0.5, fine


def test_long_tokens_words_and_doubled_letters(spark):
    lm = T.train_language_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))
    scorer = T.Scorer(lm, {"idiot$": 9.0, "stupid$": 9.0, "moron$": 9.0, "incomprehensible$": 9.0}, (-5.0, 1.0, 0.1))
    chain = ".".join("thewordsbeforeitstupidandmanywordsafterit")
    joined = "/".join(["some", "other", "parts", "of", "a", "long", "address", "1d10t", "and", "more"])
    for bad in (chain, joined, joined.replace("/", "_"), "stu" + 40 * "u" + "pid", " ".join("incomprehensible"), "iidioot", "you mmoron"):
        assert scorer.score(bad) > 0.5, bad
    assert scorer.score(".".join(200 * "qx" + "moron" + 200 * "qx")) > 0.5
    for fine in ("https://a-b.example.com/some/longer/path/to-a-page.html?x=1", "letter book", " ".join("harmlessletters")):
        assert scorer.score(fine) < 0.5, fine


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")], "doc_id long, text string").withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = T.score(docs, labels, crc_mod("doc_id", 5) != 0).collect()
    assert len(got) == 5 and all(r.score < 0.5 for r in got)
    assert T.score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op8_quality_knn(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [r for r in held(rows, 3, 1) if r.doc_id in labels]
    assert all(r.held_out for r in test) and len(test) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.93


def test_quality_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    docs, labels = read("documents").select("doc_id", "text"), read("labels").select("doc_id", "quality")
    sample, share = Q.labelled_sample(docs, labels, crc_mod("doc_id", 3) != 1, "quality", Q.SAMPLE)
    y = np.array([r["y"] for r in sample])
    m = Q.Model([r["text"] for r in sample], y, share)
    got = {r.doc_id: r.score for r in Q.op8_quality_knn(spark, sf).collect()}
    unit = lambda v: v / np.sqrt((v * v).sum())
    known = [unit(Q.terms(r["text"]) * m.idf @ m.axes) for r in sample]
    for r in docs.collect():
        mine = unit(Q.terms(r.text) * m.idf @ m.axes)
        near = sorted((-float(mine @ v), k) for k, v in enumerate(known))[: Q.NEAREST]
        w = [np.exp(Q.SHARP * -c) * m.weight[k] for c, k in near]
        assert abs(got[r.doc_id] - sum(a * y[k] for a, (_, k) in zip(w, near, strict=True)) / sum(w)) < 2e-3


def test_ties_go_to_the_first():
    cos = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert Q.nearest(cos, 3).tolist() == [[0, 1, 2], [0, 1, 2]] and Q.nearest(cos, 5).tolist() == [[0, 1, 2, 3, 4]] * 2


def test_one_text_an_id_is_learnt_and_none_of_excessive_length(spark, monkeypatch):
    monkeypatch.setattr(Q, "LONGEST_LEARNT", 10)
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 11), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    assert [(r["doc_id"], r["text"]) for r in Q.labelled_sample(docs, labels, F.lit(True), "quality", 5)[0]] == [(1, "a"), (3, "")]


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0)], "doc_id long, quality int")
    got = Q.score(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert Q.score(docs.limit(0), labels, F.lit(True)).count() == 0
