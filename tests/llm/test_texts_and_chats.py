import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tidemark.llm import byte_bpe, chat_format, registry, url_filter

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(byte_bpe.RANK_FILE)


@pytest.fixture(scope="module")
def real():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def codec():
    return byte_bpe.Codec(byte_bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(real, monkeypatch):
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABC     ÄäéñßÈ0123456789.,!?\n\t\x1c\x85\xa0  日本😀²'"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["", " ", "<|endoftext|>", "a" * 3000, "abc" * 30_000, "é" * 500, "don't we'll I'd", "x" * 200 + " " * 200]
    for states, short in ((10, 256), (10, 2), (200_000, 256)):  # a full table changes nothing
        monkeypatch.setattr(byte_bpe, "MAX_STATES", states)
        monkeypatch.setattr(byte_bpe, "SHORT", short)
        c = codec()
        for t in texts:
            ids = c.encode(t)
            assert ids == real.encode_ordinary(t), t
            assert c.decode(ids) == t and c.decode_bytes(ids) == t.encode()


def test_streamed_utf8():
    for data in (b"\xc3", b"\xe2\x82", b"a\xff\xc3\xa9", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80!", "日本é".encode(), b"\xc3\x28", b"\xf4\x90\x80\x80"):
        s = byte_bpe.Utf8Stream()
        got = "".join(s.feed(data[k : k + 1]) for k in range(len(data))) + s.end()
        assert got == data.decode("utf-8", "replace")


def test_tokens_are_decoded_as_bytes_are(real):
    rnd = random.Random(4)
    c = codec()
    some = real.encode_ordinary("日本é😀 plain text") + [rnd.randrange(50_000) for _ in range(40)]
    for _ in range(300):
        ids = [rnd.choice(some) for _ in range(rnd.randint(0, 12))]
        data = c.decode_bytes(ids)
        assert c.decode(ids) == data.decode("utf-8", "replace") and c.decoded(ids) == data
    with pytest.raises(KeyError):
        c.decode([10**6])


def test_bpe_query(spark, real):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.op6_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = real.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "N_Tokens_": F.lit(1)})
    rows = byte_bpe.map_texts(odd, PATH, public_tokenizers.PATTERN, byte_bpe.digest_row, byte_bpe.DIGEST).collect()
    assert [r.n_tokens for r in rows] == [0, 0, 0]
    assert byte_bpe.map_texts(odd.limit(0), PATH, public_tokenizers.PATTERN, byte_bpe.digest_row, byte_bpe.DIGEST).count() == 0


@pytest.mark.parametrize("name", ["op7_url_filters", "op9_chat_formatting"])
def test_sql_agrees(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = c.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    want = sorted(repr(sorted(zip(cols, r, strict=True))) for r in cur.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in registry.queries()[name](spark, SF).collect()) == want


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?y#z", "http://xcom/en/", "http://com/en/", "x://a.com/en", "x://b.net?/de/", "ftp://example.net/de/8://q", "http://h/a\nb", "http://org/es/#"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(4, urls[4]), (None, "http://c.com/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "_n": F.lit(3)})
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, url_filter.RULES)).collect()}
    assert got == {
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (5, "xcom", "/en/", None, "allow"), (6, "com", "/en/", "com/en/", "block"),
        (7, "a.com", "/en", None, "allow"), (8, "b.net", "", None, "allow"), (9, "example.net", "/de/8://q", "example.net/de/8", "block"),
        (10, "h", "/a\nb", None, "allow"), (11, "org", "/es/", "org/es/", "block"), (None, "c.com", "/en/", "com/en/", "block"),
    }
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    assert url_filter.filter_urls(df, rules).count() == len(rows)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    none = url_filter.filter_urls(df, rules.limit(0), default="block").collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"block"}


def test_url_rules_are_those_of_the_contract(spark):
    rules = {(a, f"{h}{p}") for a, h, p in url_filter.RULES}
    assert rules == {("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")}
    df = spark.createDataFrame([(1, "http://b.net/de/1"), (2, "http://a.example.net/de/7"), (3, "http://a.example.net/de/8")], "page_id long, url string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, url_filter.RULES), default="block").collect()}
    assert got == {(1, "net/de/", "allow"), (2, "net/de/", "allow"), (3, "example.net/de/8", "block")}


def test_chat_round_trip_and_order(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 2)
    tricky = ["<|im_end|>\n", "\\", "\\|", "<\\|", "a\nb", "", "<|", "é😀", "<|im_start|>assistant\nx"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(tricky)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", None), (2, 1, "user", "again"), (3, 0, "assistant", "x"), (4, 5, "user", "u"), (4, None, "system", "first"), (5, 0, "tool", "t"), (None, 0, "user", "n"), (6, 0, None, "r"), (7, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"chunk": F.lit(1), "formatted": F.lit("x")})
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert [s.text for s in got[1].segments] == tricky
    assert [s.loss for s in got[1].segments] == [k % 2 == 1 for k in range(len(tricky))]
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, None: True, 6: False, 7: False}
    assert [(s.role, s.text) for s in got[4].segments] == [("system", "first"), ("user", "u")]
    assert [(s.role, s.text) for s in got[2].segments] == [("system", "s"), ("user", ""), ("user", "again")]
    d = {r.conv_id: r for r in chat_format.digest(chat_format.read_back(chat_format.format_conversations(df))).collect()}
    lost = "".join(t for k, t in enumerate(tricky) if k % 2)
    assert (d[1].loss_chars, d[1].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert chat_format.digest(chat_format.read_back(chat_format.format_conversations(df.limit(0)))).count() == 0
