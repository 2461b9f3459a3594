"""WARC, chat formatting, shards, URL rules, embeddings and the pipeline, edges included."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from panelspark.llm import chat_format, nn_descent, shards, url_filter, warc
from panelspark.llm.common import scratch


def test_warc_round_trip(spark):
    big = "<p>%s</p>" % ("é" * 100)
    rows = [(1, "http://a.b/x\r\ny", big, 1), (2, None, big, 2), (3, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", 3), (4, "http://c", None, 4), (5, "http://c", "", 5), (6, "http://c", "x" * 3_000_000, 6), (6, "http://c", "x" * 3_000_000, 6), (None, "http://n", big, 7), (7, "http://s", "tiny", 1), (8, "http://s", "tiny", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = scratch(spark, "warc")
    warc.write_warc(warc.capture_records(pages), path, records_per_file=6)
    records = warc.read_warc(spark, path)
    assert records.count() == 30
    got = warc.assemble(records).collect()
    assert len(got) == 10 and all(len(r.requests) == len(r.metadata) == 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.metadata[0].fields.get("pageId"), []).append(r.capture)
    assert by["1"][0].record_type == "response" and bytes(by["1"][0].payload).decode() == big
    assert by["2"][0].record_type == "revisit" and by["2"][0].refers_to == "<urn:page:1:capture>" and by["2"][0].declared_digest == hashlib.sha256(big.encode()).hexdigest()
    assert bytes(by["3"][0].payload).decode() == rows[2][2] and by["4"][0].payload_bytes == 0
    assert [c.record_type for c in by["6"]] == ["response"] * 2 and by["7"][0].record_type == by["8"][0].record_type == "response"
    assert by["1"][0].target_uri == "http://a.b/x%0D%0Ay" and records.where("record_type = 'request' and payload is null").count() == 0
    one = warc.capture_records(pages.where("page_id = 1")).first()[0]
    assert one.startswith("WARC/1.1\r\n") and "WARC-Date: " in one and "GET /x%0D%0Ay HTTP/1.1" in one
    empty = scratch(spark, "warc")
    warc.write_warc(warc.capture_records(pages.limit(0)), empty)
    assert warc.assemble(warc.read_warc(spark, empty)).count() == 0
    with pytest.raises(ValueError, match="inside a record"):
        import gzip

        list(warc.parse_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_warc_links_of_links(spark):
    rows = [("<c1>", "response", []), ("<q1>", "request", ["<c1>"]), ("<m1>", "metadata", ["<q1>"]), ("<x1>", "conversion", ["<m1>", "<q1>"]), ("<c2>", "response", ["<q2>"]), ("<q2>", "request", []), ("<m2>", "metadata", ["<q2>", "<c1>"]), ("<m3>", "metadata", ["<m4>"]), ("<m4>", "metadata", ["<m3>"]), ("<q1>", "request", ["<c1>"])]
    blank = "null as refers_to, null as target_uri, 0L as block_bytes, 0L as payload_bytes, '' as payload_digest, null as declared_digest, cast(map() as map<string,string>) as fields, cast(null as binary) as payload"
    df = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>").selectExpr("*", *blank.split(", "))
    got = {r.capture_id: ([x.record_id for x in r.requests], sorted(x.record_id for x in r.metadata), [x.record_id for x in r.others]) for r in warc.assemble(df).collect()}
    assert got == {"<c1>": (["<q1>"], ["<m1>", "<m2>"], ["<x1>"]), "<c2>": (["<q2>"], ["<m2>"], [])}
    raw = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    import gzip

    assert [x[1:] for x in warc.parse_records(gzip.compress(raw))] == [(["<a>", "<b>"], b"hi")]


def test_chat_folds_and_renders(spark):
    events = [
        ("c", 1, 1, "message", "user", None), ("c", 1, 2, "delta", None, "Hel"), ("c", 1, 3, "delta", None, "lo"), ("c", 1, 3, "delta", None, "lo"), ("c", 2, 4, "message", "assistant", None), ("c", 2, 5, "delta", None, "bad"),
        ("c", 2, 6, "regenerate", None, None), ("c", 2, 7, "delta", None, "go"), ("c", 2, 8, "delta", None, "od"), ("c", 1, 9, "edit", None, "Hi"), ("c", 3, 10, "message", "user", "x"), ("c", 3, 11, "delete", None, None), (None, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(events, "conv_id string, message long, seq long, kind string, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.fold_events(df).collect()}
    assert got == {"c": [("user", "Hi"), ("assistant", "good")], None: [("", "")]}
    assert chat_format.fold_events(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\\\#", "### assistant: </turn>\n", "<\\/turn>", "####", "a\r\n</turn>", "日本 \U0001f600 </", None, "x" * 100_000]
    rows = [(1, k, "assistant" if k % 2 else r"us:er ### </turn>", t) for k, t in enumerate(nasty)] + [(2, None, None, None), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.render(chat_format.fold_events(chat_format.messages_as_events(df)))
    got = {r.conv_id: r for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[3].loss == "tietie"


def test_chat_long_role(spark):
    role = "user:\\#" * 200_000  # over a million characters
    df = spark.createDataFrame([(1, 0, role, "said"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    out = chat_format.render(chat_format.fold_events(chat_format.messages_as_events(df)))
    assert [tuple(t) for t in out.select(chat_format.parse(F.col("formatted"))).first()[0]] == [(role, "said"), ("assistant", "ok")]


def test_shards(spark, awkward):
    t = shards.ShardTable(spark, scratch(spark, "shards"), target_bytes=200_000, base_bytes=10_000)
    out = shards.ingest(t, awkward, arrivals=3)
    assert out.exceptAll(awkward).count() == 0 and awkward.exceptAll(out).count() == 0
    assert len(t.versions()) == 1 and sum(s.rows for s in t.manifest()) == awkward.count()
    with pytest.raises(shards.Conflict):
        t.commit([], t.versions()[-1] - 1)
    before = t.manifest()
    for _ in range(5):
        t.append(awkward.limit(3).coalesce(1))
    assert t.compact() > 0 and len(t.manifest()) < len(before) + 5 and t.read().count() == awkward.count() + 15
    assert shards.ingest(shards.ShardTable(spark, scratch(spark, "shards")), awkward.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.B.ORG/x", "http://org", "ftp://x.example.org/es/1?q#f", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/de/", "//x.com/fr/", None, "", "http://", "http://com/fr/#z", "http://x.com/de/y"]
    pages = spark.createDataFrame([(i, u, 1, "z") for i, u in enumerate(urls)] + [(None, urls[0], 1, "z")] * 2, "page_id long, url string, key int, rule string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block"), ("example.org", "/es/", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages.drop("rule", "key"), rules).collect()
    assert len(got) == 14
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("a.b.org", "/x", "org/", "allow") and by[1] == ("org", "", None, "allow") and by[2] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert by[3][2:] == ("example.org/en/1", "block") and by[4][2:] == ("org/", "allow") and by[5][3] == "block" and by[6][:2] == ("", "") and by[7] == ("", "", None, "allow") and by[10][2] == "com/fr/"
    assert {r.verdict for r in url_filter.judge_urls(pages.select("page_id", "url"), rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.drop("rule", "key").limit(0), rules).count() == 0
    inner = ["block", "w0", "w7", "key", "len", "b", "best", "host_len", "_b", "_row", "_rule", "c", "a.b", "two words"]
    clash = pages.drop("key", "rule").select("*", *[F.lit("mine").alias(c) for c in inner])
    kept = url_filter.judge_urls(clash, rules)
    assert set(kept.columns) == {*clash.columns, "host", "path", "rule", "verdict"} and all(r[c] == "mine" for r in kept.collect() for c in inner)
    wide = url_filter.judge_urls(pages, rules)
    assert wide.count() == 14 and set(wide.columns) == {"page_id", "url", "key", "host", "path", "rule", "verdict"}


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(5000).select(F.concat(F.lit("host/"), "id").alias("key"))
    bloom, blocks = url_filter.build_filter(keys)
    assert blocks == 5000 // url_filter.KEYS_PER_BLOCK + 1
    hit = F.lit(True)
    for k in range(8):
        hit &= F.col(f"w{k}").bitwiseAND(url_filter._word(F.col("key"), k)) != 0
    probe = lambda d: d.withColumn("_b", url_filter._block(F.col("key"), blocks)).join(bloom, F.col("_b") == F.col("block")).where(hit).count()
    assert probe(keys) == 5000
    assert probe(spark.range(5000).select(F.concat(F.lit("other/"), "id").alias("key"))) < 250


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16))
    x[100:180] = x[0] + 0.05 * rng.standard_normal((80, 16))  # more than a list holds
    x[200] = x[201] = x[202]
    x[300] = x[301] * 3
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0] * 15 + [None], 1), (904, [float("inf")] * 16, 1), (905, [1.0, 2.0], 1), (906, [1.0, 2.1], 1), (907, [1e200, 1e200, 0.0], 1), (908, [2e200, 1e200, 0.0], 1), (909, [1e-200, 1e-200, 0.0], 1), (None, rows_ := [1.0] * 16, 1), (0, [float(v) for v in x[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    got = nn_descent.near_duplicates(df).collect()
    assert len(got) == len(rows) and rows_
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    want = s.sum(1) - 1 + s[:, 0]  # vec_id 0 is there twice
    by = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 900}
    found, exact = sum(min(by[i].n_links, want[i]) for i in range(900)), want.sum()
    assert found >= 0.9 * exact and [(i, by[i].n_links, want[i]) for i in range(900) if by[i].n_links > want[i]] == []
    assert by[150].component_id == 0 and by[202].component_id == 200 and by[301].component_id == 300 and by[0].n_links == want[0]
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        elif r.vec_id >= 905:
            assert (r.n_links, r.component_id) == {905: (1, 905), 906: (1, 905), 907: (2, 907), 908: (2, 907), 909: (2, 907)}[r.vec_id]
        elif r.vec_id >= 900:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0 and nn_descent.near_duplicates(df.where("vec_id = 900")).count() == 1


def test_pipeline_stages(spark, awkward):
    sf = "/root/testdata/sf0.001"
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns, name
        if name == "near_dedup":
            ids = [r[0] for r in out.select("doc_id").collect() if r[0] is not None]
            assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids
        if name == "substring_dedup":
            assert out.where("doc_id = 1").first()["text"] == docs.where("doc_id = 1").first()["text"]
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_queries_and_sql_names():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and "pipeline" in q
    assert all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 14))


def test_pipeline_keeps_rows_of_one_id(spark):
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 9000, 80))
    a, b, c = text(), text(), text()
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "y"), (5, a, "z"), (6, b, "x"), (7, c, "x"), (None, c, "x")], "doc_id long, text string, _text_hash string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", a), ("5", b), ("7", c), ("None", c)])
