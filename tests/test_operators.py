"""Retrieval, candidates, sources and the comparison end to end."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text
from tessera.operators import bm25, candidates, grams, simhash, summary, vectors
from tessera.plans import compare, index
from tessera.sources import dicts, docx, report


def test_simhash_against_plain_python(spark):
    texts = ["", "abcdef", "abc", "hello world " * 5, "xin chào 😀 các bạn"]

    def plain(s):
        s = f" {s} "
        grams = [s[i : i + 7] for i in range(len(s) - 6)]
        if not grams:
            return -1
        v = 0
        for k in range(64):
            up = sum(1 if int(hashlib.md5(g.encode()).hexdigest()[:16], 16) >> k & 1 else -1 for g in grams)
            v |= (up >= 0) << k
        return v - (1 << 64) if v >> 63 else v

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(simhash.simhash(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_near_hashes_are_all_found(spark):
    r = np.random.default_rng(2)
    base = [int(x) for x in r.integers(-(2**62), 2**62, 6)]
    hs = base + [b ^ sum(1 << int(k) for k in r.choice(63, n, False)) for b in base for n in (0, 1, 3, 4)]
    df = spark.createDataFrame(list(enumerate(hs)), "doc_id long, simhash long")
    got = {(x.a, x.b) for x in simhash.within(df, "doc_id").collect()}
    first = {}
    for i, h in enumerate(hs):
        first.setdefault(h, i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and bin((hs[a] ^ hs[b]) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_bm25_scopes_and_zero_fill(spark):
    corpus = spark.createDataFrame([("x", 0, "a b c"), ("x", 1, "a a d"), ("x", 2, "e"), ("x", 3, "f g"), ("y", 0, "a"), ("y", 1, "z")], "scope string, b_id long, t string")
    asked = spark.createDataFrame([("x", 0, "d d"), ("y", 0, "a")], "scope string, a_id long, t string")
    top = bm25.topk(asked, corpus, "a_id", "b_id", F.col("t"), F.col("t"), 3, ("scope",)).orderBy("scope", "a_id", "rank").collect()
    assert [(r.scope, r.b_id) for r in top] == [("x", 1), ("x", 0), ("x", 2), ("y", 0), ("y", 1)]
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    assert top[0].score == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (9 / 4))))
    assert top[1].score == 0


def test_vector_topk(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for metric, order in (("cosine", -(u @ u.T)), ("l2", np.linalg.norm(v[:, None] - v[None], axis=2))):
        got = vectors.topk(q, df, "query_id", "vec_id", k=4, metric=metric).orderBy("query_id", "rank").collect()
        assert [x.vec_id for x in got] == [int(k) for i in range(5) for k in np.argsort(order[i], kind="stable")[:4]]
    near = {(x.query_id, x.vec_id) for x in vectors.approximate(q, df, "query_id", "vec_id", k=1).collect()}
    assert near == {(i, i) for i in range(5)}
    with pytest.raises(ValueError):
        vectors.topk(q, df, "query_id", "vec_id", metric="other")


def test_recall_of_approximate_vectors(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(5000, 64)))], "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(x.query_id, x.vec_id): x.score for x in vectors.topk(q, df, "query_id", "vec_id", k=10).collect()}
    got = {(x.query_id, x.vec_id): x.score for x in vectors.approximate(q, df, "query_id", "vec_id", k=10).collect()}
    assert len(got) == len(exact) == 1000 and len(got.keys() & exact.keys()) >= 900
    assert all(abs(got[p] - exact[p]) < 1e-8 for p in got.keys() & exact.keys())
    none = df.limit(0)
    assert vectors.approximate(q, none, "query_id", "vec_id").count() == vectors.approximate(none.withColumnRenamed("vec_id", "query_id"), df, "query_id", "vec_id").count() == 0


def test_gram_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grams, "BLOCK_POSTINGS", 60)
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abcé😀 "), n))
    docs = [(i, word(int(r.integers(0, 40)))) for i in range(80)] + [(90, None)]
    asked = [(i, word(20)) for i in range(12)] + [(20, "abc"), (21, None)]
    sets = {i: {t[k : k + 3] for k in range(len(t or "") - 2)} if t else set() for i, t in docs}
    want = []
    for q, t in asked:
        own = {t[k : k + 3] for k in range(len(t) - 2)} if t else set()
        best = sorted((-round(len(own & s) / max(1, len(own | s)), 9), i) for i, s in sets.items() if own & s)[:3]
        want += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    got = grams.topk(spark.createDataFrame(asked, "item_id long, t string"), spark.createDataFrame(docs, "doc_id long, t string").repartition(3), "item_id", "doc_id", n=3).collect()
    assert sorted((x.item_id, x.doc_id, x["rank"]) for x in got) == sorted(want)


def test_hamming_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "QUERY_ROWS", 4)
    r = np.random.default_rng(6)
    hs = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 60)] + [-1, 0, -1]
    df = spark.createDataFrame(list(enumerate(hs)), "doc_id long, simhash long").repartition(3)
    q = df.where("doc_id % 6 = 0").withColumnRenamed("doc_id", "item_id")
    got = {(x.item_id, x["rank"]): (x.doc_id, x.distance) for x in simhash.topk(q, df, "item_id", "doc_id", k=5).collect()}
    for i in range(0, 63, 6):
        best = sorted((bin((hs[i] ^ h) & (1 << 64) - 1).count("1"), j) for j, h in enumerate(hs))[:5]
        assert [got[i, n] for n in range(1, 6)] == [(j, d) for d, j in best]


def test_bm25_without_broadcast(spark, monkeypatch):
    corpus = spark.createDataFrame([(k, " ".join("abcdefgh"[(k * j) % 8] for j in range(1, k + 2))) for k in range(30)], "b_id long, t string")
    asked = spark.createDataFrame([(0, "a b b"), (1, "h"), (2, "z")], "a_id long, t string")
    run = lambda: sorted((x.a_id, x.b_id, round(x.score, 9), x.common, x.terms) for x in bm25.scores(asked, corpus, "a_id", "b_id", F.col("t"), F.col("t")).collect())
    want = run()
    monkeypatch.setattr(bm25, "ASKED_AT_ONCE", 0)
    assert run() == want and {x[0] for x in want} == {0, 1}


def test_candidates(spark):
    lists = [spark.createDataFrame([(0, b, n) for n, b in enumerate(x, 1)], "a long, b long, rank int") for x in ([7, 90], [3, 7], [60])]
    assert sorted(r.b for r in candidates.union_cut(lists, "a", "b", 3).collect()) == [3, 7, 60]
    none = spark.createDataFrame([(0, b, 0.1, 0.1) for b in (4, 9, 11, 20)] + [(1, 1, 0.5, 0.0), (1, 2, 0.0, 0.0)], "a long, b long, bi double, lex double")
    got = {(r.a, r.b) for r in candidates.prefilter(none, "a", "b").where("eligible").collect()}
    assert got == {(0, 4), (0, 9), (0, 11), (1, 1)}
    gate = candidates.gated(candidates.prefilter(none, "a", "b"), "a", "b")
    assert {(r.a, r.b) for r in gate.collect()} == {(1, 1)}
    keys, cache = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert [r.k for r in candidates.missing(keys, cache, "k").collect()] == ["b"] and [r.v for r in candidates.cached(keys, cache, "k").collect()] == [1]


def test_union_coverage(spark):
    df = spark.createDataFrame([(1, 0, 10, 40), (1, 10, 15, 40), (1, 20, 30, 40)], "k int, s int, e int, n int")
    r = summary.union_coverage(df, "k", F.col("s"), F.col("e"), F.col("n")).first()
    assert (r.covered, r.pct, r.words) == (25, 62.5, 5)


def test_dictionaries(spark, tmp_path):
    lines, terms = tmp_path / "l.txt", tmp_path / "t.tsv"
    lines.write_text(" b \n\na\nb\nNghĩa\n", encoding="utf-8")
    terms.write_text("SV\tsinh viên\tx\nbad\n\nsv\thọc sinh\n", encoding="utf-8")
    assert dicts.phrase_list(str(lines)) == ["b", "a", "Nghĩa"]
    assert dicts.term_map(str(terms)) == {"sv": "học sinh"}
    assert {r.phrase for r in dicts.phrase_table(spark, str(lines)).collect()} == {"a", "b", "Nghĩa"}
    assert [tuple(r) for r in dicts.term_table(spark, str(terms)).collect()] == [("sv", "học sinh")]
    with pytest.raises(FileNotFoundError):
        dicts.load({"stop_phrases": str(tmp_path / "none")})
    assert dicts.load({}).synonyms == {}
    assert dicts.domain_boilerplate(["X"], [str(lines), str(tmp_path / "none")]) == ["X", "b", "a", "nghĩa"]


def test_config(tmp_path):
    raw = {"chunking": {"size_tokens": 99}, "ranking_weights": {"alpha": 1}, "bm25": {"k1": 9, "topk": 7}, "gating": {"ce_max_bi": 1.0}}
    c = config.from_dict(raw)
    assert (c.size_tokens, c.weights[0], c.bm25_topk, c.ce_max_bi, c.mode) == (99, 1.0, 7, 1.0, "sentence")
    assert config.from_dict({}).mode == "paragraph"
    assert config.deep_update({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.with_settings(c, {"bm25_topk": 3, "weights": (9, 9, 9, 9)}).weights == c.weights


WORDS = "mái trường bền vững cần nguồn học liệu phong phú để sinh viên rèn luyện kỹ năng phân tích dữ liệu hiện đại".split()


def test_compare_end_to_end(spark, tmp_path):
    shared = " ".join(WORDS) + " và áp dụng chúng vào đồ án cuối khóa."
    a, b = tmp_path / "a.docx", tmp_path / "b.docx"
    a.write_bytes(docx.build(["Lời mở đầu không liên quan.", shared, "Mục lục 1"], [[["ô một", ""]]]))
    b.write_bytes(docx.build(["Chương khác hẳn về thời tiết.", shared]))
    cfg = config.Config(ignore_sections=("Mục lục",))
    got = compare.compare(spark, str(a), str(b), str(tmp_path / "out"), cfg)
    assert got["summary"]["pairs"] == len(got["pairs"]) >= 1 and not got["meta"]["cfg"]["models"]["neural"]
    p = got["pairs"][0]
    s, e = p["a"]["spans"][0]
    assert "rèn luyện kỹ năng" in p["a"]["text"][s:e] and "mục lục" not in p["a"]["text"]
    back = report.read_pairs(spark, str(tmp_path / "out.json")).collect()
    assert [(r.a_chunk_id, r.level, round(r.score, 6)) for r in back] == [(p["a_chunk_id"], p["level"], round(p["score"], 6)) for p in got["pairs"]]
    assert "<mark>" in (tmp_path / "out.html").read_text(encoding="utf-8")
    assert json.loads((tmp_path / "out.json").read_text(encoding="utf-8"))["summary"] == got["summary"]
    rows = report.csv_rows(report.read_pairs(spark, str(tmp_path / "out.json"))).collect()
    assert rows[0].score == f"{got['pairs'][0]['score']:.4f}"
    with pytest.raises(ValueError):
        compare.compare(spark, "x.txt", str(b))


def test_empty_side_gives_no_pairs(spark):
    none = spark.createDataFrame([("0", "")], "scope string, text string")
    some = spark.createDataFrame([("0", "một câu.")], "scope string, text string")
    assert compare.matches(none, some, config.Config())[0].count() == 0
    assert compare.matches(some, none, config.Config())[0].count() == 0


def test_index_and_search(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.docx").write_bytes(docx.build(["Trời mưa rất to ở miền Trung."]))
    (tmp_path / "in/sub/b.docx").write_bytes(docx.build(["Giá vàng tăng mạnh hôm nay."]))
    for _ in range(2):
        got = index.build(spark, str(tmp_path / "in"), str(tmp_path / "ix"), cache=str(tmp_path / "cache"))
    assert got["num_chunks"] == 2 and spark.read.parquet(str(tmp_path / "cache")).count() == 2
    q = spark.createDataFrame([(0, "giá vàng hôm nay")], "query_id long, text string")
    for approximate in (False, True):
        assert "giá vàng" in index.search(spark, str(tmp_path / "ix"), q, 1, approximate=approximate).first().text


def test_log(tmp_path):
    log = report.JsonLog(str(tmp_path / "l.jsonl"))
    with log.section("s"):
        pass
    assert json.loads((tmp_path / "l.jsonl").read_text())["section"] == "s"
    assert Counter(text.canonical_phrases(["a", "bb", "a"])) == Counter({"a": 1, "bb": 1})


def settings_file(tmp_path, **more):
    import yaml

    (tmp_path / "data").mkdir(exist_ok=True)
    (tmp_path / "conf").mkdir(exist_ok=True)
    lists = {"stops.txt": "rèn luyện\n", "boiler.txt": "Nguồn học liệu\n", "domain.txt": "Phong Phú\n\n", "abbr.tsv": "ĐH\tđại học\nsv\tsinh viên\n", "syn.tsv": "học viên\tsinh viên\n", "heads.txt": " Chương một \n"}
    for name, body in lists.items():
        (tmp_path / "data" / name).write_text(body, encoding="utf-8")
    raw = {
        "dictionary_paths": {"stop_phrases": "data/stops.txt", "boilerplate": "data/boiler.txt", "abbreviations": "data/abbr.tsv", "synonyms": "data/syn.tsv", "section_headers": "data/heads.txt", "gazetteer": "data/none.tsv"},
        "domain_boilerplate": {"enabled": True, "paths": ["data/domain.txt", "data/none.txt"]},
        "chunking": {"mode": "paragraph"},
        "gating": {"ce_max_bi": 1.0},
        **more,
    }
    path = tmp_path / "conf" / "settings.yaml"
    path.write_text(yaml.safe_dump(raw, allow_unicode=True), encoding="utf-8")
    return str(path)


def test_settings_read_their_dictionaries(tmp_path):
    c = config.load(settings_file(tmp_path))
    assert c.stop_phrases == ("rèn luyện",) and c.boilerplate == ("Nguồn học liệu", "phong phú") and c.section_headers == ("Chương một",)
    assert dict(c.abbreviations) == {"đh": "đại học", "sv": "sinh viên"} and dict(c.synonyms) == {"học viên": "sinh viên"}
    assert config.load(settings_file(tmp_path, domain_boilerplate={"enabled": False, "paths": ["data/domain.txt"]})).boilerplate == ("Nguồn học liệu",)
    with pytest.raises(FileNotFoundError):
        config.load(settings_file(tmp_path, dictionary_paths={"stop_phrases": "data/missing.txt"}))
    assert config.load(settings_file(tmp_path, dictionary_paths={"section_headers": "data/missing.txt"})).section_headers == ()


def test_dictionaries_change_a_comparison(spark, tmp_path):
    shared = " ".join(WORDS) + " và áp dụng chúng vào đồ án cuối khóa."
    a, b = tmp_path / "a.docx", tmp_path / "b.docx"
    a.write_bytes(docx.build(["Chương một", "SV ở ĐH. " + shared], []))
    b.write_bytes(docx.build(["Lời khác hẳn.", "Học viên ở đại học. " + shared], []))
    plain = compare.compare(spark, str(a), str(b), cfg=config.Config(ce_max_bi=1.0))
    known = config.load(settings_file(tmp_path))
    with_lists = compare.compare(spark, str(a), str(b), str(tmp_path / "out"), known)
    bare = {(p["a"]["text"], p["b"]["text"]): p["scores"]["lex"] for p in plain["pairs"]}
    pairs = {(p["a"]["text"], p["b"]["text"]): p["scores"]["lex"] for p in with_lists["pairs"]}
    assert any("SV ở ĐH" in x for x, _ in pairs) and not any("Chương một" in x and "SV" in x for x, _ in pairs)  # a heading is a chunk of its own
    # Boilerplate of both kinds stands on both sides, so the lexical score is halved (the stop phrase is taken out before it can count).
    only_maps = compare.compare(spark, str(a), str(b), cfg=config.load(settings_file(tmp_path, penalties={"lex_boilerplate_lambda": 0.0})))
    undone = {(p["a"]["text"], p["b"]["text"]): p["scores"]["lex"] for p in only_maps["pairs"]}
    (key,) = [k for k in pairs if "SV ở ĐH" in k[0]]
    assert pairs[key] == pytest.approx(undone[key] / 2, abs=1e-6) and bare
    sections = [json.loads(x)["section"] for x in (tmp_path / "out.log.jsonl").read_text().splitlines()]
    assert {"read_docs", "chunking", "indexes", "match_rerank_align", "aggregate"} <= set(sections)


def test_uploads(spark, tmp_path):
    raw = docx.build([" ".join(WORDS) + " và áp dụng chúng vào đồ án cuối khóa."], [])
    got = compare.compare_uploads(spark, ("x.DOCX", raw), ("y.docx", raw), settings={"bm25_topk": 3})
    assert got["summary"]["pairs"] >= 1 and got["meta"]["cfg"]["bm25_topk"] == 3
    with pytest.raises(ValueError):
        compare.compare_uploads(spark, ("x.txt", raw), ("y.docx", raw))


def test_hardware(tmp_path):
    path = tmp_path / "hw.yaml"
    path.write_text("device: {use_gpu: true, omp_threads: 10}\n")
    hw = config.hardware(str(path))
    assert config.thread_settings(hw) == {"spark.executorEnv.OMP_NUM_THREADS": "10", "spark.executorEnv.MKL_NUM_THREADS": "8"}
    assert config.device_config(hw) == {"use_gpu": True, "torch_dtype": "float32"}


def test_reports_of_any_shape(spark, tmp_path):
    import yaml

    one = {"results": [{"similarity": 75, "a_id": 4, "b_id": 1, "a_text": "x & y", "b": "z"}, {"sim": 0.5, "level": "odd"}], "stats": {"took": 3, "chunks_B": 9}, "meta": {"cfg": {"thresholds": {"high": 0.74, "medium": 0.4}}}}
    two = {"pairs": [{"score": 0.75, "a_chunk_id": 0, "b_chunk_id": 0}], "summary": {"levels": {"high": 7}}, "meta": {"cfg": {"thresholds": {"high": 0.9, "very_high": 0.95, "medium": 0.8}}}}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/one.json").write_text(json.dumps(one))
    (tmp_path / "r/two.json").write_text(json.dumps(two))
    (tmp_path / "three.yaml").write_text(yaml.safe_dump(one))
    # Each report has its own bounds; without very_high its bound is that of high.
    assert sorted((r.score, r.level) for r in report.read_pairs(spark, str(tmp_path / "r")).collect()) == [(0.5, "odd"), (0.75, "low"), (0.75, "very_high")]
    assert [(r.score, r.level, r.a.text) for r in report.read_pairs(spark, str(tmp_path / "three.yaml")).collect()] == [(0.75, "very_high", "x & y"), (0.5, "odd", "")]
    full = report.normalized(spark, str(tmp_path / "three.yaml"))
    assert full["summary"] == {"took": 3, "chunks_A": 5, "chunks_B": 9, "levels": {"very_high": 1, "high": 0, "medium": 0, "low": 0, "odd": 1}} and full["meta"] == one["meta"]
    assert report.normalized(spark, str(tmp_path / "r/two.json"))["summary"] == {"levels": {"high": 7}, "chunks_A": 1, "chunks_B": 1}
    (tmp_path / "empty.json").write_text("{}")
    assert report.normalized(spark, str(tmp_path / "empty.json")) == {"summary": {"levels": {"very_high": 0, "high": 0, "medium": 0, "low": 0}, "chunks_A": 0, "chunks_B": 0}, "pairs": [], "meta": {}}
    page = open(report.export_html(spark, str(tmp_path / "r/one.json"), str(tmp_path / "p.html"))).read()
    assert "x &amp; y" in page and "75.0%" in page
    with pytest.raises(FileNotFoundError):
        report.normalized(spark, str(tmp_path / "none.json"))
    assert summary.heat_pairs(report.read_pairs(spark, str(tmp_path / "r"))).count() == 2


def test_caches_and_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert report.json_cache_read(spark, path, "a").count() == 0
    rows = spark.createDataFrame([("k", '{"x": 1}'), ("l", "no json")], "key string, value string")
    report.json_cache_add(rows, path, "a")
    report.json_cache_add(rows, path, "b")
    assert [(r.key, json.loads(r.value)) for r in report.json_cache_read(spark, path, "a").collect()] == [("k", {"x": 1})]
    (tmp_path / "bad").write_text("not a table")
    with pytest.raises(Exception):
        report.cache_read(spark, str(tmp_path / "bad"), "key string").collect()
    got = spark.createDataFrame([(["a", "bé"], b"\x00\xff", "A\u0301B")], "t array<string>, b binary, d string").select(text.content_key_list(F.col("t")).alias("l"), text.content_key_texts("m", F.col("t")).alias("m"), text.content_key_bytes(F.col("b")).alias("b"), text.dual_form(F.col("d")).alias("d"), text.percent(F.lit(0.1234)).alias("p"), text.label(F.lit("very_high")).alias("v")).first()
    listed = hashlib.md5("\x1ea\x1ebé".encode()).hexdigest()
    assert (got.l, got.m, got.b) == (listed, hashlib.md5(f"model=m||{listed}".encode()).hexdigest(), hashlib.md5(b"\x00\xff").hexdigest())
    assert tuple(got.d) == ("áb", "ab") and (got.p, got.v) == ("12.3%", "VERY HIGH")
    assert text.content_key_list is not None and Counter(x.l for x in spark.createDataFrame([([],)], "t array<string>").select(text.content_key_list(F.col("t")).alias("l")).collect()) == Counter([hashlib.md5(b"").hexdigest()])
