"""The ten operators against brute force, exact round trips and held-out accuracy, with odd tables."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, common, counts, decontaminate, encode, jaccard, licences, packing, pii, quality, sstable, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, start long, node string, h long, words string, at int, _keep boolean, _hit int"
TEXTS = [None, "", " \n", "one", "the same words again and again here", "the same words again and again here", "The Same words, again and again here!", "x" * 30_000, "¿?", "Mail a.b@c.example.com or +1 (743) 555-3824 now."]


def table(spark, texts, ids=None):
    """Documents with null columns and columns whose names clash with inner ones."""
    rows = [(i, t, None, None, None, 7, 8, "n", 9, "w", 1, True, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_encoder_equals_the_library():
    r = random.Random(1)
    letters = "abcXYZéÉßŸÿŁłŒœĲĳŉſÆØþÐıĿİΣς'’.,!-*|<>😀中0१²½ \n\t\x1ć̇​"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["don't it's 'S x'll <|endoftext|> x<|endoftext|>y İstanbul ΑΣ ὈΔΥΣΣΕΎΣ ﬁ Å ẞ ŉ"]
    e = encode.Encoder(encode.default_path())
    for t, raw in zip(texts, e.ids(texts)):
        assert np.frombuffer(raw, e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_files_of_other_stages_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, e = Tokenizer.from_file(path), encode.Encoder(path)
    for t in ["", "Two  words\n and more", "Ünï  x", "don't 12"]:
        assert np.frombuffer(e.ids([t])[0], e.kind).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert not e.word_wise and encode.Encoder(encode.default_path()).word_wise


def test_failed_attempts_leave_no_file(spark):
    folder = common.scratch(spark, "files")
    store, top = common.filesystem(folder)
    store.create_dir(top)
    with pytest.raises(RuntimeError), common.attempt(folder, "a", ".x") as (path, sink):
        sink.write(b"1")
        raise RuntimeError
    from pyarrow import fs

    assert store.get_file_info(fs.FileSelector(top)) == []
    with common.attempt(folder, "a", ".x") as (one, sink):
        sink.write(b"1")
    with common.attempt(folder, "a", ".x") as (two, sink):
        sink.write(b"1")
    common.tidy(folder, [one])
    assert [x.path for x in store.get_file_info(fs.FileSelector(top))] == [one] and one != two
    common.release(spark, [folder])


# --- 1 ------------------------------------------------------------------------------------------------------------


def held(rows, ids, max_len):
    by_doc: dict = {}
    by_seq: dict = {}
    for r in rows:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) and 0 < r.length <= max_len
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in by_doc.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        assert sum(n for _, n in parts) == len(ids[doc])
    for parts in by_seq.values():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= max_len
    return by_seq


def test_packing(spark):
    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choice(["the", "of", "cat"]) for _ in range(int(r.expovariate(1 / 60)))) for _ in range(200)] + ["a b c"] * 100
    ids = library_ids(texts)
    seqs = held(packing.pack(spark, table(spark, texts), max_len=64).collect(), ids, 64)
    assert sorted(seqs) == list(range(len(seqs)))
    assert sum(map(len, ids)) / (64 * len(seqs)) > 0.97
    assert packing.pack(spark, table(spark, [])).count() == 0
    assert packing.pack(spark, table(spark, ["a", "a"], [None, None])).count() == 2


def test_patterns_hold_every_length():
    r = random.Random(0)
    for _ in range(200):
        h = {r.randint(1, 50): r.randint(1, 40) for _ in range(r.randint(0, 20))}
        found = packing.patterns(h, 50)
        got: Counter = Counter()
        for count, lengths in found:
            assert count > 0 and sum(lengths) <= 50
            for n in lengths:
                got[n] += count
        assert got == Counter(h)


# --- 2 ------------------------------------------------------------------------------------------------------------


def labelled(spark, n=600, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = r.choice(["good", "good", "symbols", "toxic"])
        words = [r.choice("alpha beta gamma delta of the and to".split()) + r.choice(["", "x", "ing"]) for _ in range(r.randint(20, 80))]
        if kind == "symbols":
            words = [w + "###" for w in words]
        if kind == "toxic":
            words[3] = words[9] = "dreadword"
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, int(kind != "symbols"), int(kind == "toxic")))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    fit = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r._keep for r in quality.classify(docs, quality.fit(docs, fit)).collect()}
    rest = [(got[i], q == 1 and not t) for i, q, t in labels if i % 3 == 0]
    assert np.mean([a == b for a, b in rest]) > 0.95
    assert quality.accepted(docs, fit).columns == docs.columns


def test_capitals_of_the_whole_text():
    r = random.Random(9)
    for text in ["", "x", "AbÉßΣǅⅣ😀", "".join(r.choice("abcÀÉΣx Ⅳ") for _ in range(50_000))]:
        assert quality.capitals(text) == quality.capitals(text, 7) == sum(map(str.isupper, text))
    text = "Abcd" * 5000  # a stride of 4 would see capitals alone
    assert quality._shape(text, [text])[1] == np.searchsorted(quality._BINS, 0.25, side="right")


def test_quality_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, TEXTS).select("doc_id", "text", "source", "lang")
    assert quality.accepted(docs, none).count() == len(TEXTS)
    assert quality.accepted(docs.limit(0), none).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (4, 1, 0), (6, 0, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, quality.fit(docs, nulls)).count() == len(TEXTS)


def test_labelled_identifiers_count_once(spark):
    docs, labels = labelled(spark, 300)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = quality.fit(docs, labels, rows=100)
    again = docs.unionByName(docs.where("doc_id < 150").crossJoin(spark.range(40)).drop("id")).withColumn("words", F.lit(1)).withColumn("y", F.lit("x")).withColumn("h", F.lit(0))
    many = quality.fit(again, labels.unionByName(labels), rows=100)
    assert one.words == many.words and (one.bins == many.bins).all() and (one.bias, one.base) == (many.bias, many.base)


@pytest.mark.parametrize("at_once", [common.JOIN_AT_ONCE, 0])
def test_posteriors_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "JOIN_AT_ONCE", at_once)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    r = random.Random(12)
    docs, labels = labelled(spark, 500, seed=12)
    rows = [(d.doc_id, d.text, r.choice(["de", "en", None]), r.choice(["a", "a", "a", "b", None, f"s{d.doc_id % 40}"])) for d in docs.collect()] + [(None, None, None, None), (7, "", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.classify(docs, model).collect()
    assert len(got) == len(rows) and Counter((x.doc_id, x.text, x.lang, x.source) for x in got) == Counter(rows)
    evidence = [model.evidence(t or "") for _, t, _, _ in rows]
    p = [1 / (1 + math.exp(-(e + model.base))) for e in evidence]
    sites: dict = {}
    hosts: dict = {}
    for (_, _, path, host), x in zip(rows, p):
        sites.setdefault((host, path), []).append(x)
        hosts.setdefault(host, []).append(x)
    n, g = len(p), sum(p) / len(p)
    strength = lambda between, rate: min(max(rate * (1 - rate) / max(between, 1e-9) - 1, 1.0), 1e6)
    kh = strength(max(sum(len(x) * np.mean(x) ** 2 for x in hosts.values()) / n - g * g - len(hosts) * g * (1 - g) / n, 0), g)
    kp = strength(max(sum(len(x) * (np.mean(x) - np.mean(hosts[h])) ** 2 for (h, _), x in sites.items()) / n - len(sites) * g * (1 - g) / n, 0), g)
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    want = Counter()
    for (doc, text, path, host), e in zip(rows, evidence):
        hp = (sum(hosts[host]) + kh * g) / (len(hosts[host]) + kh)
        pp = (sum(sites[host, path]) + kp * hp) / (len(sites[host, path]) + kp)
        post = 1 / (1 + math.exp(-(e + model.base + min(max(logit(pp) - logit(g), -quality.SITE_LIMIT), quality.SITE_LIMIT))))
        want[doc, text, round(hp, 8), round(pp, 8), round(post, 8), post >= quality.KEEP] += 1
    assert Counter((x.doc_id, x.text, round(x._host_posterior, 8), round(x._path_posterior, 8), round(x._posterior, 8), x._keep) for x in got) == want
    assert 0 < sum(k[-1] * v for k, v in want.items()) < len(rows)


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 500 + [("big", "q", 0.1)] * 500 + [("small", "p", 0.0)]
    got = {(r._h, r._p): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"), 0.0).collect()}
    assert abs(got["big", "p"].path_posterior - 0.9) < 0.02 and abs(got["big", "q"].path_posterior - 0.1) < 0.02
    assert got["small", "p"].path_posterior > 0.2  # one document says little


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    texts = [*TEXTS, "Released under the MIT License.", "mit\nLICENSE mit-license éMIT license", "general public license general public license", "This work is licensed under the GNU General Public License, version 3.", "license", "licensed under the Apache License, Version 2.0 x apache license"]
    texts += [" ".join(random.Random(k).choice(["mit", "license", "apache", "general", "public", "x"]) for _ in range(60)) for k in range(20)]
    got = {r.doc_id: r for r in licences.scan(table(spark, texts)).collect()}
    between = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t in enumerate(texts):
        words = between.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[len(TEXTS)].labels == "mit,mit-notice" and got[len(TEXTS) + 3].labels == "gpl,gpl-3.0"
    assert licences.scan(table(spark, [])).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("at_once", [common.JOIN_AT_ONCE, 0])
def test_warc_round_trip(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "JOIN_AT_ONCE", at_once)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    bodies = [None, "", "a", "b" * 100, "a", "é\r\n\r\nx", "b" * 100, *[f"<p>{k}</p>" * 40 for k in range(40)]]
    rows = [(k, f"http://x/{k}\nq r", b) for k, b in enumerate(bodies)] + [(3, "http://again", "b" * 100), (None, None, "z"), (None, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).withColumn("payload", F.lit("p")).repartition(3)
    for least in (0, 50):
        folder = common.scratch(spark, "warc")
        archives = warc.write(pages, folder, least=least)
        got = Counter(tuple(r) for r in warc.read(spark, archives).collect())
        first: dict = {}
        for k, _, b in rows:
            if k is not None:
                first[b or ""] = min(first.get(b or "", k), k)
        want: Counter = Counter()
        done = set()
        for k, _, b in rows:
            raw = (b or "").encode()
            head = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            f = first.get(b or "") if len(raw) >= least else None
            alone = k is None and (f is None or True)
            revisit = not alone and f is not None and (k != f or (k, b or "") in done)
            done.add((k, b or ""))
            want[k, len(raw), head, "revisit" if revisit else "response", f if revisit else None] += 1
        assert got == want
        from pyarrow import fs

        store, top = common.filesystem(folder)
        assert {x.path for x in store.get_file_info(fs.FileSelector(top))} == {a["path"] for a in archives}
    assert warc.write(pages.limit(0), common.scratch(spark, "warc")) == []
    assert warc.read(spark, []).count() == 0


def test_warc_frames_and_damage():
    out = io.BytesIO()
    w = warc.Writer(out)
    records = [warc.record(k, "u", b"payload %d " % k * 50, None) for k in range(200)]
    for r in records:
        w.add(r)
    w.close()
    assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == records
    assert out.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    assert warc.build_dictionary([]) == b"" and warc.build_dictionary([b"x" * 100_000]) == b"x" * warc.DICT_BYTES
    for held in ([b"ab" * 500_000] * 3, [b"tiny"]):  # too few records to train a dictionary
        out = io.BytesIO()
        w = warc.Writer(out)
        for r in held:
            w.add(r)
        w.close()
        assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == held and out.getvalue()[4:8] != b"\0\0\0\0"
    with pytest.raises(ValueError):
        warc.facts(records[0].replace(b"payload 0", b"payload 1", 1))


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_sstable_round_trip(spark):
    texts = TEXTS + [f"word{k} " * (k % 50) for k in range(300)]
    ids = library_ids(texts)
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    docs = table(spark, [texts[k] for k in order], order).repartition(5)
    manifest = sstable.write(docs, common.scratch(spark, "sst"))
    got = {r.doc_id: r for r in sstable.read(spark, manifest).collect()}
    base = 0
    for k, x in enumerate(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (base, len(x), zlib.crc32(x.tobytes()))
        base += len(x)
    again = sstable.write(table(spark, ["b", "a", None, "c"], [5, 5, None, -(2**63)]), common.scratch(spark, "sst"))
    assert [r.doc_id for r in sorted(sstable.read(spark, again).collect(), key=lambda r: r.start)] == [None, -(2**63), 5, 5]
    assert sstable.write(table(spark, []), common.scratch(spark, "sst")) == []


def test_sstable_lookup():
    out = io.BytesIO()
    w = sstable.Writer(out, block_bytes=200)
    r = random.Random(1)
    rows = sorted((r.randint(-500, 500), r.randint(0, 30)) for _ in range(400))
    for k, n in rows:
        w.add(sstable.key_of(k), np.arange(n, dtype="<u2").tobytes())
    w.close()
    reader = sstable.Reader(io.BytesIO(out.getvalue()))
    assert [(k, len(x)) for k, x in reader.scan()] == rows and len(reader.blocks) > 10
    for k in range(-520, 520):
        assert [len(x) for x in reader.get(k)] == [n for x, n in rows if x == k]
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(out.getvalue()[:-1]))


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    pieces = counts.model_pieces()
    rank = {p: k for k, p in reversed(list(enumerate(pieces)))}
    longest = max(map(len, pieces))

    def plain(word):
        s = counts.MARK + word
        best = [(0.0, 0)]
        for e in range(1, len(s) + 1):
            options = [(-math.inf, 0)]
            for b in range(max(0, e - longest), e):
                if s[b:e] in rank:
                    options.append((best[b][0] - math.log(rank[s[b:e]] + 2), best[b][1] + 1))
            if s[e - 1] not in rank:
                options.append((best[e - 1][0] - math.log(len(pieces) + 2) - 10, best[e - 1][1] + len(s[e - 1].encode())))
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        return best[-1][1]

    texts = [*TEXTS, "unbelievable thanedble ouèelle 中文 😀x the then there", "the then the"]
    got = {r.doc_id: r for r in counts.count(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split()
        assert (got[k].n_pretokens, got[k].n_distinct) == (len(words), len(set(words)))
        if len(t or "") < 1000:
            assert got[k].n_tokens == sum(map(plain, words))
    tree = counts.Trie(pieces)
    for w in ("there", "then", "the"):
        tree.pieces_of(w)
    assert len(tree.parent) == 1 + len("▁there") + 1  # shared prefixes are there once
    assert counts.count(table(spark, [])).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------


def plain_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        words = re.findall(r"\w+", (t or "").lower())
        bare = (t or "").strip()
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset([bare] if bare else []))
    links, label = [0] * len(texts), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and a and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return links, label


def near_copies(seed=7, groups=12, n=14):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(6, 150))]
        for _ in range(r.randint(1, n)):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = f"v{r.randint(0, 50)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join(spark, block, monkeypatch):
    if block == 4:  # nearly every key is hot, and nothing is broadcast whole
        monkeypatch.setattr(common, "JOIN_AT_ONCE", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(jaccard, "GONE_AT_ONCE", 0)
    texts = TEXTS + near_copies() + near_copies()[:5]
    links, label = plain_links(texts)
    got = {r.doc_id: r for r in jaccard.join(table(spark, texts), block=block).collect()}
    assert [(got[k].n_links, got[k].class_id) for k in range(len(texts))] == list(zip(links, label))
    if block == 4:
        kept = sorted(r.doc_id for r in jaccard.deduplicated(table(spark, texts)).collect())
        assert kept == sorted(set(label))


def test_jaccard_join_of_odd_tables(spark):
    assert jaccard.join(table(spark, [])).count() == 0
    got = jaccard.join(table(spark, ["a b c d e f", "a b c d e f", "", None, "a b c d e f"], [None, 3, None, 4, 3])).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter({(None, 3, 2): 1, (3, 3, 2): 2, (None, None, 0): 1, (4, 4, 0): 1})


def test_members_of_large_components_are_sent_short(spark):
    """One component of near copies: how often, and with how many bytes, its members are shuffled."""
    r = random.Random(31)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for _ in range(600):
        words = list(base)
        for _ in range(2):
            words[r.randrange(len(words))] = f"v{r.randint(0, 10**6)}"
        texts.append(" ".join(words))
    links, label = plain_links(texts)
    got = {x.doc_id: x for x in jaccard.join(table(spark, texts), block=64).collect()}
    assert [(got[k].n_links, got[k].class_id) for k in range(len(texts))] == list(zip(links, label)) and len(set(label)) == 1
    members = spark.createDataFrame([(bytes([k % 256, k // 256]), 10) for k in range(600)], "node binary, blocks long")
    sent = jaccard._blocks(members, F.col("blocks"))
    assert sent.count() == 6000  # once per block: the rows grow with n * n / block
    sizes = [r.n for r in sent.groupBy("_p", "_q").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 55 and max(sizes) < 2 * 64 * 2
    sets = [jaccard.shingles(t) for t in texts]
    assert sum(len(np.setxor1d(sets[0], x)) for x in sets) < 0.25 * sum(map(len, sets))


def test_pruning_keeps_what_may_reach_the_threshold():
    for n in range(jaccard.STEP, jaccard.BANDS * jaccard.ROWS + 1, jaccard.STEP):
        m = jaccard.least_equal(n, 0.8, 1e-6)
        assert 0 < m < 0.8 * n and m >= jaccard.least_equal(n, 0.8, 1e-9)


# --- 8 ------------------------------------------------------------------------------------------------------------


def plain_entities(t):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_entities_against_the_plain_patterns():
    r = random.Random(11)
    for letters, n in (("a1@.-+ ()x%_é", 4000), ("0123456789 -", 4000), ("12+.() -a", 4000), ("a@b.@.", 4000)):
        for _ in range(n):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert pii.entities(t) == plain_entities(t), t
    assert [k for *_, k in pii.entities("4111 1111 1111 1111, 8.8.8.8 or a@b.co, +1 (743) 555-3824")] == [2, 1, 0, 3]
    assert pii.entities("1" * 200_000 + "a" * 200_000 + "@" * 1000) == []


@pytest.mark.parametrize("at_once", [pii.TERMS_AT_ONCE, 0])
def test_pii_report_and_terms(spark, monkeypatch, at_once):
    monkeypatch.setattr(pii, "TERMS_AT_ONCE", at_once)
    r = random.Random(5)
    words = [f"w{k}" for k in "abcdefghij"]
    fill = lambda n: " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(n))
    texts = TEXTS + [f"{fill(30)} kontakt {fill(1)} u{k}@x.example.com {fill(30)}" for k in range(30)] + [fill(60) for _ in range(100)] + words
    got = {x.doc_id: x for x in pii.report(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        base = plain_entities(t or "")
        names = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, e, kind in base)
        assert got[k].base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert [got[k][f"n_{n}"] for n in pii.KINDS] == [sum(x == i for *_, x in base) for i in range(4)]
        spans = [x for x in got[k].spans.split(",") if x]
        assert [x for x in spans if not x.startswith("term")] == [x for x in names.split(",") if x]
        terms = [x.split(":") for x in spans if x.startswith("term")]
        assert all((t or "")[int(s) : int(e)] == "kontakt" for _, s, e in terms)
        assert bool(terms) == ("kontakt" in (t or ""))
    clean = {x.doc_id: x.text for x in pii.sanitised(table(spark, texts)).collect()}
    assert clean[0] is None and clean[4] == TEXTS[4] and "[EMAIL]" in clean[9] and "[PHONE]" in clean[9]
    assert not any("@" in (t or "") or "kontakt" in (t or "") for t in clean.values())
    assert pii.report(table(spark, [])).count() == 0


def test_pii_terms_of_fields_and_of_copies(spark):
    r = random.Random(6)
    fill = lambda n: " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(n))
    # A field alone on its line, in one context with many numbers; and one document, copied, that holds a term far from entities too.
    fields = [f"{fill(60)}\nTelefon: +1 (743) 555-{1000 + k}\n{fill(60)}" for k in range(20)]
    copied = [f"{fill(20)} rapport u{k}@x.example.com {fill(20)}" for k in range(10)]
    texts = fields + copied + [f"{' rapport alpha' * 5} {fill(20)} rapport v@x.example.com {fill(20)}"] * 40 + [fill(60)] * 30
    got = {tuple(x) for x in pii.revealing(table(spark, texts)).collect()}
    assert (3, "telefon") in got and (0, "rapport") not in got
    # All of its occurrences stand next to entities, most of them in copies of one document.
    texts = [f"{fill(20)} kontakt u{k}@x.example.com {fill(20)}" for k in range(10)] + [f"{fill(20)} kontakt w@x.example.com {fill(20)}"] * 200 + [fill(60)] * 30
    assert {tuple(x) for x in pii.revealing(table(spark, texts)).collect()} == {(0, "kontakt")}
    alone = ["Telefax: +1 (743) 555-1234"] * 30 + [fill(60)] * 30
    assert pii.revealing(table(spark, alone)).count() == 0  # copies of one window aren't support


def plain_revealing(texts, support=pii.SUPPORT):
    """Document terms, by plain counts."""
    units: dict = {}
    for t in sorted({t or "" for t in texts}, key=pii._hash):
        found = plain_entities(t)
        terms = {pii.term_of(m[0]) for m in re.finditer(r"[^\W_]+", t) if all(m.end() <= s or m.start() >= e for s, e, _ in found)}
        units.setdefault((bool(found), tuple(sorted({t[s:e] for s, e, _ in found})) if found else t), ({k for *_, k in found} | ({pii.ANY} if found else set()), terms))
    n = len(units) + 1
    n_t = Counter(t for _, terms in units.values() for t in terms)
    n_k = Counter(k for kinds, _ in units.values() for k in kinds)
    n_tk = Counter((k, t) for kinds, terms in units.values() for k in kinds for t in terms)
    tried = {t for (k, t), c in n_tk.items() if c >= support and k == pii.ANY}
    out = set()
    for (k, t), c in n_tk.items():
        p, q = n_k[k] / n, c / n_t[t]
        if c >= support and q > p and math.log(q / p) / -math.log(p) >= pii.DISCLOSURE:
            if n_t[t] * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) >= math.log(len(tried) / pii.CHANCE):
                out.add(t)
    return out


@pytest.mark.parametrize("at_once", [pii.TERMS_AT_ONCE, 0])
def test_pii_document_terms_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(pii, "TERMS_AT_ONCE", at_once)
    r = random.Random(15)
    fill = lambda n: " ".join(r.choice([f"w{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(12)]) for _ in range(n))
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(24)) + "0f"
    texts = TEXTS + [fill(30) for _ in range(500)]
    for k in range(60):
        personal = r.choice([f"u{k}@x.example.com", f"+1 (743) 555-{1000 + k}", f"10.0.{k}.7", ""])
        texts.append(f"{fill(10)} secret = {code()} {fill(20)} {personal} {fill(5)} {'maybe' if r.random() < 0.5 else ''}")
    texts += [fill(10) + " maybe"] * 9 + [fill(8) + f" maybe {k}" for k in range(200)]
    texts += [f"{fill(20)} rare x@copied.example.com {fill(3)}" for _ in range(50)]  # near copies with one address: one document
    found = {(x.kind, x.term) for x in pii.revealing(table(spark, texts)).collect()}
    want = plain_revealing(texts)
    assert {t for k, t in found if k == pii.ANYWHERE} == want and {"secret", "#x:26"} <= want and not {"maybe", "rare"} & want
    docs = table(spark, texts + ["no address, but secret = " + code()])
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    assert got[len(texts)].n_terms == 2 and got[len(texts)].n_spans == 2 and got[5].n_spans == 0 and all(x.n_spans == len([y for y in x.spans.split(",") if y]) for x in got.values())
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert clean[len(texts)] == "no address, but  = [CODE]" and clean[12] == texts[12]


def test_pii_windows_of_long_words_and_lines(spark):
    word, text = "q" * 200, "tel\n" + "q" * 200 + "\na.b@c.example.com, der rest steht hier"
    found = pii.entities(text)
    words = list(pii.terms_in(text, found))
    ((kind, close),) = pii.around(found, words)
    assert kind == 0 and [w for w, _, _ in close] == ["tel", word, "der", "rest", "steht"]


# --- 9 ------------------------------------------------------------------------------------------------------------


def tune(seed, n=80, rate=4000, noise=0.0, lead=0):
    import wave

    r = np.random.default_rng(seed)
    t = np.arange(round(audio.HOP_S * rate)) / rate
    x = np.concatenate([np.zeros(lead), *[np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in r.integers(0, 24, n)]])
    x = x + noise * np.random.default_rng(seed + 99).normal(size=len(x))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 8000).clip(-32767, 32767).astype("<i2").tobytes())
    return out.getvalue()


def searched(rows):
    """Of each recording (class, integers), and of each class of queries its matches."""
    own = {r.vec_id: r for r in rows if r.match_id is None}
    matches: dict = {}
    for r in rows:
        if r.match_id is not None:
            assert r.vec_id == r.class_id
            matches.setdefault(r.class_id, {})[r.match_id] = r
    return own, matches


@pytest.mark.parametrize("at_once", [common.JOIN_AT_ONCE, 0])
def test_audio_search(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "JOIN_AT_ONCE", at_once)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    late = round(audio.HOP_S * 4000) * 10
    rows = [(0, tune(1)), (1, tune(1, noise=0.05)), (2, tune(2)), (3, tune(1, lead=late)), (4, tune(1)), (5, None), (6, b"no wave"), (7, b""), (None, tune(1)), (50, tune(2)), (100, None)]
    media = spark.createDataFrame(rows, "vec_id long, audio binary").withColumn("q", F.lit(1)).withColumn("fp", F.lit("x"))
    own, matches = searched(audio.search(media).collect())
    assert len(own) == len(rows) and own[4].class_id == own[0].class_id == own[None].class_id == 0 and set(matches) == {0, 2}
    found = matches[0]
    assert set(found) == {0, 1, 3} and found[0].errors == 0 and found[0].offset == 0 and found[3].offset == 10
    assert set(matches[2]) == {2} and own[50].class_id == 2
    assert own[100].class_id is None and own[5].class_id is None and own[6].n_integers == 0
    assert audio.search(media.limit(0)).count() == 0


def test_audio_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audio, "BLOCK", 300)
    rows = [(50 * k, tune(k)) for k in range(8)]
    rows += [(50 * k + j, tune(k, noise=noise, lead=lead, n=n)) for k in range(8) for j, (noise, lead, n) in enumerate([(0.6, 0, 80), (0.7, 0, 80), (0.8, 5120, 80), (0.7, 0, 60), (0.4, 200, 130)], 1)]
    _, got = searched(audio.search(spark.createDataFrame(rows, "vec_id long, audio binary")).collect())
    fps = {i: audio.fingerprint(raw) for i, raw in rows}
    found = []
    for q in range(0, 400, 50):
        want = []
        for c, fp in sorted(fps.items()):
            options = []
            for offset in range(-len(fps[q]), len(fp) + 1):
                errors, bits = audio.align(fps[q], fp, offset)
                if bits and bits * 2 >= 32 * min(len(fp), len(fps[q])) and errors <= 0.2 * bits:
                    options.append((errors / bits, abs(offset), offset, errors, bits))
            want += [(c, *min(options)[2:])] if options else []
        assert [(m.match_id, m.offset, m.errors, m.bits) for _, m in sorted(got[q].items())] == want
        found += [m for m in want if m[2]]
    assert sum(m[2] > 0.1 * m[3] for m in found) >= 8  # noisy ones, whose integers are hardly ever equal


def test_audio_widths():
    import wave

    t = np.arange(512) / 4000
    x = sum(np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in np.random.default_rng(v).integers(0, 24, 60)]) for v in range(3)) / 8
    prints = []
    for width in (1, 2, 3, 4):
        raw = (np.round(x * 2 ** (8 * width - 1)).astype(np.int64) + (128 if width == 1 else 0)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(4000)
            w.writeframes(np.repeat(raw, 2, axis=0).tobytes())
        samples, rate = audio.decode(out.getvalue())
        assert rate == 4000 and len(samples) == len(x) and np.abs(samples / 32768 - x).max() < 2.0 ** (1 - 8 * width) + 2e-5
        prints.append(audio.fingerprint(out.getvalue()))
    assert all(audio.align(prints[1], p, 0)[0] < 0.1 * 32 * len(p) for p in prints)


def test_audio_filters_against_plain_sums():
    c = audio.chroma(*audio.decode(tune(3)))
    fp = audio.fingerprint(tune(3))
    assert len(fp) == len(c) - audio.WIDTH + 1
    for at in (0, 7, len(fp) - 1):
        value = 0
        for kind, y, h, w in audio.filters():
            b = c[at : at + w, y : y + h]
            top, late = b[:, h // 2 :].sum(), b[w // 2 :].sum()
            if kind == 0:
                pair = top, b.sum() - top
            elif kind == 1:
                pair = late, b.sum() - late
            elif kind == 2:
                x = b[: w // 2, : h // 2].sum() + b[w // 2 :, h // 2 :].sum()
                pair = x, b.sum() - x
            else:
                x = b[w // 3 : w - w // 3].sum()
                pair = x, b.sum() - x
            level = int(np.searchsorted(audio.LIMITS, np.log((pair[0] + 0.01) / (pair[1] + 0.01))))
            value = value << 2 | level ^ level >> 1
        assert value == int(fp[at])


def test_audio_of_vectors(spark):
    v = spark.createDataFrame([(0, [0.1 * k for k in range(64)]), (1, None), (2, []), (3, [None] * 64)], "vec_id long, embedding array<float>")
    got, matches = searched(audio.search(audio.rendered(v)).collect())
    assert set(matches) == {0} and got[0].n_integers > 30 and got[1].n_integers == 0 and got[3].n_integers > 30


# --- 10 -----------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "Anna has 12 apples and buys 30 more at the market near Berlin for 4 km of walking before Anna counts 12 apples again"
    other = item.replace("12", "17").replace("Anna", "Peter").replace("30", "45")
    broken = item.replace("12", "17", 1).replace("30", "45")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "a quiet river runs over the old stones"), (5, item)], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("windows", F.lit(1))
    filler = "some other words stand here in a row and mean nothing at all"
    texts = [*TEXTS, f"{filler}. {item}. {filler}", f"{filler}, then {other} {filler}", f"{filler} then {broken} {filler}", "so A quiet river runs over the old stones ok", " ".join(item.split()[:9]), item]
    n = len(TEXTS)
    got = decontaminate.find(table(spark, texts), bench).collect()
    by = {(r.doc_id - n, r.item_id): r for r in got}
    assert set(by) == {(0, 1), (0, 5), (1, 1), (1, 5), (3, 4), (5, 1), (5, 5)}
    assert by[0, 1].changed_slots == 0 and by[1, 1].changed_slots > 0 and by[5, 1].start_word == 0
    kept = {r.doc_id - n for r in decontaminate.clean(table(spark, texts), bench).collect()}
    assert kept >= {-1, -10, 2, 4} and not kept & {0, 1, 3, 5}
    assert decontaminate.find(table(spark, []), bench).count() == 0
    assert decontaminate.find(table(spark, texts), bench.limit(0)).count() == 0


def test_items_without_template_windows(spark):
    items = [(1, "Anna Bell has 12 kg and 30 km and 4 hours"), (2, "Compute 12 + 30 * 4 - 17 / 3 and 9"), (3, "what is love"), (4, "12 30 4 17 3 9 11 12 13"), (5, "Qwertz"), (6, "Anna picks nine red apples near old stones today"), (7, " . "), (8, "a quiet river runs")]
    texts = ["so Anna Bell has 12 kg and 30 km and 4 hours ok", "Peter Low has 1 kg and 3 km and 9 hours", "then compute 12 + 30 * 4 - 17 / 3 and 9", "Compute 1 + 3 * 8 - 7 / 5 and 2", "I ask: What is Love?", "12 30 4 17 3 9 11 12 13", "1 2 3 4 5 6 7 8 9"]
    texts += ["a qwertz b", "what is", "There. Peter picks nine red apples near old stones today", "see a Quiet river, runs", "Anna Bell has 12 kg", "x" * 200 + " word " * 3000 + "what is love" + " word" * 3000]
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.find(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1): 0, (1, 1): 4, (2, 2): 0, (3, 2): 6, (4, 3): 0, (5, 4): 0, (7, 5): 0, (9, 6): 1, (10, 8): 0, (12, 3): 0}


def test_every_verbatim_item_is_found():
    r = random.Random(3)
    words = "the red Anna Berlin 12 3.5 km hours runs over Old stones Paris 7 and kg".split()
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for k in range(300)]
    index = decontaminate.Index(items, 8)
    for k, text in items:
        for doc in (text, f"so it goes, {text}, then more", f"It ends. {text}. And so on"):
            assert k in {row[1] for row in decontaminate.search([0], [doc], index)}, (text, doc)


def test_search_against_brute_force():
    """Items without slots, so that consistency holds by itself: every alignment and every run of neighbouring ones is tried."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    pool = [word() for _ in range(30)]
    items = [(k, [r.choice(pool) for _ in range(r.choice([5, 6, 9, 14, 20, 30, 45]))]) for k in range(25)]
    docs = []
    for _ in range(150):
        own = [r.choice(pool) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            piece = list(r.choice(items)[1])
            lo, hi = sorted((r.randint(0, len(piece)), r.randint(0, len(piece))))
            piece = piece[lo:hi] if r.random() < 0.5 else piece
            for _ in range(r.randint(0, 4)):
                at = r.randint(0, len(piece))
                piece[at : at + 1] = r.choice([[], [word()], [word(), word()]])
            at = r.randint(0, len(own))
            own[at:at] = piece
        docs.append(own)

    def held(doc, item):
        reach, n = max(decontaminate.DRIFT, len(item) // 4), len(item)
        for size in decontaminate.widths(n, 8):
            met = [(d - p, p) for p in range(n - size + 1) for d in range(len(doc) - size + 1) if doc[d : d + size] == item[p : p + size]]
            for low in {a for a, _ in met}:
                for places in ({p for a, p in met if a == low}, {p for a, p in met if low <= a <= low + reach}):
                    covered = size >= 8 or len({p + k for p in places for k in range(size)}) >= min(8, n)
                    if covered and len(places) >= 0.3 * (n - size + 1):
                        return True
        return False

    want = {(d, k) for d, doc in enumerate(docs) for k, item in items if held(doc, item)}
    index = decontaminate.Index([(k, " ".join(item)) for k, item in items], 8)
    got = {(row[0], row[1]) for row in decontaminate.search(list(range(len(docs))), [" ".join(d) for d in docs], index)}
    assert got == want and 40 < len(want) < 2000


def test_many_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 30)
    items = [(k, " ".join(f"t{k}x{j}" for j in range(20))) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(table(spark, [t for _, t in items] + ["none"]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(9)}


def test_edited_items_are_found(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))

    def changed(t, drop):
        w = t.split()
        for k in (2 * len(w) // 3, len(w) // 3):
            w[k : k + drop] = [] if drop else ["extra"]
        return " ".join(w)

    items = [" ".join(word() for _ in range(n)) for n in (15, 20, 30, 45, 60)]
    bench = spark.createDataFrame([*enumerate(items), (9, "so Anna has 12 red apples and then buys 30 green ones near old Berlin")], "item_id long, text string")
    filler = " ".join(word() for _ in range(30))
    texts = [f"{filler} {changed(t, drop)} {filler}" for drop in (0, 1) for t in items]
    texts += [f"{filler} so Mary Ann Lee has 1,200 red apples and then buys 3.5 green ones near old New York {filler}", " ".join(items[3].split()[:7]) + " " + filler, filler]
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find(table(spark, texts), bench).collect()}
    assert set(got) == {(k, k % 5) for k in range(10)} | {(10, 9)}
    assert all(got[k, k % 5].start_word == 30 for k in range(10))
    assert (got[10, 9].slots, got[10, 9].changed_slots) == (4, 4) and got[10, 9].coverage == 1


def test_clean_with_null_and_repeated_identifiers(spark):
    item = "a quiet river runs over the old stones near the mill and the green hill"
    texts = [item, "nothing of it", None, f"so {item} again", "nothing here", item, "", "nothing of it"]
    docs = table(spark, texts, [None, None, None, 7, 7, 8, 8, 9])
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, "nothing of it"), (None, None), (7, "nothing here"), (8, ""), (9, "nothing of it")])
