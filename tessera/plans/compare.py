"""The comparison of documents a with documents b, as one plan.

``scope`` is a column that holds pairs of documents apart: the statistics, candidates and ranks of one scope don't see
another's. Comparing two files is one scope; checking many pairs is as many scopes in the same plan."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, with_settings
from ..functions import models, scores, spans, text
from ..functions.align import tiles
from ..operators import bm25, candidates, segment, simhash, summary
from ..sources import docx, report
from ..store import root, written


def prepared(docs: DataFrame, cfg: Config, embedder: models.Embedder, side: str) -> DataFrame:
    """Chunks of documents (scope, text): ids, views, tokens' features, each computed once per chunk."""
    cut = segment.chunks(docs, cfg.size_tokens, cfg.overlap, cfg.mode == "paragraph", cfg.section_headers, key="scope")
    how = text.Retrieval(
        dict(cfg.abbreviations) if cfg.abbreviations_expand else {},
        dict(cfg.synonyms) if cfg.synonyms_expand else {},
        cfg.stop_phrases if cfg.remove_stop_phrases else (),
        cfg.boilerplate if cfg.remove_boilerplate else (),
        cfg.lowercase,
        cfg.unicode_normalize,
        cfg.strip_zero_width,
    )
    views = cut.withColumn("align", text.align_form(F.col("disp"), cfg.lowercase, cfg.mask_numbers, cfg.strip_zero_width)).withColumn("retr", text.retrieval_form(F.col("disp"), how))
    full = views.select(
        "scope",
        F.col("chunk_id").alias(f"{side}_id"),
        "disp",
        "align",
        "retr",
        "char_start",
        "char_end",
        simhash.simhash(F.col("retr")).alias("simhash"),
        models.embed(F.col("retr"), embedder).alias("emb"),
        F.array_distinct(text.char_ngrams(F.col("retr"), 5)).alias("grams"),
        scores.phrase_hits(F.col("disp"), cfg.boilerplate, True).alias("boiler"),
        scores.phrase_hits(F.col("retr"), cfg.stop_phrases, False).alias("stops"),
        scores.pattern_count(F.col("disp"), cfg.citation_patterns).alias("cites"),
    )
    return written(full, f"chunks_{side}")


def vector_topk(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k inside each scope."""
    from pyspark.sql import Window

    met = a.select("scope", "a_id", F.col("emb").alias("x")).join(b.select("scope", "b_id", F.col("emb").alias("y")), "scope")
    scored = met.select("scope", "a_id", "b_id", F.round(scores.cosine(F.col("x"), F.col("y")), 9).alias("score"))
    w = Window.partitionBy("scope", "a_id").orderBy(F.desc("score"), "b_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matches(docs_a: DataFrame, docs_b: DataFrame, cfg: Config, embedder: models.Embedder | None = None, scorer: models.PairScorer | None = None, log: report.JsonLog | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: (scope, text). Returns match records (scope and the report's fields), and the chunks of both sides. What several steps read is written
    once in the scratch folder."""
    embedder, scorer, log = embedder or models.HashedGrams(), scorer or models.WordOverlap(), log or report.JsonLog(None)
    with log.section("chunking"):
        a, b = prepared(docs_a, cfg, embedder, "a"), prepared(docs_b, cfg, embedder, "b")
    scope = ("scope",)
    with log.section("indexes"):
        lexical = written(bm25.scores(a, b, "a_id", "b_id", F.col("retr"), F.col("retr"), scope).select("scope", "a_id", "b_id", "score"), "lexical")
    by_bm25 = bm25.topk(a, b, "a_id", "b_id", F.col("retr"), F.col("retr"), cfg.bm25_topk, scope, scored=lexical)
    by_hash = simhash.topk(a, b, "a_id", "b_id", "simhash", cfg.simhash_topk, scope)
    by_vector = vector_topk(a, b, cfg.topk_recall)
    most = max(cfg.bm25_topk, cfg.simhash_topk, cfg.topk_recall)
    found = candidates.union_cut([by_bm25, by_hash, by_vector], "a_id", "b_id", most, scope, cfg.candidate_cut == "score")
    left = a.select("scope", "a_id", *[F.col(c).alias(f"a_{c}") for c in ("simhash", "emb", "grams", "boiler", "stops", "cites")])
    right = b.select("scope", "b_id", *[F.col(c).alias(f"b_{c}") for c in ("simhash", "emb", "grams", "boiler", "stops", "cites")])
    met = found.join(left, ["scope", "a_id"]).join(right, ["scope", "b_id"]).join(lexical.withColumnRenamed("score", "bm25_raw"), ["scope", "a_id", "b_id"], "left")
    base = scores.lexical_base(scores.jaccard(F.col("a_grams"), F.col("b_grams")), scores.hamming_similarity(F.col("a_simhash"), F.col("b_simhash")))
    lex = scores.penalised(base, scores.shared_hits(F.col("a_boiler"), F.col("b_boiler")), scores.shared_hits(F.col("a_stops"), F.col("b_stops")), scores.citation_penalty(F.col("a_cites"), F.col("b_cites")), cfg.penalties)
    feats = met.select("scope", "a_id", "b_id", F.round(scores.cosine(F.col("a_emb"), F.col("b_emb")), 9).alias("bi"), F.round(lex, 9).alias("lex"), F.coalesce("bm25_raw", F.lit(0.0)).alias("bm25_raw"))
    feats = candidates.prefilter(feats, "a_id", "b_id", scope, least_bi=cfg.prefilter_bi, least_lex=cfg.prefilter_lex)
    feats = written(feats, "features")
    gate = candidates.gated(feats, "a_id", "b_id", scope, most=cfg.topk_rerank, low=cfg.ce_min_bi, high=cfg.ce_max_bi)
    texts_a, texts_b = (df.select("scope", f"{s}_id", F.col("disp").alias(f"{s}_disp"), F.col("align").alias(f"{s}_align"), F.array("char_start", "char_end").alias(f"{s}_doc")) for df, s in ((a, "a"), (b, "b")))
    judged = gate.join(texts_a, ["scope", "a_id"]).join(texts_b, ["scope", "b_id"]).withColumn("cross", models.pair_score(F.col("a_disp"), F.col("b_disp"), scorer))
    scored = candidates.join_back(feats, judged, ["scope", "a_id", "b_id"])
    fused = scored.withColumn("score", scores.fuse(F.col("cross"), F.col("bi"), F.col("lex"), F.col("bm25_raw"), cfg.weights))
    top = candidates.best(fused, "a_id", "b_id", F.round("score", 9), cfg.keep_per_chunk, scope)
    placed = written(top.join(texts_a, ["scope", "a_id"]).join(texts_b, ["scope", "b_id"]).withColumn("tiles", tiles(F.col("a_align"), F.col("b_align"), cfg.min_len_local)), "tiles")
    covered = lambda s: spans.coverage(spans.spans_of(F.col("tiles"), s), F.length(f"{s}_align"))
    thin = F.greatest(covered("a"), covered("b")) < cfg.semantic_min_coverage
    if cfg.semantic_enabled:
        # The dear step sees only the pairs that need it.
        some = placed.where(thin).withColumn("tiles", F.concat("tiles", models.sentence_pairs(F.col("a_disp"), F.col("b_disp"), embedder, cfg.semantic_threshold, cfg.semantic_topk)))
        placed = placed.where(~thin).unionByName(some)
    kept = placed.withColumn("pairs", spans.suppressed(F.col("tiles"), cfg.iou_threshold))
    rule = lambda s: spans.passes_rule(spans.spans_of(F.col("pairs"), s), cfg.min_span_chars, cfg.small_span_chars, cfg.min_small_spans)
    side = lambda s: F.struct(F.col(f"{s}_disp").alias("text"), F.transform(spans.spans_of(F.col("pairs"), s), lambda x: F.array(x["s"], x["e"])).alias("spans"), F.col(f"{s}_doc").alias("char_span_in_doc"), spans.snippets(F.col(f"{s}_disp"), spans.spans_of(F.col("pairs"), s), cfg.snippet_context_chars).alias("snippets"))
    records = kept.where(rule("a") & rule("b")).select(
        "scope",
        F.col("a_id").alias("a_chunk_id"),
        F.col("b_id").alias("b_chunk_id"),
        "score",
        scores.level(F.col("score")).alias("level"),
        F.struct("cross", "bi", "lex", "bm25_raw").alias("scores"),
        side("a").alias("a"),
        side("b").alias("b"),
    )
    return records, a, b


def compare(spark: SparkSession, path_a: str, path_b: str, out: str | None = None, cfg: Config | None = None, hardware: dict | None = None, embedder: models.Embedder | None = None, scorer: models.PairScorer | None = None) -> dict:
    """Compares two DOCX files; writes out.json, out.html and the stages' times as out.log.jsonl if out is given, and returns the report."""
    cfg = cfg or Config()
    log = report.JsonLog(f"{out}.log.jsonl" if out else None)
    with log.section("read_docs"):
        for p in (path_a, path_b):
            report.ensure_file(p)
        read = lambda p: written(docx.documents(docx.read(spark, p), cfg.keep_tables, cfg.ignore_sections).select(F.lit("0").alias("scope"), "text"), "docs")
        docs_a, docs_b = read(path_a), read(path_b)
    with log.section("match_rerank_align"):
        records, a, b = matches(docs_a, docs_b, cfg, embedder, scorer, log)
        records = written(records, "records")
    with log.section("aggregate"):
        rows = [r.asDict(True) for r in records.drop("scope").orderBy("a_chunk_id", F.desc("score"), "b_chunk_id").collect()]  # at most keep_per_chunk a chunk of one document
        one = summary.summary(records, a, b).first().asDict()
    made = {"chunks_A": one["chunks_A"], "chunks_B": one["chunks_B"], "pairs": one["pairs"], "levels": {n: one[n] for n in summary.NAMES}}
    models_used = {"embedder": (embedder or models.HashedGrams()).name, "scorer": (scorer or models.WordOverlap()).name, "neural": bool(embedder and scorer)}
    meta = {k: v for k, v in asdict(cfg).items() if k != "raw"} | {"models": models_used}
    if out:
        report.write_json(f"{out}.json", made, rows, meta, hardware or {})
        report.write_html(f"{out}.html", made, rows)
    return {"summary": made, "pairs": rows, "meta": {"cfg": meta, "hw": hardware or {}}}


def compare_uploads(spark: SparkSession, a: tuple[str, bytes], b: tuple[str, bytes], out: str | None = None, cfg: Config | None = None, settings: dict | None = None, **how) -> dict:
    """Compares two uploaded files (name, bytes), with the overrides of a settings page. They are kept in the scratch folder, which executors see,
    and deleted whatever happens. Raises ValueError for a name that isn't a .docx one."""
    for name, _ in (a, b):
        if not name.lower().endswith(".docx"):
            raise ValueError(f"not a .docx file: {name}")
    cfg = with_settings(cfg or Config(), settings) if settings else cfg or Config()
    folder = f"{root(spark)}/upload-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(conf)
    try:
        paths = []
        for side, (_, raw) in (("a", a), ("b", b)):
            paths.append(f"{folder}/{side}.docx")
            sink = store.create(jvm.org.apache.hadoop.fs.Path(paths[-1]))
            try:
                sink.write(bytearray(raw))
            finally:
                sink.close()
        return compare(spark, *paths, out, cfg, **how)
    finally:
        store.delete(where, True)
