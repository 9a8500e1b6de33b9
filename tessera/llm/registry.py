"""Queries of this subpackage and their SQL. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, common, counts, decontaminate, jaccard, licences, packing, pii, quality, sstable, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, common.table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = quality.classify(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")), keep_text=False)
    digits = lambda c: F.round(c, 6)  # noqa: E731  sums over shuffles differ in their last digits
    return found.select("doc_id", "source", "lang", digits("_evidence").alias("evidence"), digits("_host_posterior").alias("host_posterior"), digits("_path_posterior").alias("path_posterior"), digits("_posterior").alias("posterior"), F.col("_keep").alias("keep"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc")))


def op5_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(spark, sstable.write(common.table(spark, sf_dir, "documents"), common.scratch(spark, "sstable")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(common.table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.search(audio.rendered(common.table(spark, sf_dir, "embeddings")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_licence_scan, op4_warc, op5_token_sstable, op6_token_counts, op7_jaccard_join, op8_pii, op9_audio_fingerprints, op10_decontaminate)}


def _licence_sql() -> str:
    known = licences.templates()
    keys = ",".join(f"({t['n']},{t['at'] + k},'{w}',{len(t['key'])})" for t in known for k, w in enumerate(t["key"]))
    words = ",".join(f"({t['n']},{k},'{w}',{len(t['words'])},'{t['label']}',{str(t['base']).lower()})" for t in known for k, w in enumerate(t["words"]))
    return (
        "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w<>'') AS ws FROM documents),"
        " tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws,1)-1 AS i FROM d),"
        f" k(t,k,w,n) AS (VALUES {keys}), v(t,k,w,n,label,base) AS (VALUES {words}),"
        " f AS (SELECT doc_id, t, i-k AS s FROM tok JOIN k USING (w) GROUP BY ALL HAVING count(*)=any_value(n)),"
        " g AS (SELECT f.doc_id, f.t, f.s, v.label, v.base, count(tok.w)/any_value(v.n)::DOUBLE AS share FROM f JOIN v ON v.t=f.t LEFT JOIN tok ON tok.doc_id=f.doc_id AND tok.i=f.s+v.k AND tok.w=v.w GROUP BY ALL),"
        " x AS (SELECT doc_id, count(*) FILTER (base) AS nb, min(s) FILTER (base) AS a, max(s) FILTER (base) AS b, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR share>=0.7) AS al, max(share) FILTER (NOT base) AS m FROM g GROUP BY doc_id)"
        " SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(nb,0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(bl,'') AS base_labels, coalesce(al,'') AS labels, greatest(coalesce(m,0.0),CASE WHEN coalesce(nb,0)>0 THEN 0.5 ELSE 0.0 END) AS score FROM d LEFT JOIN x ON x.doc_id=d.doc_id"
    )


_B32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',(((('0x'||substr(h,{5 * g + 1},5))::INT >> {15 - 5 * k}) & 31)+1)::INT,1)" for g in range(8) for k in range(4))
_WARC_SQL = f"WITH p AS (SELECT page_id, coalesce(html,'') AS t, sha1(coalesce(html,'')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h) SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id=first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>first THEN first END AS refers_to FROM p JOIN f USING (h)"
_JACCARD_SQL = (
    "WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text,'')),'[\\p{L}\\p{N}_]+') AS ws, regexp_replace(coalesce(text,''),'^\\s+|\\s+$','','g') AS bare FROM documents),"
    " t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws,1) AS i FROM d),"
    " l AS (SELECT doc_id, w||' '||lead(w,1) OVER o||' '||lead(w,2) OVER o||' '||lead(w,3) OVER o||' '||lead(w,4) OVER o AS sh FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),"
    " s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM l WHERE sh IS NOT NULL UNION SELECT doc_id, array_to_string(ws,' ') FROM d WHERE len(ws) BETWEEN 1 AND 4 UNION SELECT doc_id, ' '||bare FROM d WHERE len(ws)=0 AND bare<>''),"
    " n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),"
    " e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh=y.sh AND x.doc_id<>y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id=a JOIN n q ON q.doc_id=b WHERE 9*c >= 4*(p.n+q.n)),"
    " r(a,b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b=e.a)"
    " SELECT d.doc_id, least(d.doc_id, coalesce(m,d.doc_id)) AS class_id, coalesce(k,0)::BIGINT AS n_links FROM d LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) y ON y.a=d.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) z ON z.a=d.doc_id"
)
ORACLE_SQL: dict[str, str] = {"op3_licence_scan": _licence_sql(), "op4_warc": _WARC_SQL, "op7_jaccard_join": _JACCARD_SQL}
