"""The registered queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import models, scores, spans, text
from .functions.align import blocks, tiles
from .operators import bm25, candidates, grams, segment, simhash, summary, vectors
from .sources import report
from .store import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Sample lists of this repository.
PHRASES = ("the and", "de la", "tion ", "of the")
HEADERS = ("released under", "licensed under", "of the and")
HEADINGS = ("as.", "es be.", "the.", "of.")
BOILERPLATE = ("of the", "de la", "und der", "released under the MIT License")
STOPS = ("the ", "and", "les ", "und")
CITATIONS = ("\\[[0-9]{1,3}\\]", "\\([0-9]{3,4}\\)", "from .{0,20}the")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# --- SQL pieces ---------------------------------------------------------------------------------------------------

_WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_TOK = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"
_ZW = "chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279)"
_HEX = "('0x'||substr(md5(gram),1,16))::UBIGINT"
_BITS = " + ".join(f"(CASE WHEN 2*sum(c*((v >> {k}) & 1)) >= sum(c) THEN {1 << k}::HUGEINT ELSE 0 END)" for k in range(64))


def _ws(c: str) -> str:
    return f"trim(regexp_replace({c},'{_WS}',' ','g'))"


def _sql_list(xs) -> str:
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _grams(n: int, key: str, src: str, pad: bool) -> str:
    t = "' '||t||' '" if pad else "t"
    return f"SELECT {key}, substr(t,i,{n}) AS gram FROM (SELECT {key}, t, unnest(range(1, length(t)-{n - 2})) AS i FROM (SELECT {key}, {t} AS t FROM {src}))"


_CTE = {
    "nd": f"SELECT doc_id, {_ws('lower(text)')} AS t FROM documents",
    "nb": f"SELECT item_id, {_ws('lower(text)')} AS t FROM benchmark",
    "td": f"SELECT doc_id, unnest(regexp_extract_all(t,'{_TOK}')) AS term FROM nd",
    "tb": f"SELECT item_id, unnest(regexp_extract_all(t,'{_TOK}')) AS term FROM nb",
    "pd": "SELECT doc_id, term, count(*) AS tf FROM td GROUP BY ALL",
    "pb": "SELECT item_id, term, count(*) AS qtf FROM tb GROUP BY ALL",
    "ld": f"SELECT doc_id, len(regexp_extract_all(t,'{_TOK}')) AS dl FROM nd",
    "size": "SELECT count(*) AS n, avg(dl) AS avgdl FROM ld",
    "raw": "SELECT term, count(*) AS df, ln(any_value(n)-count(*)+0.5)-ln(count(*)+0.5) AS raw, any_value(n) AS n, any_value(avgdl) AS avgdl FROM pd, size GROUP BY term",
    "idf": "SELECT term, df, CASE WHEN raw<0 THEN 0.25*(SELECT avg(raw) FROM raw) ELSE raw END AS idf, n, avgdl FROM raw",
    "bm": "SELECT item_id, doc_id, sum(qtf*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))) AS score FROM pb JOIN pd USING (term) JOIN idf USING (term) JOIN ld USING (doc_id) GROUP BY ALL",
    "bt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score,9) DESC, doc_id) AS rank FROM (SELECT b.item_id, d.doc_id, coalesce(score,0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm ON bm.item_id=b.item_id AND bm.doc_id=d.doc_id)) WHERE rank<=30",
    "gd": _grams(7, "doc_id", "nd", True),
    "gb": _grams(7, "item_id", "nb", True),
    "hd": f"SELECT nd.doc_id, coalesce(h,18446744073709551615::UBIGINT) AS h FROM nd LEFT JOIN (SELECT doc_id, ({_BITS})::UBIGINT AS h FROM (SELECT doc_id, count(*) AS c, {_HEX} AS v FROM gd GROUP BY doc_id, gram) GROUP BY doc_id) x ON x.doc_id=nd.doc_id",
    "hb": f"SELECT nb.item_id, coalesce(h,18446744073709551615::UBIGINT) AS h FROM nb LEFT JOIN (SELECT item_id, ({_BITS})::UBIGINT AS h FROM (SELECT item_id, count(*) AS c, {_HEX} AS v FROM gb GROUP BY item_id, gram) GROUP BY item_id) x ON x.item_id=nb.item_id",
    "hx": "SELECT item_id, doc_id, bit_count(xor(hb.h,hd.h))::BIGINT AS distance FROM hb CROSS JOIN hd",
    "ht": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM hx) WHERE rank<=50",
    "fd": f"SELECT DISTINCT doc_id, gram FROM ({_grams(5, 'doc_id', 'nd', False)})",
    "fb": f"SELECT DISTINCT item_id, gram FROM ({_grams(5, 'item_id', 'nb', False)})",
    "sd": "SELECT doc_id, count(*) AS na FROM fd GROUP BY 1",
    "sb": "SELECT item_id, count(*) AS nq FROM fb GROUP BY 1",
    "jx": "SELECT item_id, doc_id, i/(na+nq-i)::DOUBLE AS jac FROM (SELECT item_id, doc_id, count(*) AS i FROM fb JOIN fd USING (gram) GROUP BY ALL) JOIN sd USING (doc_id) JOIN sb USING (item_id)",
    "jt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(jac,9) DESC, doc_id) AS rank FROM jx) WHERE rank<=3",
    "ox": "SELECT item_id, doc_id, common/(dn+bn)::DOUBLE*2 AS bi, common/bn::DOUBLE AS held FROM (SELECT item_id, doc_id, count(*) AS common FROM pb JOIN pd USING (term) GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS dn FROM pd GROUP BY 1) USING (doc_id) JOIN (SELECT item_id, count(*) AS bn FROM pb GROUP BY 1) USING (item_id)",
    "ot": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bi,9) DESC, doc_id) AS rank FROM ox) WHERE rank<=50",
    "cu": "SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM (SELECT item_id, doc_id FROM bt UNION SELECT item_id, doc_id FROM ht UNION SELECT item_id, doc_id FROM ot)) WHERE n<=50",
    "feat": "SELECT cu.item_id, cu.doc_id, round(coalesce(bi,0.0),9) AS bi, coalesce(held,0.0) AS held, round(0.5*coalesce(jac,0.0)+0.5*(1-distance/64.0),9) AS lex, coalesce(score,0.0) AS bm25_raw FROM cu LEFT JOIN ox USING (item_id,doc_id) LEFT JOIN jx USING (item_id,doc_id) LEFT JOIN hx USING (item_id,doc_id) LEFT JOIN bm USING (item_id,doc_id)",
    "pre": "SELECT * EXCLUDE (good,anyg,n), CASE WHEN anyg THEN good ELSE n<=3 END AS eligible FROM (SELECT *, max(good) OVER (PARTITION BY item_id) AS anyg, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM (SELECT *, (bi>=0.30 OR lex>=0.20) AS good FROM feat))",
    "gate": "SELECT item_id, doc_id, held AS cross_s FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bi DESC, doc_id) AS n FROM pre WHERE eligible) WHERE n<=10 AND bi BETWEEN 0.25 AND 0.92",
    "scored": "SELECT pre.*, coalesce(cross_s,0.0) AS cross_score, least(1.0,greatest(0.0,0.55*coalesce(cross_s,0.0)+0.25*bi+0.15*lex+0.05*(1-exp(-greatest(bm25_raw,0.0)/10)))) AS score FROM pre LEFT JOIN gate USING (item_id,doc_id)",
    "top5": "SELECT *, CASE WHEN score>=0.82 THEN 'very_high' WHEN score>=0.72 THEN 'high' WHEN score>=0.60 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score,9) DESC, doc_id) AS rank FROM scored) WHERE rank<=5",
}


def _with(last: str, *names: str) -> str:
    """SQL with the pieces that it needs, in their order."""
    import re

    need: set[str] = set()
    todo = [last, *(_CTE[n] for n in names)]
    need.update(names)
    while todo:
        for n in re.findall(r"\b(" + "|".join(_CTE) + r")\b", todo.pop()):
            if n not in need:
                need.add(n)
                todo.append(_CTE[n])
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in _CTE.items() if n in need) + " " + last


# --- text ---------------------------------------------------------------------------------------------------------


def normalized(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return spread(table(spark, sf, name).select(key, "text")).select(key, text.normalize_whitespace(F.lower("text")).alias("t"))


@query(f"SELECT doc_id, md5(regexp_replace(lower(translate(text,{_ZW},'     ')),'\\p{{Nd}}','0','g')) AS h FROM documents")
def doc_normalize_align(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.align_form(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, md5({_ws('text')}) AS h FROM documents")
def doc_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text,'the and',' '),'of the',' '),'de la',' '),'tion ',' ')) AS h FROM documents")
def phrase_removal(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.remove_phrases(F.col("text"), PHRASES)).alias("h"))


@query("SELECT doc_id, md5(replace(strip_accents(text),'đ','d')) AS h FROM documents")
def accents_removed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.remove_accents(F.col("text"))).alias("h"))


def _mapped(t: str, pairs: dict[str, str]) -> str:
    """SQL for words replaced one key after another: twice each, as neighbours share the sign between them."""
    for k, v in pairs.items():
        for _ in range(2):
            t = f"regexp_replace({t},'(^|[^\\p{{L}}\\p{{N}}_])(?:{k})($|[^\\p{{L}}\\p{{N}}_])','\\1{v}\\2','gi')"
    return t


_WORDS = {"is": "are", "of": "from", "de": "von", "und": "and also"}


@query(f"SELECT doc_id, md5({_mapped('text', _WORDS)}) AS h FROM documents")
def word_map(spark, sf):
    how = text.WordMap(_WORDS)

    @F.pandas_udf("string")
    def mapped(s):
        return s.map(how, na_action="ignore")

    return table(spark, sf, "documents").select("doc_id", F.md5(mapped(F.col("text"))).alias("h"))


_RETRIEVED = _mapped(_mapped("lower(nfc_normalize(text))", {"is": "etc", "la": "den"}), {"etc": "and so on", "in": "within"})
for _p in ("under the ", "les ", "the ", "und der", "de "):
    _RETRIEVED = f"replace({_RETRIEVED},'{_p}',' ')"


@query(f"SELECT doc_id, md5({_ws(_RETRIEVED)}) AS h FROM documents")
def retrieval_view(spark, sf):
    """Of the decomposed texts, so that the composition is seen."""
    how = text.Retrieval({"is": "etc", "la": "den"}, {"etc": "and so on", "in": "within"}, ("the ", "under the ", "les "), ("de ", "und der"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.retrieval_form(text.nfc(F.col("text"), "NFD"), how)).alias("h"))


@query("SELECT page_id, md5(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;')) AS h FROM pages")
def html_escaped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("h"))


@query("SELECT doc_id, md5('stand-in||'||text) AS key FROM documents")
def content_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_key("stand-in", F.col("text")).alias("key"))


@query(f"SELECT doc_id, len(p)::BIGINT AS kept, md5(array_to_string(p,chr(10))) AS h FROM (SELECT doc_id, list_filter(list_transform(string_split(text,chr(10)), lambda x: lower(x)), lambda x: len(list_filter({_sql_list(HEADERS)}, lambda h: contains(x,h)))=0) AS p FROM documents)")
def ignore_lines_filter(spark, sf):
    from .sources.docx import ignore_sections

    p = ignore_sections(F.split("text", "\n"), HEADERS)
    return table(spark, sf, "documents").select("doc_id", F.size(p).cast("long").alias("kept"), F.md5(F.array_join(p, "\n")).alias("h"))


_LINES = (
    "l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line, generate_subscripts(string_split(text,chr(10)),1) AS n, len(string_split(text,chr(10))) AS m FROM documents),"
    f" k AS (SELECT *, sum(length(line)+1) OVER (PARTITION BY doc_id ORDER BY n)-length(line)-1 AS s, CASE WHEN trim(line)='' THEN 'blank' WHEN list_contains({_sql_list(HEADINGS)}, lower(trim(line))) THEN 'heading' ELSE 'text' END AS kind FROM l),"
    " b AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n),'blank') AS before FROM k),"
    " i AS (SELECT *, sum((kind='heading' OR (kind='text' AND before<>'text'))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM b)"
)


@query(
    f"WITH {_LINES} SELECT doc_id, (island-1)::INT AS block_no, md5(any_value(CASE WHEN kind='heading' THEN trim(line) END)) AS heading, count(*) AS n_lines, bool_or(kind='heading') AS is_heading,"
    " min(CASE WHEN kind='heading' THEN s+instr(line,trim(line))-1 ELSE s END)::INT AS char_start, max(CASE WHEN kind='heading' THEN s+instr(line,trim(line))-1+length(trim(line)) ELSE s+length(line)+(n<m)::INT END)::INT AS char_end FROM i WHERE kind<>'blank' GROUP BY doc_id, island"
)
def line_blocks(spark, sf):
    b = segment.blocks(table(spark, sf, "documents"), HEADINGS)
    trimmed = F.regexp_replace("text", "\n$", "")
    lines_in = F.length(trimmed) - F.length(F.replace(trimmed, F.lit("\n"), F.lit(""))) + 1
    return b.select("doc_id", "block_no", F.md5(F.when(F.col("is_heading"), F.col("text"))).alias("heading"), lines_in.cast("long").alias("n_lines"), "is_heading", F.col("start").alias("char_start"), F.col("end").alias("char_end"))


@query("SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s,'|')) AS h FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text,'[^.!?\\n]+[.!?]*'), lambda x: trim(x)), lambda x: x<>'') AS s FROM documents)")
def sentence_split(spark, sf):
    s = text.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("h"))


def _sentences_sql(keys: str, body: str, src: str, base: str = "0") -> str:
    """keys, and z: the sentences of a text as (s, b), the sentence and where it starts, base added."""
    return (
        f"SELECT {keys}, list_transform(list_filter(list_transform(range(1,len(p)+1), lambda i: {{'p': p[i], 's': trim(p[i],' '), 'b': base+coalesce(list_sum(n[1:i-1]),0)::BIGINT+n[i]-length(ltrim(p[i],' '))}}), lambda x: x.s<>'' AND regexp_matches(x.p,'^[^.!?\\n]')), lambda x: {{'s': x.s, 'b': x.b}}) AS z"
        f" FROM (SELECT *, list_transform(p, lambda x: length(x)) AS n FROM (SELECT {keys}, {base} AS base, regexp_extract_all({body},'[^.!?\\n]+[.!?]*|[.!?\\n]') AS p FROM {src}))"
    )


@query("SELECT conv_id, turn, len(z)::BIGINT AS n, array_to_string(list_transform(z, lambda x: x.b||':'||(x.b+length(x.s))),',') AS places FROM (" + _sentences_sql("conv_id, turn", "text", "conversations") + ")")
def sentence_offsets(spark, sf):
    s = segment.sentences_with_offsets(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("places"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, round(coalesce(list_avg(list_transform(t, lambda x: length(x))),0),6) AS mean_length FROM (SELECT doc_id, regexp_extract_all(text,'{_TOK}') AS t FROM documents)")
def token_stats(spark, sf):
    t = text.tokens(F.col("text"))
    total = F.aggregate(t, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), r6(F.when(F.size(t) > 0, total / F.size(t)).otherwise(F.lit(0.0))).alias("mean_length"))


_CHUNK_TOKEN = "[\\p{L}\\p{M}\\p{N}_]+|[^\\s\\p{L}\\p{M}\\p{N}_]"


def _chunks_sql(sentences: str, key: str, extra: str = "") -> str:
    """Greedy chunks of each key's sentences: t (s, b, m, n, c: sentences, starts, their number, tokens and running sums) and w (no, i, j: a chunk holds sentences i+1 to j)."""
    return (
        f"WITH RECURSIVE {extra} s AS MATERIALIZED (SELECT *, list_transform(z, lambda x: len(regexp_extract_all(x.s,'{_CHUNK_TOKEN}'))) AS n FROM ({sentences})),"
        f" t AS MATERIALIZED (SELECT *, len(z) AS m, list_transform(range(0,len(z)+1), lambda k: coalesce(list_sum(n[1:k]),0)) AS c FROM s WHERE len(z)>0),"
        f" w({key}, no, i, j) AS (SELECT {key}, 0, 0, list_max(list_filter(range(1,m+1), lambda k: c[k+1]<=260 OR c[k]=0)) FROM t"
        f" UNION ALL SELECT {key}, no+1, ni, list_max(list_filter(range(ni+1,m+1), lambda k: c[k+1]-c[ni+1]<=260 OR c[k]=c[ni+1])) FROM (SELECT w.{key}, no, m, c, coalesce(list_min(list_filter(range(i+1,j+1), lambda k: c[k+1]-c[i+1]>=210)), i+1) AS ni FROM w JOIN t ON t.{key}=w.{key} WHERE j<m))"
    )


_CHUNK_COLS = "(z[i+1].b)::INT AS char_start, (z[j].b+length(z[j].s))::INT AS char_end, (c[j+1]-c[i+1])::INT AS n_tokens, md5(array_to_string(list_transform(z[i+1:j], lambda x: x.s),' ')) AS h"
_GREEDY = _chunks_sql(_sentences_sql("doc_id", "text", "documents"), "doc_id")


@query(_GREEDY + f" SELECT w.doc_id, no::INT AS chunk_id, {_CHUNK_COLS} FROM w JOIN t ON t.doc_id=w.doc_id")
def chunk_greedy(spark, sf):
    c = segment.chunks(table(spark, sf, "documents"), paragraphs=False)
    return c.select("doc_id", "chunk_id", "char_start", "char_end", "n_tokens", F.md5("disp").alias("h"))


_BLOCKS_SQL = (
    f"{_LINES}, x AS (SELECT doc_id, island, bool_or(kind='heading') AS heading, string_agg(CASE WHEN kind='heading' THEN trim(line) ELSE line END, chr(10) ORDER BY n) AS body, min(CASE WHEN kind='heading' THEN s+instr(line,trim(line))-1 ELSE s END) AS base FROM i WHERE kind<>'blank' GROUP BY doc_id, island),"
    " y AS MATERIALIZED (SELECT doc_id::VARCHAR||':'||island AS bk, * FROM x),"
)


@query(
    _chunks_sql(_sentences_sql("bk", "body", "y WHERE NOT heading", "base"), "bk", _BLOCKS_SQL)
    + ", u AS (SELECT bk, no, " + _CHUNK_COLS + f", false AS is_heading FROM w JOIN t USING (bk) UNION ALL SELECT bk, 0, base::INT, (base+length(body))::INT, len(regexp_extract_all(body,'{_CHUNK_TOKEN}'))::INT, md5(body), true FROM y WHERE heading)"
    " SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island, no)-1)::INT AS chunk_id, char_start, char_end, n_tokens, is_heading, h FROM u JOIN y USING (bk)"
)
def chunk_paragraphs(spark, sf):
    return segment.chunks(table(spark, sf, "documents"), headings=HEADINGS).select("doc_id", "chunk_id", "char_start", "char_end", "n_tokens", "is_heading", F.md5("disp").alias("h"))


@query(_with("SELECT nd.doc_id, coalesce(a,0)::BIGINT AS n, coalesce(b,0)::BIGINT AS n_distinct FROM nd LEFT JOIN (SELECT doc_id, count(*) AS a, count(DISTINCT gram) AS b FROM (" + _grams(5, "doc_id", "nd", False) + ") GROUP BY 1) USING (doc_id)"))
def char_ngrams_count(spark, sf):
    g = text.char_ngrams(F.col("t"), 5)
    return normalized(spark, sf).select("doc_id", F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


# --- retrieval ----------------------------------------------------------------------------------------------------


def _docs(spark, sf):
    return normalized(spark, sf)


def _items(spark, sf):
    return normalized(spark, sf, "benchmark", "item_id")


def _hashed(df, key):
    return df.select(key, simhash.simhash(F.col("t")).alias("simhash"))


@query(_with("SELECT item_id, doc_id, distance, rank FROM ht"))
def simhash_topk(spark, sf):
    return simhash.topk(_hashed(_items(spark, sf), "item_id"), _hashed(_docs(spark, sf), "doc_id"), "item_id", "doc_id", k=50)


@query()
def simhash_near_pairs(spark, sf):
    return simhash.within(_hashed(_docs(spark, sf), "doc_id"), "doc_id")


ORACLE_SQL["simhash_near_pairs"] = _with("SELECT x.k AS a, y.k AS b, bit_count(xor(x.h,y.h))::BIGINT AS distance, x.n AS a_copies, y.n AS b_copies FROM (SELECT h, min(doc_id) AS k, count(*) AS n FROM hd GROUP BY h) x JOIN (SELECT h, min(doc_id) AS k, count(*) AS n FROM hd GROUP BY h) y ON x.k<y.k AND bit_count(xor(x.h,y.h))<=3")


@query(_with("SELECT term, df, round(idf,6) AS idf FROM idf"))
def bm25_term_stats(spark, sf):
    d = _docs(spark, sf)
    return bm25.statistics(d, F.col("t")).select("term", "df", r6("idf").alias("idf"))


@query(_with("SELECT item_id, doc_id, round(score,6) AS score FROM bm"))
def bm25_scores(spark, sf):
    return bm25.scores(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", F.col("t"), F.col("t")).select("item_id", "doc_id", r6("score").alias("score"))


def _bm25_top(spark, sf):
    return bm25.topk(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", F.col("t"), F.col("t"), 30)


@query(_with("SELECT item_id, doc_id, round(score,6) AS score, round(1-exp(-greatest(score,0.0)/10),6) AS norm, rank FROM bt"))
def bm25_topk(spark, sf):
    return _bm25_top(spark, sf).select("item_id", "doc_id", r6("score").alias("score"), r6(scores.bm25_norm(F.col("score"))).alias("norm"), "rank")


def _vec_sql(metric: str) -> str:
    score = "round(list_dot_product(a.v,b.v)/((sqrt(list_dot_product(a.v,a.v))+1e-9)*(sqrt(list_dot_product(b.v,b.v))+1e-9)),9)" if metric == "cosine" else "round(sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))),9)"
    order = "DESC" if metric == "cosine" else ""
    return f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT query_id, vec_id, round(s,6) AS score, rank FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {score} AS s FROM e a JOIN e b ON a.vec_id % 50 = 0)) WHERE rank<=50"


def _vector_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "embedding")


@query(_vec_sql("cosine"))
def vector_topk_cosine(spark, sf):
    q, e = _vector_queries(spark, sf)
    return vectors.topk(q, e, "query_id", "vec_id").withColumn("score", r6("score"))


@query(_vec_sql("l2"))
def vector_topk_l2(spark, sf):
    q, e = _vector_queries(spark, sf)
    return vectors.topk(q, e, "query_id", "vec_id", metric="l2").withColumn("score", r6("score"))


@query()
def vector_approximate(spark, sf):
    q, e = _vector_queries(spark, sf)
    return vectors.approximate(q, e, "query_id", "vec_id").withColumn("score", r6("score"))


# --- features -----------------------------------------------------------------------------------------------------


def _best3(spark, sf, k: int = 3) -> DataFrame:
    return grams.topk(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", k=k)


@query(_with("SELECT item_id, doc_id, round(jac,6) AS jac, rank FROM jt"))
def jaccard_5gram_topk(spark, sf):
    return _best3(spark, sf).select("item_id", "doc_id", r6("jac").alias("jac"), "rank")


#: Keys that are broadcast; more are joined by a shuffle.
KEYS_AT_ONCE = 1_000_000


def _of(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs among the (written) pairs."""
    keys = pairs.select(key).distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= KEYS_AT_ONCE else keys, key, "left_semi")


def _pairs(spark, sf) -> DataFrame:
    """The three best documents of each item, with the texts."""
    top = written(_best3(spark, sf).drop("rank"), "pairs")  # three rows an item
    d = _of(table(spark, sf, "documents"), top, "doc_id").select("doc_id", F.col("text").alias("d_text"), text.normalize_whitespace(F.lower("text")).alias("dt"))
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("b_text"), text.normalize_whitespace(F.lower("text")).alias("bt"))
    return top.join(d, "doc_id").join(b, "item_id")


_HITS = "list_filter({l}, lambda p: contains({t},p))"


def _pen(l: tuple[str, ...], x: str, y: str) -> str:
    a, b = _HITS.format(l=_sql_list(l), t=x), _HITS.format(l=_sql_list(l), t=y)
    i, u = f"len(list_intersect({a},{b}))", f"(len({a})+len({b})-len(list_intersect({a},{b})))"
    return f"(CASE WHEN {u}=0 THEN 0.0 ELSE {i}/{u}::DOUBLE END)"


def _cites(t: str) -> str:
    return "(" + "+".join(f"regexp_matches({t},'{p}')::INT" for p in CITATIONS) + ")"


_PENALTIES = f"SELECT jt.item_id, jt.doc_id, jac, distance, {_pen(tuple(sorted(p.lower() for p in BOILERPLATE)), 'lower(d.text)', 'lower(b.text)')} AS bp, {_pen(tuple(sorted(STOPS)), 'nd.t', 'nb.t')} AS sp, CASE WHEN {_cites('d.text')}>0 AND {_cites('b.text')}>0 THEN least({_cites('d.text')},{_cites('b.text')})/greatest({_cites('d.text')},{_cites('b.text')})::DOUBLE ELSE 0.0 END AS cp FROM jt JOIN hx ON hx.item_id=jt.item_id AND hx.doc_id=jt.doc_id JOIN documents d ON d.doc_id=jt.doc_id JOIN benchmark b ON b.item_id=jt.item_id JOIN nd ON nd.doc_id=jt.doc_id JOIN nb ON nb.item_id=jt.item_id"


@query(_with(f"SELECT item_id, doc_id, round(jac,6) AS jac, round(0.5*jac+0.5*(1-distance/64.0),6) AS lex, round(bp,6) AS boilerplate, round(sp,6) AS stop, round(cp,6) AS citation, round((0.5*jac+0.5*(1-distance/64.0))*(1-0.5*bp)*(1-0.2*sp)*(1-0.15*cp),6) AS penalised FROM ({_PENALTIES})"))
def lexical_penalised(spark, sf):
    p = _pairs(spark, sf)
    ham = scores.hamming_similarity(simhash.simhash(F.col("dt")), simhash.simhash(F.col("bt")))
    p = p.withColumn("lex", scores.lexical_base(F.col("jac"), ham))
    p = p.withColumn("boilerplate", scores.shared_hits(scores.phrase_hits(F.col("d_text"), BOILERPLATE, True), scores.phrase_hits(F.col("b_text"), BOILERPLATE, True)))
    p = p.withColumn("stop", scores.shared_hits(scores.phrase_hits(F.col("dt"), STOPS, False), scores.phrase_hits(F.col("bt"), STOPS, False)))
    p = p.withColumn("citation", scores.citation_penalty(scores.pattern_count(F.col("d_text"), CITATIONS), scores.pattern_count(F.col("b_text"), CITATIONS)))
    out = scores.penalised(F.col("lex"), F.col("boilerplate"), F.col("stop"), F.col("citation"))
    return p.select("item_id", "doc_id", r6("jac").alias("jac"), r6("lex").alias("lex"), r6("boilerplate").alias("boilerplate"), r6("stop").alias("stop"), r6("citation").alias("citation"), r6(out).alias("penalised"))


# --- candidates, scores, records ----------------------------------------------------------------------------------


def _lexical(spark, sf) -> DataFrame:
    """(item_id, doc_id, bm25_raw, bi, held) of pairs with a common term, written. bi and held, shares of common tokens, stand in for the two models in queries with SQL."""
    met = bm25.scores(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", F.col("t"), F.col("t"))
    own = _items(spark, sf).select("item_id", F.size(F.array_distinct(text.tokens(F.col("t")))).alias("bn"))
    both = met.join(own, "item_id")
    return written(both.select("item_id", "doc_id", F.col("score").alias("bm25_raw"), (F.col("common") / (F.col("terms") + F.col("bn")) * 2).alias("bi"), (F.col("common") / F.col("bn")).alias("held")), "lexical")


def _candidates(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The candidate pairs, written, and what they were found by: lexical scores, and the SimHash of items and of documents."""
    lexical = _lexical(spark, sf)
    items, docs = (written(_hashed(df, key), "hashes") for df, key in ((_items(spark, sf), "item_id"), (_docs(spark, sf), "doc_id")))
    by_bm25 = bm25.topk(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", F.col("t"), F.col("t"), 30, scored=lexical.withColumnRenamed("bm25_raw", "score"))
    by_hash = simhash.topk(items, docs, "item_id", "doc_id", k=50)
    near = candidates.best(lexical, "item_id", "doc_id", F.round("bi", 9), 50)
    return written(candidates.union_cut([by_bm25, by_hash, near], "item_id", "doc_id", 50), "candidates"), lexical, items, docs


@query(_with("SELECT item_id, doc_id FROM cu"))
def candidate_union_cut(spark, sf):
    return _candidates(spark, sf)[0]


def _features(spark, sf) -> DataFrame:
    """Features of the candidate pairs alone, written."""
    keys = ["item_id", "doc_id"]
    both, lexical, items, docs = _candidates(spark, sf)
    g = F.array_distinct(text.char_ngrams(F.col("t"), 5))
    right = docs.withColumnRenamed("simhash", "x").join(_of(table(spark, sf, "documents"), both, "doc_id").select("doc_id", text.normalize_whitespace(F.lower("text")).alias("t")).select("doc_id", g.alias("gx")), "doc_id")
    left = items.withColumnRenamed("simhash", "y").join(_items(spark, sf).select("item_id", g.alias("gy")), "item_id")
    met = both.join(lexical, keys, "left").join(right, "doc_id").join(left, "item_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    inter = F.size(F.array_intersect("gx", "gy"))
    lex = scores.lexical_base(scores.ratio(inter, F.size("gx"), F.size("gy")), scores.hamming_similarity(F.col("x"), F.col("y")))
    feats = met.select(*keys, F.round(zero("bi"), 9).alias("bi"), zero("held").alias("held"), F.round(lex, 9).alias("lex"), zero("bm25_raw").alias("bm25_raw"))
    return written(candidates.prefilter(feats, "item_id", "doc_id"), "features")


@query(_with("SELECT item_id, doc_id, round(bi,6) AS bi, round(lex,6) AS lex, eligible FROM pre"))
def prefilter_fallback(spark, sf):
    return _features(spark, sf).select("item_id", "doc_id", r6("bi").alias("bi"), r6("lex").alias("lex"), "eligible")


@query(_with("SELECT item_id, doc_id, round(cross_s,6) AS cross_score FROM gate"))
def cross_gate(spark, sf):
    return candidates.gated(_features(spark, sf), "item_id", "doc_id").select("item_id", "doc_id", r6("held").alias("cross_score"))


def _scored(spark, sf) -> DataFrame:
    feats = _features(spark, sf)
    gate = candidates.gated(feats, "item_id", "doc_id").withColumn("cross", F.col("held"))
    met = candidates.join_back(feats, gate, ["item_id", "doc_id"])
    return met.withColumn("score", scores.fuse(F.col("cross"), F.col("bi"), F.col("lex"), F.col("bm25_raw")))


def _top5(spark, sf) -> DataFrame:
    top = candidates.best(_scored(spark, sf), "item_id", "doc_id", F.round("score", 9), 5)
    return top.withColumn("level", scores.level(F.col("score")))


@query(_with("SELECT item_id, doc_id, round(cross_score,6) AS cross_score, round(score,6) AS score, level, rank FROM top5"))
def fuse_level_top5(spark, sf):
    return _top5(spark, sf).select("item_id", "doc_id", r6("cross").alias("cross_score"), r6("score").alias("score"), "level", "rank")


@query(_with("SELECT count(*) AS pairs, count(*) FILTER (level='very_high') AS very_high, count(*) FILTER (level='high') AS high, count(*) FILTER (level='medium') AS medium, count(*) FILTER (level='low') AS low FROM top5"))
def level_summary(spark, sf):
    return summary.level_counts(_top5(spark, sf))


@query(_with("SELECT bin, count(score) AS n FROM (VALUES ('<0.6'),('0.6-0.7'),('0.7-0.8'),('0.8-0.9'),('>=0.9')) v(bin) LEFT JOIN (SELECT score, CASE WHEN score<0.6 THEN '<0.6' WHEN score<0.7 THEN '0.6-0.7' WHEN score<0.8 THEN '0.7-0.8' WHEN score<0.9 THEN '0.8-0.9' ELSE '>=0.9' END AS b FROM top5) ON b=bin GROUP BY bin"))
def score_histogram(spark, sf):
    return summary.histogram(_top5(spark, sf))


def _records(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("b_text"))
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("a_text"))
    return _top5(spark, sf).join(d, "doc_id").join(b, "item_id").select(F.col("item_id").alias("a_chunk_id"), F.col("doc_id").alias("b_chunk_id"), "score", "level", "a_text", "b_text")


_REC = "SELECT top5.item_id AS a_chunk_id, top5.doc_id AS b_chunk_id, score, level, b.text AS a_text, d.text AS b_text FROM top5 JOIN documents d ON d.doc_id=top5.doc_id JOIN benchmark b ON b.item_id=top5.item_id"


@query(_with(f"SELECT a_chunk_id, b_chunk_id, round(score,6) AS score FROM ({_REC}) WHERE level='low' AND score>=0.2 AND (contains(lower(a_text),'the') OR contains(lower(b_text),'the'))"))
def report_filter(spark, sf):
    return summary.filtered(_records(spark, sf), "low", 0.2, "The").select("a_chunk_id", "b_chunk_id", r6("score").alias("score"))


@query(_with(f"SELECT printf('%.4f',score) AS score, level, a_chunk_id, b_chunk_id, substr(replace(a_text,chr(10),' '),1,500) AS a_text, substr(replace(b_text,chr(10),' '),1,500) AS b_text FROM ({_REC})"))
def csv_export(spark, sf):
    r = _records(spark, sf)
    return report.csv_rows(r.select("score", "level", "a_chunk_id", "b_chunk_id", F.struct(F.col("a_text").alias("text")).alias("a"), F.struct(F.col("b_text").alias("text")).alias("b")))


@query("SELECT a.doc_id AS a, b.doc_id AS b, round(least(1.0,0.25+0.15+0.05*(1-exp(-20.0/10))),6) AS score, 'low' AS level FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) a JOIN documents b ON a.text=b.text AND a.doc_id<b.doc_id")
def exact_copy_low(spark, sf):
    """A copy has bi and lex 1; above the gate there is no cross score, so it is low. Each copy meets the first of its text."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    first = d.groupBy("text").agg(F.min("doc_id").alias("a"))
    met = d.join(first, "text").where("a < doc_id")
    score = scores.fuse(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(20.0))
    return met.select("a", F.col("doc_id").alias("b"), r6(score).alias("score"), scores.level(score).alias("level"))


# --- spans --------------------------------------------------------------------------------------------------------


def _span_rows(spark, sf) -> DataFrame:
    """Spans from line items: (order, s, e, n)."""
    li = table(spark, sf, "lineitem")
    s = (F.col("l_partkey") % 300).cast("int")
    return li.select("l_orderkey", s.alias("s"), (s + 5 + F.col("l_quantity").cast("int")).alias("e"), F.lit(400).alias("n"))


_SPANS = "(SELECT l_orderkey, (l_partkey%300)::INT AS s, (l_partkey%300)::INT+5+floor(l_quantity)::INT AS e, 400 AS n FROM lineitem)"
_ISLANDS = "SELECT l_orderkey, s, e, n, sum(f) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+{gap} THEN 0 ELSE 1 END AS f FROM " + _SPANS + ")"


@query("SELECT l_orderkey, sum(b-a)::BIGINT AS covered, 400::BIGINT AS length, round(sum(b-a)/400.0*100,6) AS pct, floor(sum(b-a)/5.0+0.5)::BIGINT AS words FROM (SELECT l_orderkey, g, min(s) AS a, max(e) AS b FROM (" + _ISLANDS.format(gap=0) + ") GROUP BY ALL) GROUP BY l_orderkey")
def coverage_union(spark, sf):
    s = _span_rows(spark, sf)
    return summary.union_coverage(s, "l_orderkey", F.col("s"), F.col("e"), F.col("n")).withColumn("pct", r6("pct"))


def _span_arrays(spark, sf) -> DataFrame:
    return _span_rows(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


@query("SELECT l_orderkey, string_agg(a||':'||b, ',' ORDER BY a) AS spans FROM (SELECT l_orderkey, g, min(s) AS a, max(e) AS b FROM (" + _ISLANDS.format(gap=5) + ") GROUP BY ALL) GROUP BY l_orderkey")
def span_merge(spark, sf):
    m = spans.merged(F.col("spans"))
    return _span_arrays(spark, sf).select("l_orderkey", F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias("spans"))


@query(f"SELECT l_orderkey, bool_or(e-s>=50) OR count(*) FILTER (e-s>=40)>=2 AS passes, round(least(1.0,sum(e-s)/400.0),6) AS coverage FROM {_SPANS} GROUP BY l_orderkey")
def span_rule(spark, sf):
    s = _span_arrays(spark, sf)
    return s.select("l_orderkey", spans.passes_rule(F.col("spans"), 50, 40).alias("passes"), r6(spans.coverage(F.col("spans"), F.lit(400))).alias("coverage"))


def _span_pairs(spark, sf) -> DataFrame:
    p = F.transform("spans", lambda x: F.struct(x["s"].alias("a0"), x["e"].alias("a1"), (x["s"] + 7).alias("b0"), (x["e"] + 7).alias("b1")))
    return _span_arrays(spark, sf).select("l_orderkey", p.alias("pairs"))


@query(
    f"WITH RECURSIVE o AS (SELECT l_orderkey, s, e, row_number() OVER (PARTITION BY l_orderkey ORDER BY e-s DESC, s, e) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {_SPANS}),"
    " w(l_orderkey, k, n, kept) AS (SELECT l_orderkey, 1::BIGINT, n, [{'s':s,'e':e}] FROM o WHERE k=1"
    " UNION ALL SELECT w.l_orderkey, w.k+1, w.n, CASE WHEN len(list_filter(kept, lambda y: greatest(0,least(o.e,y.e)-greatest(o.s,y.s)) >= 0.6*((o.e-o.s)+(y.e-y.s)-greatest(0,least(o.e,y.e)-greatest(o.s,y.s)))))=0 THEN list_append(kept, {'s':o.s,'e':o.e}) ELSE kept END FROM w JOIN o ON o.l_orderkey=w.l_orderkey AND o.k=w.k+1)"
    " SELECT l_orderkey, len(kept)::INT AS kept, array_to_string(list_transform(kept, lambda x: x.s||':'||x.e),',') AS spans FROM w WHERE k=n"
)
def span_nms(spark, sf):
    m = spans.suppressed(F.col("pairs"))
    return _span_pairs(spark, sf).select("l_orderkey", F.size(m).alias("kept"), F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["a0"], x["a1"])), ",").alias("spans"))


@query("SELECT l_orderkey, string_agg(a||':'||b||':'||(a+7)||':'||(b+7), ',' ORDER BY a) AS spans FROM (SELECT l_orderkey, g, min(s) AS a, max(e) AS b FROM (" + _ISLANDS.format(gap=10) + ") GROUP BY ALL) GROUP BY l_orderkey")
def span_pair_merge(spark, sf):
    m = spans.merged_pairs(F.col("pairs"))
    return _span_pairs(spark, sf).select("l_orderkey", F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["a0"], x["a1"], x["b0"], x["b1"])), ",").alias("spans"))


@query("SELECT l_orderkey, l_linenumber, round(s/400.0*100,6) AS lefts, round(greatest(0.2,(e-s)/400.0*100),6) AS widths FROM (SELECT l_orderkey, l_linenumber, (l_partkey%300)::INT AS s, (l_partkey%300)::INT+(floor(l_quantity)::INT-1)//7 AS e FROM lineitem)")
def heatmap(spark, sf):
    """Left edge and width of each span's mark, many of the smallest width."""
    li = table(spark, sf, "lineitem")
    s = (F.col("l_partkey") % 300).cast("int")
    left, width = summary.heat(s, s + F.floor((F.col("l_quantity").cast("int") - 1) / 7).cast("int"), F.lit(400))
    return li.select("l_orderkey", "l_linenumber", r6(left).alias("lefts"), r6(width).alias("widths"))


@query("SELECT doc_id, substr(text,greatest(0,p-40)+1,p-greatest(0,p-40)) AS before, substr(text,p+1,3) AS hit, substr(text,p+4,40) AS after FROM (SELECT doc_id, text, instr(text,'the')-1 AS p FROM documents) WHERE p>=0")
def snippets(spark, sf):
    p = F.instr("text", "the") - 1
    s = F.explode(spans.snippets(F.col("text"), F.array(F.struct(p.alias("s"), (p + 3).alias("e")))))
    return table(spark, sf, "documents").where(F.instr("text", "the") > 0).select("doc_id", s.alias("x")).select("doc_id", "x.before", "x.hit", "x.after")


@query("SELECT doc_id, md5(CASE WHEN length(text)=0 THEN '' WHEN p<0 THEN '<pre>'||replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;')||'</pre>' ELSE '<pre>'||replace(replace(replace(substr(text,1,p),'&','&amp;'),'<','&lt;'),'>','&gt;')||'<mark>the</mark>'||replace(replace(replace(substr(text,p+4),'&','&amp;'),'<','&lt;'),'>','&gt;')||'</pre>' END) AS h FROM (SELECT doc_id, replace(replace(text,chr(34),' '),chr(39),' ') AS text, instr(text,'the')-1 AS p FROM documents)")
def marked_text(spark, sf):
    plain = F.translate("text", "\"'", "  ")
    p = F.instr("text", "the") - 1
    s = F.when(p >= 0, F.array(F.struct(p.alias("s"), (p + 3).alias("e")))).otherwise(F.array().cast(spans.SPAN))
    return table(spark, sf, "documents").select("doc_id", F.md5(spans.marked(plain, s)).alias("h"))


_DIAGONAL = "ij.row[i+1]>ij.row[i] AND ab.row[i+1]<=ab.row[i]"


@query(
    "WITH RECURSIVE p AS (SELECT x.conv_id, x.turn, substr(x.text,1,40) AS a, substr(y.text,1,40) AS b FROM conversations x JOIN conversations y ON x.conv_id=y.conv_id AND y.turn=x.turn+1),"
    " q AS (SELECT *, coalesce(list_max(list_filter(range(1,least(length(a),length(b))+1), lambda k: substr(a,1,k)=substr(b,1,k))),0) AS h FROM p),"
    " r AS (SELECT *, coalesce(list_max(list_filter(range(1,least(length(a),length(b))-h+1), lambda k: substr(a,length(a)-k+1)=substr(b,length(b)-k+1))),0) AS t FROM q),"
    " c AS MATERIALIZED (SELECT *, substr(a,(h+1)::INT,(length(a)-h-t)::INT) AS x, substr(b,(h+1)::INT,(length(b)-h-t)::INT) AS y FROM r),"
    " d(conv_id, turn, j, row) AS (SELECT conv_id, turn, 0::BIGINT, list_transform(range(0,length(x)+1), lambda i: 0::BIGINT) FROM c"
    " UNION ALL SELECT conv_id, turn, j+1, [0::BIGINT]||list_transform(range(1,n+1), lambda i: list_max(best[1:i])) FROM (SELECT d.conv_id, d.turn, j, length(x) AS n, list_transform(range(1,length(x)+1), lambda i: greatest(row[i+1], CASE WHEN substr(x,i::INT,1)=substr(y,(j+1)::INT,1) THEN row[i]+1 ELSE 0 END)) AS best FROM d JOIN c ON c.conv_id=d.conv_id AND c.turn=d.turn WHERE j<length(y))),"
    " w(conv_id, turn, i, j, hit) AS (SELECT conv_id, turn, length(x)::BIGINT, length(y)::BIGINT, false FROM c"
    f" UNION ALL SELECT w.conv_id, w.turn, CASE WHEN {_DIAGONAL} OR ij.row[i+1]<=ij.row[i] THEN i-1 ELSE i END, CASE WHEN ij.row[i+1]>ij.row[i] THEN w.j-1 ELSE w.j END, {_DIAGONAL} FROM w JOIN d ij ON ij.conv_id=w.conv_id AND ij.turn=w.turn AND ij.j=w.j JOIN d ab ON ab.conv_id=w.conv_id AND ab.turn=w.turn AND ab.j=w.j-1 WHERE i>0 AND w.j>0),"
    " o AS (SELECT conv_id, turn, unnest(range(0,h)) AS u, unnest(range(0,h)) AS v FROM c UNION ALL SELECT w.conv_id, w.turn, i+h, j+h FROM w JOIN c ON c.conv_id=w.conv_id AND c.turn=w.turn WHERE hit UNION ALL SELECT conv_id, turn, unnest(range(length(a)-t,length(a))), unnest(range(length(b)-t,length(b))) FROM c),"
    " g AS (SELECT conv_id, turn, min(u) AS u, min(v) AS v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY u) AS k FROM o) GROUP BY conv_id, turn, u-k, v-k HAVING count(*)>=2)"
    " SELECT c.conv_id, c.turn, coalesce(string_agg(u||':'||(u+n)||':'||v||':'||(v+n), ',' ORDER BY u),'') AS pairs FROM c LEFT JOIN g ON g.conv_id=c.conv_id AND g.turn=c.turn GROUP BY c.conv_id, c.turn"
)
def lcs_blocks(spark, sf):
    """Equal runs of two characters or more in the longest common subsequence of the first 40 characters of neighbouring turns."""
    short = table(spark, sf, "conversations").select("conv_id", "turn", F.substring("text", 1, 40).alias("t"))
    met = short.withColumnRenamed("t", "a").join(short.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("b")), ["conv_id", "turn"])
    found = blocks(F.col("a"), F.col("b"), F.lit(2))
    return met.select("conv_id", "turn", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["a0"], x["a1"], x["b0"], x["b1"])), ",").alias("pairs"))


@query()
def lcs_align(spark, sf):
    """The best document's chunks and each item, aligned."""
    top = written(_best3(spark, sf, 1), "pairs")
    d = segment.chunks(_of(table(spark, sf, "documents"), top, "doc_id"), paragraphs=False).select("doc_id", "chunk_id", F.lower("disp").alias("y"))
    b = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("x"))
    met = top.join(b, "item_id").join(d, "doc_id").withColumn("pairs", tiles(F.col("x"), F.col("y")))
    return met.where(F.size("pairs") > 0).select("item_id", "doc_id", "chunk_id", F.size("pairs").alias("n"), F.to_json("pairs").alias("pairs"))


@query()
def semantic_sentence_match(spark, sf):
    p = _pairs(spark, sf).withColumn("pairs", models.sentence_pairs(F.col("b_text"), F.col("d_text"), models.HashedGrams()))
    return p.select("item_id", "doc_id", F.size("pairs").alias("n"), F.to_json("pairs").alias("pairs"))


# --- reports, caches ----------------------------------------------------------------------------------------------

# Reports of every shape made from the tables: each field under one of its names, as the line's number says.
_SCORE_NAMES, _LIST_NAMES = ("score", "similarity", "sim", "ratio"), ("pairs", "results", "matches", "items")
_REPORT_ROWS = (
    "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity::INT AS q, CASE WHEN l_quantity::INT%2=0 THEN l_quantity::INT/100.0 ELSE l_quantity::INT+45.5 END AS score,"
    " CASE WHEN l_partkey%5=0 THEN 'odd' ELSE '' END AS level, CASE WHEN l_orderkey%2=0 THEN 0.9 ELSE 0.3 END AS high FROM lineitem"
)


@query(
    f"SELECT k AS report, n AS line, round(score,6) AS score, CASE WHEN level<>'' THEN level WHEN score>=high THEN 'very_high' WHEN score>=0.2 THEN 'medium' ELSE 'low' END AS level, p::INT AS a_chunk_id, q AS b_chunk_id, 'x'||p AS a_text, 'y'||q AS b_text, 1 AS a_spans, (n%2)::INT AS b_spans FROM (SELECT * REPLACE (CASE WHEN score>1.5 THEN score/100 ELSE score END AS score) FROM ({_REPORT_ROWS}))"
)
def report_normalize(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q"))
    score = F.when(F.col("q") % 2 == 0, F.col("q") / 100).otherwise(F.col("q") + 45.5)
    named = lambda names, value, by: [F.when(by % len(names) == i, value).alias(c) for i, c in enumerate(names)]
    spans_of = F.array(F.array(F.lit(0), F.lit(2)))
    none = F.array().cast("array<array<int>>")
    x, y = F.concat(F.lit("x"), F.col("p")), F.concat(F.lit("y"), F.col("q"))
    by = F.col("n")
    obj = F.struct(x.alias("text"), spans_of.alias("spans"))
    pair = F.struct(
        *named(_SCORE_NAMES, score.cast("string"), by),
        F.when(F.col("p") % 5 == 0, F.lit("odd")).otherwise(F.lit("")).alias("level"),
        *named(("a_chunk_id", "chunk_a", "a_id"), F.col("p").cast("int"), by),
        *named(("b_chunk_id", "chunk_b", "b_id"), F.col("q"), by + 1),
        # A side is an object, a plain text, or stands in fields beside.
        F.when(by % 4 == 0, F.to_json(obj)).when(by % 4 == 1, x).alias("a"),
        F.when(by % 4 == 2, x).alias("a_text"),
        F.when(by % 4 == 3, x).alias("text_a"),
        F.when(by % 4 != 0, spans_of).alias("a_spans"),
        F.when(by % 3 == 0, y).alias("b"),
        *[F.when(by % 3 == 1 + i, y).alias(c) for i, c in enumerate(("b_text", "text_b"))],
        F.when(by % 2 == 1, spans_of).otherwise(none).alias("spans_b"),
    )
    listed = F.array_sort(F.collect_list(F.struct("n", pair.alias("p"))))
    meta = F.to_json(F.struct(F.struct(F.struct(F.when(F.col("k") % 2 == 0, F.lit(0.9)).otherwise(F.lit(0.3)).alias("high"), F.lit(0.2).alias("medium")).alias("thresholds")).alias("cfg")))
    rows = li.groupBy("k").agg(F.transform(listed, lambda z: z["p"]).alias("own"), F.transform(listed, lambda z: z["n"]).alias("numbers"))
    text_of = F.to_json(F.struct(*[F.when(F.col("k") % 4 == i, F.col("own")).alias(c) for i, c in enumerate(_LIST_NAMES)], meta.alias("meta")))
    parsed = rows.select(F.col("k").alias("report_no"), F.col("numbers"), F.from_json(text_of, report.REPORT).alias("r"))
    out = report.pairs(parsed.select("report_no", "r.*")).join(parsed.select("report_no", "numbers"), "report_no")
    return out.select(F.col("report_no").alias("report"), F.element_at("numbers", F.col("pair_no") + 1).alias("line"), r6("score").alias("score"), "level", "a_chunk_id", "b_chunk_id", F.col("a.text").alias("a_text"), F.col("b.text").alias("b_text"), F.size("a.spans").alias("a_spans"), F.size("b.spans").alias("b_spans"))


@query("SELECT DISTINCT md5('m||'||text) AS key FROM documents WHERE md5('m||'||text) NOT IN (SELECT md5('m||'||text) FROM documents WHERE source='src0')")
def embedding_cache_miss(spark, sf):
    keyed = table(spark, sf, "documents").select("source", text.content_key("m", F.col("text")).alias("key"))
    return candidates.missing(keyed.select("key").distinct(), keyed.where("source = 'src0'"), "key")


@query("SELECT doc_id, round((n_chars-lo)/(hi-lo)::DOUBLE,6) AS scaled FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)")
def minmax_scale(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    one = d.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return d.crossJoin(F.broadcast(one)).select("doc_id", r6(scores.minmax(F.col("n_chars"), F.col("lo"), F.col("hi"))).alias("scaled"))  # one row


@query(_GREEDY + " SELECT source, count(*) AS chunks FROM w JOIN documents d ON d.doc_id=w.doc_id GROUP BY source")
def corpus_counts(spark, sf):
    """Chunks of each source."""
    d = table(spark, sf, "documents")
    return segment.chunks(d, paragraphs=False).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("chunks"))
