"""Match reports: reading any of their shapes, and writing JSON, HTML, CSV, logs and caches."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import fallback_bounds, level

_SPANS = "array<array<int>>"
_SIDE = f"struct<text:string,spans:{_SPANS},char_span_in_doc:array<int>>"
#: A superset of the fields that reports have.
PAIR = (
    "struct<score:string,similarity:string,sim:string,ratio:string,level:string,a_chunk_id:int,chunk_a:int,a_id:int,b_chunk_id:int,chunk_b:int,b_id:int,"
    f"scores:map<string,double>,a:string,b:string,a_text:string,text_a:string,b_text:string,text_b:string,spans_a:{_SPANS},a_spans:{_SPANS},spans_b:{_SPANS},b_spans:{_SPANS},"
    "a_char_span_in_doc:array<int>,a_span_doc:array<int>,b_char_span_in_doc:array<int>,b_span_doc:array<int>>"
)
REPORT = f"pairs array<{PAIR}>, results array<{PAIR}>, matches array<{PAIR}>, items array<{PAIR}>, summary string, stats string, meta string"


def _score(p: Column) -> Column:
    raw = F.coalesce(p["score"], p["similarity"], p["sim"], p["ratio"])
    x = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    return F.when(x > 1.5, x / 100).otherwise(x)


def _side(p: Column, s: str) -> Column:
    """A side as an object, as a plain text, or in fields beside it."""
    obj = F.from_json(p[s], _SIDE)
    text = F.when(p[s].startswith("{"), obj["text"]).otherwise(F.coalesce(F.nullif(p[s], F.lit("")), p[f"{s}_text"], p[f"text_{s}"], F.lit("")))
    full = lambda c: F.when(F.size(c) > 0, c)
    spans = F.coalesce(full(obj["spans"]), p[f"spans_{s}"], p[f"{s}_spans"], F.array().cast(_SPANS))
    return F.struct(text.alias("text"), spans.alias("spans"), F.coalesce(obj["char_span_in_doc"], p[f"{s}_char_span_in_doc"], p[f"{s}_span_doc"]).alias("char_span_in_doc"))


def normalized_pair(p: Column, bounds) -> list[Column]:
    score = _score(p)
    return [
        score.alias("score"),
        F.coalesce(F.nullif(p["level"], F.lit("")), level(score, bounds)).alias("level"),
        F.coalesce(p["a_chunk_id"], p["chunk_a"], p["a_id"]).alias("a_chunk_id"),
        F.coalesce(p["b_chunk_id"], p["chunk_b"], p["b_id"]).alias("b_chunk_id"),
        p["scores"].alias("scores"),
        _side(p, "a").alias("a"),
        _side(p, "b").alias("b"),
    ]


def bounds_of(meta: Column):
    """The bounds of levels that a report's own settings give: very_high falls back to high, then to its fixed value."""
    at = lambda name: F.get_json_object(meta, f"$.cfg.thresholds.{name}").try_cast("double")
    return tuple((name, F.coalesce(*map(at, names), F.lit(last))) for name, names, last in (("very_high", ("very_high", "high"), 0.82), ("high", ("high",), 0.72), ("medium", ("medium",), 0.60)))


def pairs(reports: DataFrame, cfg: dict | None = None) -> DataFrame:
    """A row per pair of reports with the columns of REPORT, in the normal shape, and report_no if they have it. Levels that aren't given follow each report's own
    thresholds, or those of cfg."""
    found = F.coalesce("pairs", "results", "matches", "items")
    own = [c for c in ("report_no",) if c in reports.columns]
    rows = reports.select(*own, "meta", F.posexplode(found).alias("pair_no", "p"))
    return rows.select(*own, "pair_no", *normalized_pair(F.col("p"), bounds_of(F.col("meta")) if cfg is None else fallback_bounds(cfg)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Report files as rows with their number (report_no); raises on text that isn't JSON, or YAML if the path ends so."""
    if path.endswith((".yaml", ".yml")):

        @F.udf("string")
        def as_json(text: str) -> str:
            import yaml

            return json.dumps(yaml.safe_load(text), ensure_ascii=False, default=str)

        rows = spark.read.text(path, wholetext=True).select(F.from_json(as_json("value"), REPORT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(REPORT).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.withColumn("report_no", F.monotonically_increasing_id())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return pairs(read(spark, path)).drop("report_no")


def derived_summary(found: DataFrame) -> DataFrame:
    """Level counts, and chunk counts from the largest ids where a report has none."""
    from ..operators.summary import level_counts

    counted = level_counts(found)
    return counted.crossJoin(found.agg((F.coalesce(F.max("a_chunk_id"), F.lit(-1)) + 1).alias("chunks_A"), (F.coalesce(F.max("b_chunk_id"), F.lit(-1)) + 1).alias("chunks_B")))  # one row each


_SUMMARY = "struct<levels:map<string,bigint>,chunks_A:bigint,chunks_B:bigint>"


def summaries(reports: DataFrame) -> DataFrame:
    """A row per report: report_no, levels (name to count), chunks_A, chunks_B and rest. What its summary (or stats) says comes first; missing levels are counted, missing
    chunk counts are the largest ids plus one, or 0. rest: the summary as it stands, in JSON."""
    names = ("very_high", "high", "medium", "low")
    # Other levels than the four are counted too.
    found = pairs(reports)
    counted = found.where(~F.col("level").isin(*names)).groupBy("report_no", "level").agg(F.count("*").alias("n")).groupBy("report_no").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("other"))
    fixed = found.groupBy("report_no").agg(*[F.count_if(F.col("level") == n).alias(n) for n in names], F.max("a_chunk_id").alias("a"), F.max("b_chunk_id").alias("b"))
    said = F.coalesce(F.nullif("summary", F.lit("{}")), F.nullif("stats", F.lit("{}")))
    met = reports.select("report_no", said.alias("rest"), F.from_json(said, _SUMMARY).alias("s")).join(fixed, "report_no", "left").join(counted, "report_no", "left")
    own = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(n, F.lit(0).cast("long")))])
    levels = F.when(F.col("other").isNotNull(), F.map_concat(own, "other")).otherwise(own)
    chunks = lambda name, c: F.coalesce(F.col("s")[name], F.greatest(F.coalesce(c, F.lit(-1)), F.lit(-1)).cast("long") + 1).alias(name)
    return met.select("report_no", F.coalesce(F.col("s")["levels"], levels).alias("levels"), chunks("chunks_A", "a"), chunks("chunks_B", "b"), "rest")


def normalized(spark: SparkSession, path: str) -> dict:
    """One stored report of any shape in the normal shape, as a page shows it: summary, pairs, meta."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    one = read(spark, path)
    whole = summaries(one).first()
    made = (json.loads(whole["rest"]) if whole["rest"] else {}) | {"levels": dict(whole["levels"]), "chunks_A": whole["chunks_A"], "chunks_B": whole["chunks_B"]}
    meta = one.first()["meta"]
    return {"summary": made, "pairs": [r.asDict(True) for r in pairs(one).drop("report_no", "pair_no").collect()], "meta": json.loads(meta) if meta else {}}  # one comparison's


def export_html(spark: SparkSession, path: str, out: str) -> str:
    """A stored report as a page of its own."""
    found = normalized(spark, path)
    write_html(out, found["summary"], [r | {"scores": r["scores"] or {}} for r in found["pairs"]])
    return out


# --- sinks --------------------------------------------------------------------------------------------------------


def write_json(path: str, summary: dict, records: list[dict], cfg: dict, hw: dict) -> None:
    """One report; the records are one comparison's, a bounded number per chunk."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"summary": summary, "pairs": records, "meta": {"cfg": cfg, "hw": hw}}, f, ensure_ascii=False, indent=2)


def write_records(found: DataFrame, path: str) -> None:
    """The records of many comparisons as JSON lines, by the executors."""
    found.write.mode("overwrite").json(path)


def csv_rows(found: DataFrame) -> DataFrame:
    """score (4 digits), level, ids and the first 500 characters of the texts without line ends."""
    short = lambda c: F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), 1, 500)
    return found.select(F.format_string("%.4f", F.col("score").cast("double")).alias("score"), "level", "a_chunk_id", "b_chunk_id", short(F.col("a.text")).alias("a_text"), short(F.col("b.text")).alias("b_text"))


def write_csv(found: DataFrame, path: str) -> None:
    csv_rows(found).write.mode("overwrite").option("header", "true").option("quoteAll", "false").option("escape", '"').csv(path)


def _marks(text: str, spans: list) -> str:
    out, at = [], 0
    for s, e in spans:
        s, e = max(at, min(s, len(text))), min(e, len(text))
        if e > s:
            out += [escape(text[at:s]), "<mark>", escape(text[s:e]), "</mark>"]
            at = e
    return "".join([*out, escape(text[at:])])


def html(summary: dict, records: list[dict], title: str = "Overlap report") -> str:
    """The report as a page: counts, then the pairs by falling score with level, score, parts and marked texts."""
    levels = summary.get("levels", {})
    tiles = "".join(f"<li><b>{n}</b> {escape(k)}</li>" for k, n in [("pairs", summary.get("pairs", len(records))), ("very high", levels.get("very_high", 0)), ("high", levels.get("high", 0)), ("medium", levels.get("medium", 0))])
    cards = []
    for r in sorted(records, key=lambda r: -r["score"]):
        parts = ", ".join(f"{k} {v:.3f}" for k, v in r.get("scores", {}).items())
        cards.append(f"<article><h2>{escape(r['level'].replace('_', ' ').upper())} {r['score']:.1%}</h2><p>{escape(parts)}</p><blockquote>{_marks(r['a']['text'], r['a']['spans'])}</blockquote><blockquote>{_marks(r['b']['text'], r['b']['spans'])}</blockquote></article>")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>body{{font:16px sans-serif;margin:2em auto;max-width:60em}}mark{{background:#fd8}}article{{border-top:1px solid #ccc}}li{{display:inline;margin-right:2em}}</style></head><body><h1>{escape(title)}</h1><ul>{tiles}</ul>{"".join(cards)}</body></html>'


def write_html(path: str, summary: dict, records: list[dict]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(html(summary, records))


class JsonLog:
    """Appends one JSON object a line, and times sections; without a path it does nothing."""

    def __init__(self, path: str | None):
        self.path = path

    def log(self, obj: dict) -> None:
        if not self.path:
            return
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(obj, ensure_ascii=False) + "\n")

    @contextmanager
    def section(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.log({"event": "timing", "section": name, "seconds": round(time.perf_counter() - began, 4)})


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cache_read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed result cache; one that is missing is empty. One that can't be read is an error, as filling it anew would hide what is wrong."""
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


JSON_CACHE = "namespace string, key string, value string"


def json_cache_read(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """(key, value) of a namespace of a cache of JSON values; values that don't parse are left out, and of a key's values one counts."""
    rows = cache_read(spark, path, JSON_CACHE).where((F.col("namespace") == namespace) & F.try_parse_json("value").isNotNull())
    return rows.groupBy("key").agg(F.max("value").alias("value"))


def json_cache_add(rows: DataFrame, path: str, namespace: str) -> None:
    """rows: (key, value), the value as JSON text."""
    rows.select(F.lit(namespace).alias("namespace"), "key", "value").write.mode("append").partitionBy("namespace").parquet(path)


def cache_add(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def ensure_file(path: str, suffix: str = ".docx") -> str:
    """The path, if it ends so and is there; of another store than this machine's, Spark finds out whether it is."""
    if not path.lower().endswith(suffix):
        raise ValueError(f"not a {suffix} file: {path}")
    scheme, _, rest = path.partition(":") if ":" in path.split("/")[0] else ("file", "", path)
    if scheme == "file" and not os.path.exists("/" + rest.lstrip("/") if rest.startswith("//") else rest):
        raise FileNotFoundError(path)
    return path
