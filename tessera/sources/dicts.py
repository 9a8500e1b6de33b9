"""Phrase lists, term maps and settings files. They are small inputs of a plan, read on the driver."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def _there(path: str, optional: bool) -> bool:
    if path and os.path.exists(path):
        return True
    if path and not optional:
        raise FileNotFoundError(path)
    return False


def phrase_list(path: str, optional: bool = False) -> list[str]:
    """Stripped lines without blanks, each once, in the file's order; the case is kept."""
    if not _there(path, optional):
        return []
    with open(path, encoding="utf-8") as f:
        return list(dict.fromkeys(s for line in f if (s := line.strip())))


def term_map(path: str, optional: bool = False) -> dict[str, str]:
    """The first two tab-separated fields of each line: lower-cased key, value; a later key wins, and a line with one field is skipped with a warning."""
    out: dict[str, str] = {}
    if not _there(path, optional):
        return out
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if not line.strip():
                continue
            parts = line.rstrip("\r\n").split("\t")
            if len(parts) < 2 or not parts[0].strip():
                log.warning("%s, line %d: no two fields", path, n)
                continue
            out[parts[0].strip().lower()] = parts[1].strip()
    return out


@dataclass
class Dictionaries:
    stop_phrases: list[str] = field(default_factory=list)
    boilerplate: list[str] = field(default_factory=list)
    synonyms: dict[str, str] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    gazetteer: dict[str, str] = field(default_factory=dict)


def load(paths: dict[str, str]) -> Dictionaries:
    """Phrases are needed, maps may be missing; no path means an empty one."""
    return Dictionaries(
        phrase_list(paths.get("stop_phrases", "")),
        phrase_list(paths.get("boilerplate", "")),
        term_map(paths.get("synonyms", ""), True),
        term_map(paths.get("abbreviations", ""), True),
        term_map(paths.get("gazetteer", ""), True),
    )


def domain_boilerplate(base: Iterable[str], paths: Iterable[str]) -> list[str]:
    """The base phrases and, lower-cased, those of further files; a file that can't be read is left out."""
    out = dict.fromkeys(base)
    for p in paths:
        try:
            out |= dict.fromkeys(s.lower() for s in phrase_list(p))
        except (OSError, UnicodeError) as e:
            log.warning("%s: %s", p, e)
    return list(out)


def phrase_table(spark: SparkSession, path: str) -> DataFrame:
    """The same list for lists of any size, as a table."""
    return spark.read.text(path).select(F.trim("value").alias("phrase")).where("phrase != ''").distinct()


def term_table(spark: SparkSession, path: str) -> DataFrame:
    """The same map for maps of any size; the last line of a key wins by its place in the file."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 2)
    return rows.groupBy(F.lower(F.trim(F.element_at("f", 1))).alias("src")).agg(F.max_by(F.trim(F.element_at("f", 2)), "n").alias("dst")).where("src != ''")
