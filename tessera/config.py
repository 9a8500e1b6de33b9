"""Settings of a comparison. A YAML file of nested keys is read into them, with the phrase lists and term maps that it names; keys that never had an
effect are named, not honoured."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any

from .sources import dicts

log = logging.getLogger(__name__)

#: Keys that files may have and that nothing reads.
INERT = ("bm25.k1", "bm25.b", "simhash.ngram", "simhash.window", "thresholds", "alignment.gap_merge", "preprocess.accent_dual_versions", "preprocess.strip_punctuation", "io.export", "domain_dicts", "dictionary_paths.gazetteer", "ann.force_brute_force_threshold", "parallel", "chunking.max_seq_len_bi", "chunking.max_seq_len_cross")


@dataclass(frozen=True)
class Config:
    # preparation
    keep_tables: bool = True
    ignore_sections: tuple[str, ...] = ()
    section_headers: tuple[str, ...] = ()
    lowercase: bool = True
    unicode_normalize: str | None = "NFC"
    strip_zero_width: bool = True
    mask_numbers: bool = True
    abbreviations_expand: bool = True
    synonyms_expand: bool = True
    remove_stop_phrases: bool = True
    remove_boilerplate: bool = True
    # chunks
    mode: str = "paragraph"
    size_tokens: int = 260
    overlap: int = 50
    # retrieval
    bm25_topk: int = 30
    simhash_topk: int = 50
    topk_recall: int = 50
    topk_rerank: int = 10
    candidate_cut: str = "id"
    # scores
    weights: tuple[float, float, float, float] = (0.55, 0.25, 0.15, 0.05)
    ce_min_bi: float = 0.25
    ce_max_bi: float = 0.92
    prefilter_bi: float = 0.30
    prefilter_lex: float = 0.20
    penalties: tuple[float, float, float] = (0.5, 0.2, 0.15)
    citation_patterns: tuple[str, ...] = ("\\[[0-9]{1,3}\\]", "\\([0-9]{4}\\)", "theo .*?\\(")
    keep_per_chunk: int = 5
    # alignment
    min_len_local: int = 20
    iou_threshold: float = 0.6
    semantic_enabled: bool = True
    semantic_threshold: float = 0.78
    semantic_topk: int = 3
    semantic_min_coverage: float = 0.15
    min_span_chars: int = 24
    small_span_chars: int = 12
    min_small_spans: int = 2
    snippet_context_chars: int = 40
    # dictionaries
    stop_phrases: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()
    abbreviations: tuple[tuple[str, str], ...] = ()
    synonyms: tuple[tuple[str, str], ...] = ()
    raw: dict = field(default_factory=dict, compare=False, hash=False)


def deep_update(base: dict, over: dict) -> dict:
    """base with over's values; dictionaries in both are merged."""
    return {**base, **{k: deep_update(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


_PLACES = {
    "io": ("keep_tables", "ignore_sections"),
    "preprocess": ("lowercase", "unicode_normalize", "strip_zero_width", "mask_numbers", "abbreviations_expand", "synonyms_expand", "remove_stop_phrases", "remove_boilerplate"),
    "chunking": ("mode", "size_tokens", "overlap"),
    "ann": ("topk_recall", "topk_rerank"),
    "gating": ("ce_min_bi", "ce_max_bi", "prefilter_bi", "prefilter_lex"),
    "alignment": ("min_len_local", "iou_threshold", "semantic_enabled", "semantic_threshold", "semantic_topk", "semantic_min_coverage"),
    "report": ("snippet_context_chars",),
    "penalties": ("citation_patterns", "min_span_chars", "min_small_spans", "small_span_chars"),
}


def _placed(path: str, folder: str) -> str:
    """A path that a settings file names: beside the file or in a folder above it, or else as it stands."""
    if not path or os.path.isabs(path):
        return path
    at = os.path.abspath(folder)
    while True:
        if os.path.exists(found := os.path.join(at, path)):
            return found
        if at == (at := os.path.dirname(at)):
            return path


def dictionaries(raw: dict[str, Any], folder: str = ".") -> dict[str, Any]:
    """The settings that phrase lists and term maps give. Stop phrases and boilerplate must be there if they are named; maps, section headers and the domains'
    boilerplate (lower-cased, if it is enabled) may be missing."""
    paths = {k: _placed(v or "", folder) for k, v in (raw.get("dictionary_paths") or {}).items()}
    found = dicts.load(paths)
    domain = raw.get("domain_boilerplate") or {}
    more = [_placed(p, folder) for p in domain.get("paths") or ()] if domain.get("enabled") else []
    try:
        headers = dicts.phrase_list(paths.get("section_headers", ""))
    except (OSError, UnicodeError) as e:
        log.warning("section headers: %s", e)
        headers = []
    return {
        "stop_phrases": tuple(found.stop_phrases),
        "boilerplate": tuple(dicts.domain_boilerplate(found.boilerplate, more)),
        "abbreviations": tuple(found.abbreviations.items()),
        "synonyms": tuple(found.synonyms.items()),
        "section_headers": tuple(headers),
    }


def from_dict(raw: dict[str, Any], folder: str = ".") -> Config:
    """Settings from nested keys; the files they name are looked for from ``folder`` on. A file without chunking.mode means sentences."""
    got: dict[str, Any] = {"mode": (raw.get("chunking") or {}).get("mode", "sentence")} if raw else {}
    for section, names in _PLACES.items():
        for n in names:
            if n in (own := raw.get(section) or {}):
                got[n] = tuple(own[n]) if isinstance(own[n], list) else own[n]
    for name, section in (("bm25_topk", "bm25"), ("simhash_topk", "simhash")):
        if "topk" in (own := raw.get(section) or {}):
            got[name] = int(own["topk"])
    d = Config()
    w, p = raw.get("ranking_weights") or {}, raw.get("penalties") or {}
    got["weights"] = tuple(float(w.get(k, v)) for k, v in zip(("alpha", "beta", "gamma", "delta"), d.weights, strict=True))
    got["penalties"] = tuple(float(p.get(k, v)) for k, v in zip(("lex_boilerplate_lambda", "stopphrase_lambda", "citation_lambda"), d.penalties, strict=True))
    return replace(d, raw=raw, **got, **dictionaries(raw, folder))


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {}, os.path.dirname(path) or ".")


def hardware(path: str) -> dict:
    """A hardware file as it stands: its threads go to the executors (``thread_settings``), the rest is recorded in the report."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def thread_settings(hw: dict) -> dict[str, str]:
    """Spark settings for the numbers of threads of a hardware file."""
    device = hw.get("device") or {}
    return {f"spark.executorEnv.{name}": str(device.get(key, 8)) for name, key in (("OMP_NUM_THREADS", "omp_threads"), ("MKL_NUM_THREADS", "mkl_threads"))}


def device_config(hw: dict) -> dict:
    """What a neural plug-in is to be loaded with."""
    device = hw.get("device") or {}
    return {"use_gpu": bool(device.get("use_gpu", False)), "torch_dtype": device.get("torch_dtype", "float32")}


def view(cfg: Config) -> dict:
    """What a settings page shows."""
    return {f.name: getattr(cfg, f.name) for f in fields(cfg) if f.name not in ("raw", "stop_phrases", "boilerplate", "abbreviations", "synonyms")}


def with_settings(cfg: Config, settings: dict) -> Config:
    """Overrides from a settings page. Retrieval, chunks and penalties take effect; weights and thresholds that it
    may carry don't, and are only recorded."""
    live = {"bm25_topk", "simhash_topk", "topk_recall", "topk_rerank", "size_tokens", "overlap", "mode", "penalties"}
    return replace(cfg, raw=deep_update(cfg.raw, {"settings": settings}), **{k: v for k, v in settings.items() if k in live})


def page(cfg: Config) -> dict:
    """The settings as a page's form has them. Weights and thresholds are the form's own defaults, as they have no effect there."""
    return {
        "weights": {"w_cross": 0.55, "w_bi": 0.25, "w_lex": 0.10, "w_bm25": 0.10},
        "thresholds": {"very_high": 0.82, "high": 0.72, "medium": 0.60},
        "penalties": {"lex_boilerplate_lambda": cfg.penalties[0], "min_span_chars": cfg.min_span_chars, "small_span_chars": cfg.small_span_chars, "min_small_spans": cfg.min_small_spans},
        "retrieval": {"bm25_topk": cfg.bm25_topk, "ann_topk_recall": cfg.topk_recall, "rerank_topk": cfg.topk_rerank, "simhash_topk": cfg.simhash_topk},
        "chunking": {"size_tokens": cfg.size_tokens, "overlap": cfg.overlap},
    }


#: Where a form's retrieval settings stand among the keys of a file.
_FORM = {"bm25_topk": ("bm25", "topk"), "ann_topk_recall": ("ann", "topk_recall"), "rerank_topk": ("ann", "topk_rerank"), "simhash_topk": ("simhash", "topk")}


def with_page(cfg: Config, form: dict) -> Config:
    """The settings with what a page's form overrides, read as a file with those keys would be; the dictionaries stay."""
    over = {to: form[of] for of, to in (("penalties", "penalties"), ("weights", "ranking_weights"), ("thresholds", "decision_thresholds"), ("chunking", "chunking")) if of in form}
    for name, value in (form.get("retrieval") or {}).items():
        if name in _FORM:
            section, key = _FORM[name]
            over = deep_update(over, {section: {key: value}})
    raw = deep_update(cfg.raw, over)
    asked = from_dict({k: v for k, v in raw.items() if k not in ("dictionary_paths", "domain_boilerplate")})
    if not cfg.raw and "mode" not in (form.get("chunking") or {}):
        asked = replace(asked, mode=cfg.mode)
    return replace(asked, raw=raw, stop_phrases=cfg.stop_phrases, boilerplate=cfg.boilerplate, abbreviations=cfg.abbreviations, synonyms=cfg.synonyms, section_headers=cfg.section_headers)
