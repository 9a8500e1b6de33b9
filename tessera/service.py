"""The comparison over HTTP, by the standard library alone: python -m tessera.service [--port N] [--config FILE] [--hardware FILE]

GET /health, POST /compare (JSON: a, b, out, config, hardware), GET /api/report?path=, GET /api/settings?config=, POST /api/compare (a form with two
files a and b, and out, config, hardware, settings), GET /api/export_csv?report_path=, GET /api/download_report_html?path=, GET /. A request waits for its result."""

from __future__ import annotations

import argparse
import csv
import io
import json
import logging
import os
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from . import config
from .functions import models
from .plans import compare as comparing
from .sources import report

log = logging.getLogger(__name__)
PAGE = (
    '<!doctype html><meta charset="utf-8"><title>Overlap of two documents</title><form method="post" action="/api/compare" enctype="multipart/form-data">'
    '<p>A <input type="file" name="a"> B <input type="file" name="b"> <input name="out" value="report"> <button>Compare</button></form>'
)


class Failure(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def form(body: bytes, content_type: str) -> dict[str, tuple[str | None, bytes]]:
    """The fields of a multipart form: name to (file name, content)."""
    whole = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode("latin-1") + b"\r\n\r\n" + body)
    if not whole.is_multipart():
        raise Failure(400, "a multipart form is needed")
    return {part.get_param("name", header="content-disposition"): (part.get_filename(), part.get_payload(decode=True) or b"") for part in whole.iter_parts()}


class Service:
    """What the routes do. The models are those it was made with, whatever a request's settings say."""

    def __init__(self, spark: SparkSession, settings: str | None = None, hardware: str | None = None, embedder: models.Embedder | None = None, scorer: models.PairScorer | None = None):
        self.spark, self.settings, self.hardware, self.models = spark, settings, hardware, {"embedder": embedder, "scorer": scorer}

    def _config(self, path: str | None) -> config.Config:
        path = path or self.settings
        return config.load(path) if path else config.Config()

    def _hardware(self, path: str | None) -> dict:
        path = path or self.hardware
        return config.hardware(path) if path else {}

    def compare(self, request: dict) -> dict:
        if not request.get("a") or not request.get("b"):
            raise Failure(422, "a and b are needed")
        return comparing.compare(self.spark, request["a"], request["b"], request.get("out"), self._config(request.get("config")), self._hardware(request.get("hardware")), **self.models)

    def upload(self, fields: dict[str, tuple[str | None, bytes]]) -> dict:
        said = lambda name: (fields.get(name) or (None, b""))[1].decode("utf-8")
        files = [fields.get(name) or (None, b"") for name in ("a", "b")]
        if not all((name or "").lower().endswith(".docx") for name, _ in files):
            raise Failure(400, "two .docx files are needed")
        cfg = self._config(said("config"))
        if said("settings"):
            try:
                cfg = config.with_page(cfg, json.loads(said("settings")))
            except (ValueError, TypeError, AttributeError) as e:
                log.warning("settings that can't be read: %s", e)
        out = said("out") or "report"
        os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
        got = comparing.compare_uploads(self.spark, *files, out, cfg, hardware=self._hardware(said("hardware")), **self.models)
        return {"ok": True, "out": out, "report_json": f"{out}.json", "report_html": f"{out}.html", "summary": got["summary"]}

    def _stored(self, path: str) -> str:
        if not path.lower().endswith(".json") or not os.path.exists(path):
            raise Failure(404, "no such report")
        return path

    def report(self, path: str) -> dict:
        return report.normalized(self.spark, self._stored(path))

    def csv(self, path: str) -> str:
        out = io.StringIO()
        rows = report.csv_rows(report.read_pairs(self.spark, self._stored(path)))
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        writer.writerows(rows.collect())  # one comparison's
        return out.getvalue()

    def html(self, path: str) -> str:
        if not os.path.exists(path):
            raise Failure(404, "no such page")
        with open(path, encoding="utf-8") as f:
            return f.read()


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body, kind: str = "application/json", status: int = 200, name: str = "") -> None:
            raw = (json.dumps(body, ensure_ascii=False, default=str) if kind == "application/json" else body).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            if name:
                self.send_header("Content-Disposition", f'attachment; filename="{name}"')
            self.end_headers()
            self.wfile.write(raw)

        def _answer(self, routes: dict) -> None:
            at = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(at.query).items()}
            try:
                if at.path not in routes:
                    raise Failure(404, "no such route")
                routes[at.path](asked)
            except Failure as e:
                self._send({"detail": str(e)}, status=e.status)
            except FileNotFoundError as e:
                self._send({"detail": f"no such file: {e}"}, status=404)
            except Exception as e:  # noqa: BLE001  a request that fails doesn't end the service
                log.exception("request failed")
                self._send({"detail": str(e)}, status=500)

        def do_GET(self) -> None:
            self._answer(
                {
                    "/": lambda q: self._send(PAGE, "text/html"),
                    "/health": lambda q: self._send({"ok": True}),
                    "/api/report": lambda q: self._send(service.report(q.get("path", ""))),
                    "/api/settings": lambda q: self._send(config.page(service._config(q.get("config")))),
                    "/api/export_csv": lambda q: self._send(service.csv(q.get("report_path", "")), "text/csv", name="report_export.csv"),
                    "/api/download_report_html": lambda q: self._send(service.html(q.get("path", "")), "text/html", name="report.html"),
                }
            )

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self._answer(
                {
                    "/compare": lambda q: self._send(service.compare(json.loads(body))),
                    "/api/compare": lambda q: self._send(service.upload(form(body, self.headers.get("Content-Type", "")))),
                }
            )

        def log_message(self, *args) -> None:
            log.info(*args)

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(service))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--config")
    p.add_argument("--hardware")
    args = p.parse_args(argv)
    hw = config.hardware(args.hardware) if args.hardware else {}
    spark = SparkSession.builder.appName("tessera").config(map=config.thread_settings(hw) if hw else {}).getOrCreate()
    serve(Service(spark, args.config, args.hardware), args.host, args.port).serve_forever()


if __name__ == "__main__":
    main()
