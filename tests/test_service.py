"""The service over HTTP."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from tessera import config, service
from tessera.sources import docx

TEXT = "Mái trường bền vững cần nguồn học liệu phong phú để sinh viên rèn luyện kỹ năng phân tích dữ liệu hiện đại và áp dụng vào đồ án."


@pytest.fixture(scope="module")
def url(spark):
    server = service.serve(service.Service(spark), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def get(url, **more):
    with urllib.request.urlopen(urllib.request.Request(url, **more), timeout=300) as r:
        return r.headers, r.read()


def status(url, **more):
    with pytest.raises(urllib.error.HTTPError) as e:
        get(url, **more)
    return e.value.code


def multipart(fields):
    body = b""
    for name, (file, raw) in fields.items():
        body += f'--xyz\r\nContent-Disposition: form-data; name="{name}"'.encode() + (f'; filename="{file}"\r\nContent-Type: application/octet-stream' if file else "").encode() + b"\r\nContent-Transfer-Encoding: binary\r\n\r\n" + raw + b"\r\n"
    return {"data": body + b"--xyz--\r\n", "headers": {"Content-Type": "multipart/form-data; boundary=xyz"}, "method": "POST"}


def test_routes(url, tmp_path):
    assert json.loads(get(f"{url}/health")[1]) == {"ok": True} and b"<form" in get(f"{url}/")[1]
    assert json.loads(get(f"{url}/api/settings")[1])["retrieval"]["bm25_topk"] == 30
    a, b = tmp_path / "a.docx", tmp_path / "b.docx"
    a.write_bytes(docx.build([TEXT], []))
    b.write_bytes(docx.build(["Lời khác.", TEXT], []))
    got = json.loads(get(f"{url}/compare", data=json.dumps({"a": str(a), "b": str(b), "out": str(tmp_path / "one")}).encode(), method="POST")[1])
    assert got["summary"]["pairs"] >= 1
    out = str(tmp_path / "sub/two")
    asked = {"a": ("A.docx", a.read_bytes()), "b": ("b.DOCX", b.read_bytes()), "out": (None, out.encode()), "settings": (None, json.dumps({"retrieval": {"bm25_topk": 2}}).encode())}
    made = json.loads(get(f"{url}/api/compare", **multipart(asked))[1])
    assert made["ok"] and made["summary"] == got["summary"]
    stored = json.loads(get(f"{url}/api/report?path={out}.json")[1])
    assert len(stored["pairs"]) == made["summary"]["pairs"] and stored["meta"]["cfg"]["bm25_topk"] == 2
    headers, rows = get(f"{url}/api/export_csv?report_path={out}.json")
    assert rows.decode().splitlines()[0] == "score,level,a_chunk_id,b_chunk_id,a_text,b_text" and "attachment" in headers["Content-Disposition"]
    assert b"<mark>" in get(f"{url}/api/download_report_html?path={out}.html")[1]


def test_failures(url, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    assert status(f"{url}/none") == status(f"{url}/api/report?path=/none.json") == status(f"{url}/api/download_report_html?path=/none") == 404
    assert status(f"{url}/api/report?path={tmp_path}/bad.json") == 500
    assert status(f"{url}/api/compare", **multipart({"a": ("a.txt", b"x"), "b": ("b.docx", b"x")})) == 400
    assert status(f"{url}/compare", data=b"{}", method="POST") == 422
    assert status(f"{url}/compare", data=json.dumps({"a": "/none.docx", "b": "/none.docx"}).encode(), method="POST") == 404


def test_form_settings():
    c = config.with_page(config.Config(stop_phrases=("x",)), {"retrieval": {"bm25_topk": 7, "ann_topk_recall": 8, "rerank_topk": 9, "simhash_topk": 10}, "chunking": {"size_tokens": 99}, "penalties": {"min_span_chars": 5}, "weights": {"w_cross": 1}})
    assert (c.bm25_topk, c.topk_recall, c.topk_rerank, c.simhash_topk, c.size_tokens, c.min_span_chars, c.stop_phrases, c.mode, c.weights) == (7, 8, 9, 10, 99, 5, ("x",), "paragraph", config.Config().weights)
    assert config.page(c)["chunking"]["size_tokens"] == 99
