"""A small service over the ask query: health, questions, evaluation results."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators import ask
from quillspan.operators.learned import RiskModel, SpanReader


class Service:
    """Answers requests over one corpus. ``results`` is a JSON file of evaluation results, ``log`` the folder of the query log."""

    def __init__(self, spark: SparkSession, passages: DataFrame, reader: SpanReader, risk: RiskModel, threshold: float = 0.5, results: str | None = None, log: str | None = None) -> None:
        self.spark, self.passages, self.reader, self.risk, self.threshold, self.results, self.log = spark, passages, reader, risk, threshold, results, log

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        """The status and the object that a request gets."""
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok", "passages": self.passages.count()}
        if (method, path) == ("GET", "/evaluate"):
            if not self.results or not os.path.exists(self.results):
                return 404, {"detail": "no evaluation results"}
            with open(self.results, encoding="utf-8") as f:
                return 200, json.load(f)
        if (method, path) == ("POST", "/ask"):
            body = body or {}
            question, threshold, k = body.get("question") or "", body.get("threshold"), body.get("k")
            try:
                ask.check_request(question, threshold, k)
            except ValueError as e:
                return 422, {"detail": str(e)}
            asked = self.spark.createDataFrame([("asked", question)], "qid string, question string")
            response = ask.ask(asked, self.passages, self.reader, self.risk, self.threshold if threshold is None else threshold, k or 5)
            row = ask.as_json(response).first()
            if self.log:
                ask.append_log(response, self.log)
            return 200, json.loads(row["body"])
        return 404, {"detail": "not found"}

    def serve(self, port: int = 8000) -> ThreadingHTTPServer:
        """A server on this port; call its ``serve_forever``."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self, method: str) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                try:
                    body = json.loads(self.rfile.read(size)) if size else None
                    status, out = service.handle(method, self.path, body)
                except json.JSONDecodeError:
                    status, out = 422, {"detail": "the body is no JSON"}
                data = json.dumps(out).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:  # noqa: N802  the base class names it
                self._reply("GET")

            def do_POST(self) -> None:  # noqa: N802
                self._reply("POST")

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)
