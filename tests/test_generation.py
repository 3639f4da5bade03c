"""Calls with outcomes, and the verdict on repeated runs."""

import http.server
import json
import tempfile
import threading
import time

import pytest

from quillspark.operators import evaluation, generation

RUNS = {"n": 0}


def test_attempts():
    def call(p):
        RUNS["n"] += 1
        if p == "slow":
            time.sleep(5)
        if p == "bad" or (p == "second" and RUNS["n"] == 1):
            raise RuntimeError("no")
        return p.upper()

    assert generation.tried(call, "second", 2, 1)[:4] == ("ok", "SECOND", None, 2)
    assert generation.tried(call, "bad", 2, 2)[:4] == ("error", None, "RuntimeError: no", 3)
    outcome, answer, error, n, elapsed = generation.tried(call, "slow", 0.1, 0)
    assert (outcome, answer, n) == ("timeout", None, 1) and "0.1 s" in error and elapsed < 2


def make_call(log, fail):
    def call(p):
        import time as t

        with open(log, "a") as f:
            f.write(p + "\n")
        if p.startswith("slow"):
            t.sleep(3)
        if fail and p.startswith("bad"):
            raise ValueError("down")
        return "answer to " + p

    return call


def test_outcomes_and_resumed_run(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    asked = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "slow one"), (4, None), (5, "good")], "query_id int, prompt string")
    first = {r.query_id: r for r in generation.answered(asked, make_call(f"{root}/log1", True), f"{root}/out", {"seed": 1}, limit=1, retries=1, tasks=2).collect()}
    assert {k: r.outcome for k, r in first.items()} == {1: "ok", 2: "error", 3: "timeout", 4: None, 5: "ok"}
    assert first[1].raw_answer == "answer to good" and first[2].error == "ValueError: down" and first[2].attempts == 2 and first[3].attempts == 2
    again = {r.query_id: r for r in generation.answered(asked, make_call(f"{root}/log2", False), f"{root}/out", {"seed": 1}, limit=20, tasks=2).collect()}
    assert {k: r.outcome for k, r in again.items()} == {1: "ok", 2: "ok", 3: "ok", 4: None, 5: "ok"}
    assert sorted(open(f"{root}/log1").read().split("\n")).count("good") == 1
    assert sorted(open(f"{root}/log2").read().split("\n")) == ["", "bad one", "slow one"]
    generation.answered(asked, make_call(f"{root}/log3", False), f"{root}/out", {"seed": 2}, limit=20, tasks=2).count()
    assert len(open(f"{root}/log3").read().split()) == 5  # other options, other prompts


class Handler(http.server.BaseHTTPRequestHandler):
    def _send(self, body):
        data = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self._send({"version": "1.2"} if self.path == "/api/version" else {"models": [{"name": "m", "digest": "abc"}]})

    def do_POST(self):
        given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self._send({"response": None} if given["prompt"] == "empty" else {"response": f" {given['prompt']} {given['options']['seed']} {given['stream']} {'think' in given} "})

    def log_message(self, *a):
        pass


def test_model_server():
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as web:
        threading.Thread(target=web.serve_forever, daemon=True).start()
        m = generation.ModelServer(f"http://127.0.0.1:{web.server_port}/", "m", seed=7)
        assert m("hi") == "hi 7 False False" and m.identity() == {"version": "1.2", "digest": "abc", "error": None}
        with pytest.raises(ValueError):
            m("empty")
        assert generation.ModelServer(m.url, "other").identity()["error"] == "digest_missing"
        web.shutdown()
    assert "version_unavailable" in m.identity()["error"] and m.provenance()["think_source"] == "unset"
    assert generation.ModelServer("x", "m", think=True).payload("p")["think"] is True


def test_verification(spark):
    runs = spark.createDataFrame([("a", "x", "x", "[]"), ("a", "x", "x", "[]"), ("b", None, "y", "[]"), ("b", None, "y", "[1]")], "case_id string, raw_answer string, final_answer string, evidence_json string")
    both = evaluation.verification(evaluation.stability(runs), "VERIFIED", 2).first()
    assert (both.case_count, both.unstable_cases, both.raw_answers_match, both.evidence_matches, both.repeated_run_stability_verified) == (2, 1, True, False, False)
    one = evaluation.stability(evaluation.stability_cases(runs, ["a"]))
    assert evaluation.verification(one, "VERIFIED", 2, {"seed": 1}).first().repeated_run_stability_verified
    assert not evaluation.verification(one, "VERIFIED", 3).first().repeated_run_stability_verified
    assert not evaluation.verification(one, "ENVIRONMENT_UNAVAILABLE", 2, error="down").first().repeated_run_stability_verified
    assert not evaluation.verification(one.where("false"), "VERIFIED", 2).first().repeated_run_stability_verified
    with pytest.raises(ValueError, match="zz"):
        evaluation.stability_cases(runs, ["a", "zz"])
