"""The HTTP surface on this machine: jobs from submission to report, limits, refusals."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from test_screening import DEEP, STOP, THIN

from vettle import serve
from vettle.settings import Settings


@pytest.fixture
def ask(spark, tmp_path):
    clock = [1000.0]
    service = serve.Service(spark, f"{tmp_path}/out", Settings(stop_words=STOP), lambda: clock[0])
    http = serve.server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(method, path, body=None, key="k"):
        data = body.encode() if isinstance(body, str) else json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data=data, method=method, headers={"X-API-Key": key})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read()), r.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    call.clock, call.service = clock, service
    yield call
    http.shutdown()
    http.server_close()
    service.line.drain(60)


def test_job_to_report(ask, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(DEEP)
    (tmp_path / "in" / "b.txt").write_text(THIN)
    assert ask("GET", "/results")[0] == 404 and ask("GET", "/jobs/none")[0] == 404 and ask("GET", "/results/none")[0] == 404
    assert ask("POST", "/screen", {"input_dir": f"{tmp_path}/nowhere"})[0] == 404
    status, body, headers = ask("POST", "/screen", {"input_dir": f"{tmp_path}/in", "use_github": False})
    assert status == 202 and body["status"] == "queued" and headers["X-RateLimit-Limit"] == "2"
    job = body["job_id"]
    for i in range(300):
        ask.clock[0] += 10
        status, told, _ = ask("GET", f"/jobs/jobs/{job}")
        if told["status"] in ("done", "failed"):
            break
        assert ask("GET", f"/results/{job}")[0] in (200, 400)
        time.sleep(0.3)
    assert told["status"] == "done" and (told["total_files"], told["processed_files"]) == (2, 2)
    ranked = ask("GET", f"/results/{job}")[1]
    assert [r["file"] for r in ranked["ranked_candidates"]][0] == "a.txt" and ask("GET", "/results")[1] == ranked
    assert ask("GET", "/health")[1]["jobs_accepting"] and ask("GET", "/health")[1]["memory_rss_mb"] > 1
    assert ask("GET", "/metrics")[1]["hits"] > 0


def test_limits_and_refusals(ask, tmp_path):
    body = {"input_dir": str(tmp_path / "nowhere")}
    assert [ask("POST", "/screen", body, "w")[0] for _ in range(3)] == [404, 404, 429]
    status, told, headers = ask("POST", "/screen", body, "w")
    assert (status, told["retry_after"], headers["Retry-After"], headers["X-RateLimit-Remaining"]) == (429, 10, "10", "0") and "X-RateLimit-Reset" in headers
    assert ask("GET", "/health", key="w")[0] == 200 and ask("POST", "/screen", body, "other")[0] == 404
    ask.clock[0] += 10
    assert ask("POST", "/screen", body, "w")[0] == 404 and ask("GET", "/nothing")[0] == 404 and ask("POST", "/screen", "[1", "x")[0] == 422
    assert ask("GET", "/metrics")[1]["rate_limited"] == 2
    ask.service.line.open = False
    (tmp_path / "in").mkdir()
    status, told, headers = ask("POST", "/screen", {"input_dir": f"{tmp_path}/in"}, "z")
    assert (status, headers["Retry-After"]) == (503, "15")


def test_line_is_bounded():
    go = threading.Event()
    line = serve.Line(lambda job, folder, enrich: go.wait(10) or None, 2)
    first = line.submit("a", False)
    while first.status == "queued":
        time.sleep(0.01)
    assert [isinstance(line.submit("a", False), serve.Job) for _ in range(3)] == [True, True, False]
    assert line.submit("a", False) == serve.FULL
    go.set()
    line.drain(10)
    assert first.status == "done" and line.submit("a", False) == serve.DRAINING


def test_a_failed_job_is_told():
    def fail(job, folder, enrich):
        raise ValueError("broken")

    line = serve.Line(fail)
    job = line.submit("a", False)
    line.drain(10)
    assert (job.status, job.error) == ("failed", "broken") and line.find(job.job_id) is job
