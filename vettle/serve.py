"""python -m vettle.serve [--host H] [--port P] [--output FOLDER]: batch jobs over HTTP.

A thin surface over `plans.screen`: jobs wait in a bounded line for one worker, whose Spark job uses the whole cluster;
finished reports are files under the output folder and are sent as they stand. Callers are limited by the token buckets
of `operators.folds`.
"""

from __future__ import annotations

import argparse
import json
import math
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from vettle.operators.folds import Lru, TokenBucket
from vettle.operators.service import rss_mb
from vettle.plans.screen import screen
from vettle.settings import Settings, load
from vettle.sources import files, sinks

# What the surface promises its callers.
WAITING, KEPT_JOBS, KEPT_SECONDS = 50, 1000, 86_400.0
WRITES, READS = (2.0, 0.1), (20.0, 2.0)  # burst, calls a second
CALLERS, CALLER_SECONDS = 10_000, 3600.0
FULL, DRAINING = ("Job queue full; backpressure active", 30), ("Service is draining and shutting down", 15)


@dataclass
class Job:
    job_id: str
    created_at: float
    status: str = "queued"
    started_at: float | None = None
    completed_at: float | None = None
    total_files: int = 0
    processed_files: int = 0
    error: str | None = None


class Line:
    """Jobs in the order in which they came, one at a time; the last `KEPT_JOBS` of a day are remembered."""

    def __init__(self, run: Callable[[Job, str, bool], None], size: int = WAITING):
        self.run, self.size, self.open = run, size, True
        self.jobs, self.waiting, self.latest = Lru(KEPT_JOBS, math.inf), [], None
        self.change = threading.Condition()
        self.worker = threading.Thread(target=self._work, daemon=True)
        self.worker.start()

    def submit(self, folder: str, enrich: bool) -> Job | tuple[str, int]:
        """The job, or why there is none and in how many seconds to ask again."""
        with self.change:
            if not self.open or len(self.waiting) >= self.size:
                return FULL if self.open else DRAINING
            job = Job(str(uuid.uuid4()), time.time())
            self.jobs.put(job.job_id, job, 0, job.created_at, KEPT_SECONDS)
            self.waiting.append((job, folder, enrich))
            self.change.notify_all()
            return job

    def find(self, job_id: str) -> Job | None:
        with self.change:
            return self.jobs.get(job_id, time.time())

    def _work(self) -> None:
        while True:
            with self.change:
                self.change.wait_for(lambda: self.waiting or not self.open)
                if not self.waiting:
                    return
                job, folder, enrich = self.waiting.pop(0)
                job.status, job.started_at = "running", time.time()
            try:
                self.run(job, folder, enrich)
                job.status, self.latest = "done", job.job_id
            except Exception as e:  # noqa: BLE001  told to who asks for the job
                job.status, job.error = "failed", str(e)
            job.completed_at = time.time()

    def drain(self, seconds: float = 15.0) -> None:
        with self.change:
            self.open = False
            self.change.notify_all()
        self.worker.join(seconds)


class Service:
    """What the addresses do; each returns (status, body, headers)."""

    def __init__(self, spark: SparkSession, output: str, settings: Settings, now: Callable[[], float] = time.time):
        self.spark, self.output, self.settings, self.now = spark, Path(output), settings, now
        self.began, self.refused, self.lock = now(), 0, threading.Lock()
        self.buckets = {limits: Lru(CALLERS, math.inf) for limits in (WRITES, READS)}
        self.line = Line(self.batch)

    def batch(self, job: Job, folder: str, enrich: bool) -> None:
        s = self.settings
        raw = files.load(self.spark, folder, s.min_chars)
        job.total_files = raw.count()
        sections = screen(raw, s).sections()  # no lookups are asked for here: enrichment is a table that a batch brings
        sinks.write_json(sections, str(self.output / f"{job.job_id}.json"))
        job.processed_files = job.total_files

    def limited(self, method: str, path: str, caller: str) -> tuple[bool, int, dict[str, str]]:
        limits = WRITES if method == "POST" and path.startswith("/screen") else READS
        with self.lock:
            held, now = self.buckets[limits], self.now()
            bucket = held.get(caller, now)
            if bucket is None:
                bucket = TokenBucket(now, *limits)
                held.put(caller, bucket, 0, now, CALLER_SECONDS)
            allowed, wait, left, reset = bucket.call(now)
            self.refused += not allowed
        told = {"X-RateLimit-Limit": str(int(limits[0])), "X-RateLimit-Remaining": str(int(left)), "X-RateLimit-Reset": str(int(reset))}
        again = max(1, math.ceil(wait))
        return allowed, again, told if allowed else told | {"Retry-After": str(again)}

    def post_screen(self, body: dict) -> tuple[int, dict, dict]:
        folder = body.get("input_dir", "./resumes")
        try:
            files.listing(self.spark, folder)
        except FileNotFoundError:
            return 404, {"detail": f"Input directory does not exist: {folder}"}, {}
        if body.get("sync"):
            job = Job(str(uuid.uuid4()), time.time())
            self.batch(job, folder, False)
            self.line.latest = job.job_id
            return 200, self.report(job.job_id)["summary"], {}
        job = self.line.submit(folder, bool(body.get("use_github", True)))
        if isinstance(job, tuple):
            return 503, {"detail": job[0]}, {"Retry-After": str(job[1])}
        return 202, {"job_id": job.job_id, "status": job.status, "message": "Job accepted for processing"}, {}

    def report(self, job_id: str) -> dict:
        return json.loads((self.output / f"{job_id}.json").read_text())

    def get_job(self, job_id: str) -> tuple[int, dict, dict]:
        job = self.line.find(job_id)
        return (200, asdict(job), {}) if job else (404, {"detail": f"Job not found: {job_id}"}, {})

    def get_results(self, job_id: str | None) -> tuple[int, dict, dict]:
        if job_id is None:
            return (200, self.report(self.line.latest), {}) if self.line.latest else (404, {"detail": "No run yet; POST /screen first"}, {})
        job = self.line.find(job_id)
        if job is None:
            return self.get_job(job_id)
        answers = {"done": lambda: (200, self.report(job_id), {}), "failed": lambda: (500, {"detail": job.error or "Job failed"}, {})}
        return answers.get(job.status, lambda: (400, {"detail": f"Job is still {job.status}; check /jobs/{job_id} for progress"}, {}))()

    def get_metrics(self) -> tuple[int, dict, dict]:
        held = [self.line.jobs, *self.buckets.values()]
        total = {n: sum(getattr(c, n) for c in held) for n in ("hits", "misses", "evictions", "expirations")}
        asked = total["hits"] + total["misses"]
        return 200, total | {"entries": sum(len(c.entries) for c in held), "hit_ratio": round(total["hits"] / asked, 4) if asked else 0.0, "rate_limited": self.refused, "memory_rss_mb": round(rss_mb(), 2)}, {}

    def get_health(self) -> tuple[int, dict, dict]:
        return 200, {"status": "ok", "uptime_seconds": round(self.now() - self.began, 2), "memory_rss_mb": round(rss_mb(), 2), "jobs_accepting": self.line.open}, {}

    def answer(self, method: str, path: str, body: dict, caller: str) -> tuple[int, dict, dict]:
        allowed, again, told = self.limited(method, path, caller)
        if not allowed:
            return 429, {"detail": "Too Many Requests", "retry_after": again}, told
        for verb, pattern, act in (
            ("POST", r"/screen", lambda m: self.post_screen(body)),
            ("GET", r"/jobs/(?:jobs/|jobs%2F)?([^/]+)", lambda m: self.get_job(m[1].strip())),
            ("GET", r"/results(?:/(?:jobs/|jobs%2F)?([^/]+))?", lambda m: self.get_results(m[1] and m[1].strip())),
            ("GET", r"/metrics", lambda m: self.get_metrics()),
            ("GET", r"/health", lambda m: self.get_health()),
        ):
            found = re.fullmatch(pattern, path)
            if found and verb == method:
                status, content, headers = act(found)
                return status, content, headers | told
        return 404, {"detail": "Not Found"}, told


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _serve(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            key = self.headers.get("X-API-Key")
            try:
                body = json.loads(raw) if raw else {}
                status, content, headers = service.answer(self.command, self.path.partition("?")[0], body, f"key:{key}" if key else f"ip:{self.client_address[0]}")
            except (json.JSONDecodeError, AttributeError):
                status, content, headers = 422, {"detail": "The body must be a JSON object"}, {}
            data = json.dumps(content, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in {"Content-Type": "application/json", "Content-Length": str(len(data)), **headers}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _serve

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vettle.serve", description="Batch jobs over HTTP.")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--output", default="./reports")
    p.add_argument("--config")
    a = p.parse_args(args)
    service = Service(SparkSession.builder.appName("vettle").getOrCreate(), a.output, load(a.config))
    http = server(service, a.host, a.port)
    try:
        http.serve_forever()
    finally:
        http.server_close()
        service.line.drain()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
