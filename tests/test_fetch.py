"""Online bundles against a server on this machine: what is asked for, how often, and how failures are told."""

import hashlib
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from marginalia.sources import bundles, fetch

COMMIT = "a" * 40
TEXTS = {
    "p1": {"main.tex": "\\input{parts/a}\\bibliography{refs}", "parts/a.tex": "A", "refs.bib": "@book{k, title={T}}", "unused.tex": "no"}, "p2": {"main.tex": "\\input{flaky}\\input{gone}", "flaky.tex": "F"},
    "p3": {"main.tex": "\\input{broken}\\input{slow}\\input{big}\\input{odd}\\input{fine}", "broken.tex": "", "slow.tex": "", "big.tex": "", "odd.tex": "", "fine.tex": "ok"},
}


@pytest.fixture
def server():
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path = self.path.lstrip("/")
            seen[path] += 1
            status, body = 200, None
            if path == "api/commits/main":
                body = json.dumps({"sha": COMMIT}).encode()
            elif path == f"api/contents/?ref={COMMIT}":
                body = json.dumps([{"type": "dir", "name": p} for p in TEXTS] + [{"type": "file", "name": "x"}]).encode()
            elif path.startswith(f"raw/{COMMIT}/"):
                paper, name = path.removeprefix(f"raw/{COMMIT}/").split("/", 1)
                body = TEXTS[paper].get(name, None)
                body = body.encode() if body is not None else None
                status = 404 if body is None else 500 if name == "broken.tex" or name == "flaky.tex" and seen[path] < 3 else 200
                if name == "slow.tex":
                    time.sleep(3)
                if name == "odd.tex":
                    body = b"\xff\xfe"
            else:
                status = 404
            self.send_response(status)
            self.send_header("Content-Length", str(99_999_999 if path.endswith("big.tex") else len(body or b"")))
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    at = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield fetch.Http(f"http://127.0.0.1:{at.server_port}/api", f"http://127.0.0.1:{at.server_port}/raw"), seen
    at.shutdown()


def test_online_bundles(spark, tmp_path, server):
    transport, seen = server
    online = bundles.Online(spark, transport, f"file://{tmp_path}/cache", seconds=1, pause=0.01)
    rows = online.bundle("p1").collect()
    texts = TEXTS["p1"]
    assert [(r.path, r.text) for r in rows] == [(k, texts[k]) for k in ("main.tex", "parts/a.tex", "refs.bib")]
    assert all(r.commit == COMMIT and r.bytes == len(r.text) and r.sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    assert sum(n for path, n in seen.items() if path.startswith("raw/")) == 3 and not any("unused" in path for path in seen)
    online.bundle("p1")  # the branch and the listing again, no file
    assert sum(n for path, n in seen.items() if path.startswith("raw/")) == 3
    offline = bundles.Online(spark, None, f"file://{tmp_path}/cache", offline=True)
    assert offline.bundle("p1").count() == 3
    with pytest.raises(OSError, match="not kept"):
        offline.bundle("p2")
    with pytest.raises(ValueError, match="not among"):
        online.bundle("p9")
    with pytest.raises(FileNotFoundError):
        bundles.Online(spark, None, f"file://{tmp_path}/none", offline=True).catalog()


def test_failures_are_rows(spark, tmp_path, server):
    """Of many papers at once: passing failures are tried again, lasting ones told with their cause, and the rest is had all the same."""
    transport, seen = server
    online = bundles.Online(spark, transport, f"file://{tmp_path}/cache", seconds=1, pause=0.01)
    files, failed = online.bundles()
    assert {(r.paper, r.path) for r in files.collect()} == {("p1", "main.tex"), ("p1", "parts/a.tex"), ("p1", "refs.bib"), ("p2", "main.tex"), ("p2", "flaky.tex"), ("p3", "main.tex"), ("p3", "fine.tex")}
    told = {(r.paper, r.path): (r.problem, r.attempts) for r in failed.collect()}
    assert told.pop(("p3", "slow.tex"))[0].startswith(("no answer within 1 s", "TimeoutError"))
    assert told == {("p2", "gone.tex"): ("answered 404", 1), ("p3", "broken.tex"): ("answered 500", 3), ("p3", "big.tex"): ("exceeds 8000000 bytes", 1), ("p3", "odd.tex"): ("is not UTF-8", 1)}
    assert seen[f"raw/{COMMIT}/p2/flaky.tex"] == 3 and seen[f"raw/{COMMIT}/p3/slow.tex"] == 3
    assert online.bundle("p2").count() == 2  # what the repository doesn't have is the import's to report
    with pytest.raises(fetch.FetchError, match=r"p3/big.tex: exceeds"):
        online.bundle("p3")
    assert (tmp_path / f"cache/bundles/{COMMIT}/p2.json").exists() and not (tmp_path / f"cache/bundles/{COMMIT}/p3.json").exists()
    with pytest.raises(OSError, match="answered 404"):
        online.request("nothing")


def test_time_limit():
    began = time.time()
    with pytest.raises(fetch.FetchError, match="no answer within 0.2 s"):
        fetch.asked(lambda _: time.sleep(5), "x", seconds=0.2)
    assert time.time() - began < 2
    with pytest.raises(fetch.FetchError, match="RuntimeError: odd"):
        fetch.asked(lambda _: (_ for _ in ()).throw(RuntimeError("odd")), "x")
