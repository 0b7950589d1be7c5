"""Paged endpoints: resuming, limits on requests, failures as rows, page limits."""

from __future__ import annotations

import http.server
import json
import threading

import pytest

from vigilspark.sources import endpoints


def drain(spark, folder, addresses, tmp_path, **options):
    """One run over all there is; the rows of this run."""
    before = spark.read.schema(endpoints.SCHEMA).parquet(f"{tmp_path}/rows").collect() if (tmp_path / "rows").exists() else []
    rows = endpoints.stream(spark, addresses, f"file://{tmp_path}/progress", **({"folder": f"file://{folder}"} if folder else {}), **options)
    query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    after = spark.read.schema(endpoints.SCHEMA).parquet(f"{tmp_path}/rows").collect()
    return sorted(set(map(tuple, after)) - set(map(tuple, before)), key=str), len(after)


def put(folder, address, cursor, items, following=None):
    at = folder / f"address={address}" / f"cursor={cursor}"
    at.mkdir(parents=True, exist_ok=True)
    (at / "part-0.txt").write_text(json.dumps({"items": items} | ({"next": following} if following else {})))


def test_a_run_resumes_where_the_last_one_ended(spark, tmp_path):
    folder = tmp_path / "pages"
    for a, pages in (("x", 5), ("y", 1), ("z", 3)):
        for p in range(pages):
            put(folder, a, p, [f"{a}{p}-{i}" for i in range(3)], str(p + 1) if p + 1 < pages else None)
    rows, n = drain(spark, folder, ["x", "y", "z"], tmp_path, pages=2, tasks=2)
    assert n == 27 and sorted(json.loads(r[5]) for r in rows) == sorted(f"{a}{p}-{i}" for a, k in (("x", 5), ("y", 1), ("z", 3)) for p in range(k) for i in range(3))
    assert {r[1] for r in rows if r[0] == "x"} == {1, 2, 3} and all(r[4] == 200 for r in rows)
    assert drain(spark, folder, ["x", "y", "z"], tmp_path, pages=2, tasks=2)[1] == 27
    put(folder, "y", 0, ["y0-0", "y0-1", "y0-2", "new"], "1")
    put(folder, "y", 1, ["newer"])
    rows, n = drain(spark, folder, ["x", "y", "z"], tmp_path, pages=2, tasks=2)
    assert n == 29 and [(r[0], r[2], r[3], json.loads(r[5])) for r in rows] == [("y", 0, 3, "new"), ("y", 1, 0, "newer")]


def test_rounds_grow_until_an_address_ends(spark, tmp_path):
    folder = tmp_path / "pages"
    for a, pages in (("x", 60), ("y", 3)):
        for p in range(pages):
            put(folder, a, p, [p], str(p + 1) if p + 1 < pages else None)
    rows, n = drain(spark, folder, ["x", "y"], tmp_path, pages=2, growth=3)
    assert n == 63 and sorted((r[0], r[2], json.loads(r[5])) for r in rows) == sorted((a, p, p) for a, k in (("x", 60), ("y", 3)) for p in range(k))
    assert [sum(r[0] == "x" and r[1] == k for r in rows) for k in range(1, 6)] == [2, 6, 18, 34, 0]
    put(folder, "x", 59, [59], "60")
    for p in range(60, 66):
        put(folder, "x", p, [p], str(p + 1) if p < 65 else None)
    rows, n = drain(spark, folder, ["x", "y"], tmp_path, pages=2, growth=3)
    assert n == 69 and [r[2] for r in sorted(rows, key=lambda r: r[2])] == list(range(60, 66))


def test_failures_are_rows_and_are_asked_again(spark, tmp_path):
    folder = tmp_path / "pages"
    put(folder, "good", 0, [1])
    put(folder, "half", 0, [1], "1")
    (folder / "address=bad" / "cursor=0").mkdir(parents=True)
    (folder / "address=bad" / "cursor=0" / "part-0.txt").write_text("no JSON")
    rows, _ = drain(spark, folder, ["good", "half", "bad", "gone"], tmp_path, wait=0)
    assert [(r[0], r[2], r[4], r[5]) for r in rows] == [("bad", 0, endpoints.BAD_PAGE, None), ("gone", 0, 404, None), ("good", 0, 200, "1"), ("half", 0, 200, "1"), ("half", 1, 404, None)]
    held = spark.read.schema(endpoints.SCHEMA).parquet(f"{tmp_path}/rows")
    assert sorted((r["address"], r["page"], r["status"]) for r in endpoints.failures(held).collect()) == [("bad", 0, endpoints.BAD_PAGE), ("gone", 0, 404), ("half", 1, 404)]
    put(folder, "half", 1, [2])
    put(folder, "gone", 0, [3])
    rows, _ = drain(spark, folder, ["good", "half", "bad", "gone"], tmp_path, wait=0)
    assert [(r[0], r[2], r[4], r[5]) for r in rows] == [("bad", 0, endpoints.BAD_PAGE, None), ("gone", 0, 200, "3"), ("half", 1, 200, "2")]
    held = spark.read.schema(endpoints.SCHEMA).parquet(f"{tmp_path}/rows")
    assert [r["address"] for r in endpoints.failures(held).collect()] == ["bad"]


def test_a_page_limit_is_reported_or_raised(spark, tmp_path):
    folder = tmp_path / "pages"
    for p in range(6):
        put(folder, "x", p, [p], str(p + 1))
    rows, _ = drain(spark, folder, ["x"], tmp_path, maxpages=4, pages=3)
    assert [(r[2], r[4]) for r in rows] == [(0, 200), (1, 200), (2, 200), (3, 200), (4, endpoints.CAPPED)]
    assert "stopped after 4 pages at cursor 4" in rows[-1][6]
    (tmp_path / "other").mkdir()
    with pytest.raises(Exception, match="stopped after 4 pages"):
        drain(spark, folder, ["x"], tmp_path / "other", maxpages=4, oncap="raise")


def test_pages_are_written_by_all_cores(spark, tmp_path):
    pages = spark.range(200).coalesce(1).selectExpr("'x' AS address", "cast(id AS string) AS cursor", "'{\"items\": [1]}' AS body")
    endpoints.write_pages(pages, f"file://{tmp_path}/pages")
    files = [p.name for p in (tmp_path / "pages").rglob("part-*.txt")]
    assert len(files) == 200 and len({f.split("-")[1] for f in files}) == spark.sparkContext.defaultParallelism
    assert endpoints.FolderFetch(f"file://{tmp_path}/pages")("x", "7") == (200, '{"items": [1]}\n')


class Server(http.server.BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        status = 429 if "/slow/" in self.path and n < 3 else 503 if "/down/" in self.path else 200
        body = json.dumps({"items": [self.path], **({"next": "b"} if self.path.endswith("/a") else {})}).encode() if status == 200 else b"try later"
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_requests_wait_after_a_refusal(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows, _ = drain(spark, None, ["slow", "down", "fine"], tmp_path, url=f"http://127.0.0.1:{server.server_port}/{{address}}/{{cursor}}", start="a", wait=0.01)
    finally:
        server.shutdown()
    assert [(r[0], r[2], r[4], r[6]) for r in rows] == [("down", 0, 503, "try later"), ("fine", 0, 200, None), ("fine", 1, 200, None), ("slow", 0, 200, None), ("slow", 1, 200, None)]
    assert Server.asked["/slow/a"] == 3 and Server.asked["/down/a"] == 3


def test_waits_double_and_the_last_answer_counts():
    answers, waits = [(429, "a"), OSError("gone"), (500, "b"), (503, "c")], []

    def fetch(address, cursor):
        got = answers.pop(0)
        if isinstance(got, OSError):
            raise got
        return got

    assert endpoints.patient(fetch, "x", "0", tries=4, wait=1.0, sleep=waits.append) == (503, "c")
    assert waits == [1.0, 2.0]
    assert endpoints.patient(lambda a, c: (_ for _ in ()).throw(OSError("no route")), "x", "0", tries=2, sleep=waits.append) == (endpoints.NO_ANSWER, "no route")


def test_a_second_endpoint_answers_where_the_first_does_not():
    def one(address, cursor):
        if cursor == "0":
            return 200, "first"
        if cursor == "1":
            raise OSError("gone")
        return 503, "busy"

    both = endpoints.AnyOf(one, lambda a, c: (200, "second") if c != "3" else (404, "none"))
    assert [both("x", c) for c in "0123"] == [(200, "first"), (200, "second"), (200, "second"), (404, "none")]
