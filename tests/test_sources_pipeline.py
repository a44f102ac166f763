import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from weftline.cli import main
from weftline.functions import formats
from weftline.pipeline.config import PipelineError, parse
from weftline.pipeline.queue import Worker
from weftline.pipeline.runner import Runner, Secrets, run_tables
from weftline.pipeline.store import Definitions, Routes, Runs
from weftline.sources import files, http
from weftline.streaming.runner import deliver, folder_stream, windowed


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "a,b", 1.5), (2, 'say "x"', None)], "id long, s string, v double")


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "xml", "orc"])
def test_files_round_trip(spark, table, tmp_path, kind):
    path = str(tmp_path / "out")
    files.write(table, path, kind)
    got = files.read(spark, path, "jsonl" if kind == "json" else kind, rowTag="row")
    assert sorted(int(r["id"]) for r in got.collect()) == [1, 2]
    assert {r["s"] for r in got.collect()} == {"a,b", 'say "x"'}


def test_csv_options(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("# note\nid;who\n1;A\n2\n")
    assert [tuple(r) for r in files.read(spark, str(path), delimiter=";", skipRows=1).collect()] == [("1", "A"), ("2", "")]
    path.write_text("1,x\n2,y\n")
    assert files.read(spark, str(path), headers=False).columns == ["A", "B"]


def test_workbook_and_text(spark, tmp_path):
    import base64

    (tmp_path / "b.xlsx").write_bytes(base64.b64decode(formats.to_xlsx([{"a": "1"}, {"a": "2"}], {"sheet": "S"})))
    assert [r["a"] for r in files.read(spark, str(tmp_path / "b.xlsx"), sheet="S").collect()] == ["1", "2"]
    (tmp_path / "t.txt").write_text("x\ny\n")
    assert files.read(spark, str(tmp_path / "t.txt")).count() == 2
    assert files.format_of("a/b.JSON") == "json" and files.format_of("x", "text/csv; charset=utf-8") == "csv" and files.format_of("x.bin") == "binary"


@pytest.fixture
def server():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            got.append((self.command, self.path, body, self.headers.get("Authorization")))
            self.send_response(404 if "missing" in self.path else 200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(json.dumps({"items": [{"id": 1}, {"id": 2}]}).encode())

        do_GET = do_POST = _answer

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", got
    s.shutdown()


def test_http(spark, server):
    url, got = server
    assert http.fetch(http.Request(url + "/a", user="u", password="p"))["items"][1] == {"id": 2}
    assert got[-1][3].startswith("Basic ")
    with pytest.raises(OSError, match="404"):
        http.fetch(http.Request(url + "/missing"))
    assert http.send(http.Request(url + "/missing", accepted="2xx,404"))[0] == 404
    assert http.deliver(url + "/d", "[1]") == 200 and got[-1][:3] == ("POST", "/d", "[1]")
    spark.dataSource.register(http.HttpSource)
    assert spark.read.format("http_pages").option("urls", f"{url}/1 {url}/2").load().count() == 2


YAML = """
name: orders
mode: sync
sources:
  - name: prices
    map: "{ prices: $.rows[*] | select r => { sku: r.sku, price: r.p } }"
  - name: orders
    depends: prices
    map: |
      { orders: $.list[*] | select o => { id: o.id, total: o.n * ($idm.prices[*] | first p => p.sku == o.sku).price } }
  - name: parts
    depends: [orders]
    path: $.orders[*]
    map: "{ of: $slice.id, big: $.total > 10 }"
outputs:
  - name: report
    path: $.orders[*]
    map: $ | where o => o.total > 5
    contentType: csv
    response: true
    responseStatusCode: if $.orders.count() > 1 then 201 else 200
    destinations:
      - fileShare: { path: "out/{$.orders.count()}.csv" }
      - sftp: { host: x }
"""


def test_pipeline(tmp_path):
    pipeline = parse(YAML)
    result = Runner(state_folder=str(tmp_path / "state")).run(pipeline, {"prices": {"rows": [{"sku": "a", "p": 2}, {"sku": "b", "p": 9}]}, "orders": {"list": [{"id": 1, "sku": "a", "n": 2}, {"id": 2, "sku": "b", "n": 2}]}}, out_folder=str(tmp_path))
    assert result.document["parts"] == [{"of": 1, "big": False}, {"of": 2, "big": True}]
    assert result.response == [{"id": 2, "total": 18}] and result.status == 201
    assert (tmp_path / "out/2.csv").read_text() == "id,total\n2,18"
    assert len(result.errors) == 1 and "sftp" in result.errors[0]
    assert json.loads(next((tmp_path / "state").iterdir()).read_text())["status"] == "failed"


@pytest.mark.parametrize(("text", "word"), [("sources: [{name: a, depends: b}]", "depends on b"), ("sources: [{name: a, depends: b}, {name: b, depends: a}]", "each other"), ("sources: [{name: a}, {name: a}]", "one name"), ("mode: sync\noutputs: [{name: x}]", "response"), ("mode: async\noutputs: [{name: x, response: true}]", "no output")])
def test_pipeline_checks(text, word):
    with pytest.raises(PipelineError, match=word):
        parse(text)


def test_pipeline_over_tables(spark, tmp_path):
    pipeline = parse("sources: [{name: t, map: 't[*] | where x => x.id > 2'}]\noutputs: [{name: sums, map: 't[*] | groupBy x => x.id > 5 | select g => { k: g.key, n: (g.items | count) }', contentType: parquet, destinations: [{fileShare: {path: sums}}]}]")
    out = run_tables(spark, pipeline, {"t": spark.range(10)}, out_folder=str(tmp_path))
    assert dict(map(tuple, out["sums"].collect())) == {False: 3, True: 4}
    assert spark.read.parquet(str(tmp_path / "sums")).count() == 2


def test_secrets(monkeypatch):
    monkeypatch.setenv("A_KEY", "env")
    s = Secrets({"db": {"user": "me"}})
    assert s.resolve({"u": "$secrets.db.user/${A-KEY}/{$.n}"}, {"n": 5}) == {"u": "me/env/5"}


def test_stream_delivers_each_batch_once(spark, tmp_path):
    src = str(tmp_path / "src")
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    run = lambda: deliver(folder_stream(spark, src, "id long", files_each=1), "events[*] | where e => e.id >= 5 | select e => { id: e.id }", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5, 30))


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*30) ts, id % 2 k from range(10)").coalesce(1).write.parquet(str(tmp_path / "s"))
    out = windowed(folder_stream(spark, str(tmp_path / "s"), "ts timestamp, k long"), "ts", ["k"], "1 minute", "5 minutes", {"n": "count(*)"})
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 10


def test_cli(tmp_path, capsys):
    assert main(["eval", "$.a | sum", "--json", '{"a": [1, 2]}']) == 0 and capsys.readouterr().out.strip() == "3"
    (tmp_path / "s.weft").write_text("return $ | select x => { x: x }")
    (tmp_path / "d.json").write_text("[1, 2]")
    assert main(["run", str(tmp_path / "s.weft"), "--input", str(tmp_path / "d.json"), "--output-format", "csv"]) == 0 and capsys.readouterr().out.strip() == "x\n1\n2"
    (tmp_path / "p.yaml").write_text("sources: [{name: a, map: s.weft}]\noutputs: [{name: o, path: '$.a[*]'}]")
    assert main(["pipeline", "validate", str(tmp_path / "p.yaml")]) == 0
    capsys.readouterr()
    assert main(["pipeline", "run", str(tmp_path / "p.yaml"), "--source", f"a={tmp_path}/d.json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"o": [{"x": 1}, {"x": 2}]}
    assert main(["eval", "$.b", "--json", "{}"]) == 1


ASYNC = """
mode: async
sources:
  - name: prices
    map: prices.weft
  - name: rates
    map: "{ rate: $.r }"
  - name: orders
    depends: [prices, rates]
    map: "{ orders: $.list[*] | select o => { id: o.id, total: o.n * ($idm.prices[*] | first p => p.sku == o.sku).price * $idm.rate } }"
outputs:
  - name: sums
    map: "{ all: $.orders[*] | select o => o.total | sum }"
    destinations: [{ fileShare: { path: sums.json } }]
  - name: ids
    map: $.orders[*] | select o => o.id
"""
SCRIPT = "{ prices: $.rows[*] | select r => { sku: r.sku, price: r.p } }"
PAYLOADS = {"prices": {"rows": [{"sku": "a", "p": 2}]}, "rates": {"r": 3}, "orders": {"list": [{"id": 1, "sku": "a", "n": 2}]}}


def test_definitions_have_revisions(tmp_path):
    store = Definitions(tmp_path)
    assert store.ids() == [] and store.save("p", ASYNC, {"prices.weft": SCRIPT}, "first") == 1
    assert store.save("p", "sources: [{name: a}]") == 2 and [s.name for s in store.pipeline("p").sources] == ["a"]
    assert store.pipeline("p", 1).sources[0].map == SCRIPT and [(r.revision, r.message) for r in store.revisions("p")] == [(2, ""), (1, "first")]
    assert store.restore("p", 1) == 3 and store.load("p").scripts == {"prices.weft": SCRIPT}
    for bad in ("mode: sync", "sources: [{name: a, map: none.weft}]"):
        with pytest.raises(PipelineError):
            store.save("p", bad)
    assert store.ids() == ["p"] and store.load("p").revision == 3
    store.delete("p")
    with pytest.raises(PipelineError, match="no pipeline p"):
        store.load("p")
    assert store.ids() == [] and store.restore("p", 1) == 5 and store.ids() == ["p"]
    for bad in ("../p", "", ".x", "a/b"):
        with pytest.raises(PipelineError, match="can't name"):
            store.save(bad, "sources: []")


def test_routes(tmp_path):
    routes = Routes(tmp_path / "routes.json")
    routes.add("post", "/orders/{id}", "one")
    routes.add("POST", "orders/new", "two")
    assert routes.find("POST", "orders/7") == ("one", {"id": "7"}) and routes.find("post", "/orders/new/") == ("two", {})
    assert routes.find("GET", "orders/7") is None and routes.find("POST", "orders") is None
    routes.remove("one")
    assert routes.find("POST", "orders/7") is None


def test_runs_are_forgotten(tmp_path):
    runs = Runs(tmp_path, lifetime=0.2)
    runs.put("a", {"x": 1})
    assert runs.get("a") == {"x": 1} and runs.ids() == ["a"] and runs.purge() == 0
    time.sleep(0.25)
    assert runs.get("a") is None and runs.ids() == [] and runs.purge() == 1 and runs.purge() == 0


def worker(tmp_path, **more):
    store = Definitions(tmp_path / "defs")
    store.save("p", ASYNC, {"prices.weft": SCRIPT})
    return Worker(tmp_path / "work", store, out_folder=str(tmp_path / "out"), **more)


def test_queued_steps(tmp_path):
    one = worker(tmp_path)
    run = one.start("p", PAYLOADS)
    one.definitions.save("p", "sources: []")  # a run keeps its revision
    assert one.work(1) == 1 and one.status(run)["status"] == "running" and one.status(run)["steps"]["source orders"] == "pending"
    two = Worker(tmp_path / "work", one.definitions, out_folder=str(tmp_path / "out"))
    two.work()
    told = two.status(run)
    assert told["status"] == "completed" and set(told["steps"].values()) == {"completed"} and told["errors"] == []
    assert json.loads((tmp_path / "out/sums.json").read_text()) == {"all": 12} and two.runs.get(run, "output ids")["value"] == [1]
    assert one.status("none")["status"] == "unknown"


def test_a_message_that_comes_again_changes_nothing(tmp_path):
    w = worker(tmp_path)
    run = w.start("p", PAYLOADS)
    for step in ("source prices", "source prices", "source rates", "source prices"):
        w.handle(run, step)
    w.work()
    tries = {s: w.runs.get(run, s)["tries"] for s in w.status(run)["steps"]}
    assert w.status(run)["status"] == "completed" and set(tries.values()) == {1}


def test_a_lost_worker_s_message_returns(tmp_path):
    w = worker(tmp_path, lease=0.1)
    run = w.start("p", PAYLOADS)
    assert w.queue.take() and w.queue.take() and w.queue.take() is None
    time.sleep(0.15)
    w.work()
    assert w.status(run)["status"] == "completed"


def test_a_step_that_fails_is_tried_again(tmp_path):
    w = worker(tmp_path, attempts=2)
    run = w.start("p", {**PAYLOADS, "orders": {"list": [{"id": 1, "sku": "none", "n": 2}], "odd": 1}, "rates": {}})
    w.work()
    told = w.status(run)
    assert told["status"] == "failed" and told["steps"]["source rates"] == "failed" and w.runs.get(run, "source rates")["tries"] == 2 and told["errors"]


def test_workers_share_a_queue(tmp_path):
    w = worker(tmp_path)
    runs = [w.start("p", PAYLOADS) for _ in range(12)]
    workers = [threading.Thread(target=lambda: [Worker(tmp_path / "work", w.definitions, out_folder=str(tmp_path / "out")).work() for _ in range(3)]) for _ in range(4)]
    for t in workers:
        t.start()
    for t in workers:
        t.join()
    w.work()
    assert {w.status(r)["status"] for r in runs} == {"completed"}
