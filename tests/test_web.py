"""The live connector against a local server: statuses, bad bodies, redirects, slowness,
the cache, and what is asked how often."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest

from glosswerk import cli
from glosswerk.operators import registry
from glosswerk.sources import web

WORK = {"DOI": "10.1/ok", "title": ["A title of some length"], "author": [{"family": "Roe", "given": "J."}, {"family": "Doe"}], "container-title": ["Journal"], "published": {"date-parts": [[2010, 1]]}, "score": 77.5}
ITEM = '<li id="bib.1">A (2010). {}. Venue. <a href="https://doi.org/{}">x</a></li>'
PAGE = "<html>References" + ITEM.format("A title of some length", "10.1/ok") + ITEM.format("Something else that is claimed", "10.1/ok") + ITEM.format("Nowhere to be found", "10.1/missing")
FEED = '<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><published>2024-01-02</published><category term="cs.AI"/><title>A paper</title><author><name>A. A</name></author></entry></feed>'


@pytest.fixture
def server():
    asked, times = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path = unquote(self.path)
            asked[path] += 1
            times.append(time.monotonic())
            name = path.split("/")[-1]
            status, body, onward = 404, "Resource not found.", None
            if "query.bibliographic=" in path:
                status, body = 200, json.dumps({"message": {"items": [WORK]}})
            elif path.startswith("/works/") and (name in ("ok", "a (b) 'c' & d") or name.startswith("n")):
                status, body = 200, json.dumps({"message": WORK})
            elif name == "bad":
                status, body = 200, '{"mess'
            elif name == "down" or (name == "flaky" and asked[path] == 1):
                status, body = 503, ""
            elif name == "flaky":
                status, body = 200, json.dumps({"message": WORK})
            elif name == "slow":
                time.sleep(1.5)
            elif name == "drip":
                self.send_response(200)
                self.end_headers()
                for _ in range(40):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.05)
                return
            elif name in ("loop", "moved", "elsewhere"):
                status, onward = 302, {"loop": "/html/loop", "moved": "/html/2401.00001v1", "elsewhere": "file:///etc/hostname"}[name]
            elif name == "2401.00001v1":
                status, body = 200, PAGE
            elif path.startswith("/api/query"):
                status, body = 200, FEED
            self.send_response(status)
            if onward:
                self.send_header("Location", onward)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.base, s.asked, s.times = f"http://127.0.0.1:{s.server_port}", asked, times
    yield s
    s.shutdown()
    s.server_close()


FAST = web.Limits(timeout=0.8, rate=500, tasks=2, batch=3)


def test_lookups_go_through_records_and_are_asked_once(spark, tmp_path, server):
    dois = ["10.1/ok", "10.1/missing", "10.1/bad", "10.1/down", "10.1/slow", "10.1/loop", "10.1/a (b) 'c' & d", "10.1/ok", None]
    df = spark.createDataFrame([(d,) for d in dois], "doi string")
    answers = web.Answers(spark, f"{tmp_path}/cache", FAST)
    got = {r.doi: r for r in registry.records(web.lookups(answers, df, server.base)).collect()}
    assert {d: r.error for d, r in got.items()} == {"10.1/ok": None, "10.1/missing": "HTTP 404", "10.1/bad": "parse error", "10.1/down": "HTTP 503", "10.1/slow": "timeout", "10.1/loop": "HTTP 302", "10.1/a (b) 'c' & d": None}
    ok = got["10.1/ok"]
    assert (ok.title, ok.authors, ok.journal, ok.year) == ("A title of some length", ["Roe, J.", "Doe, undefined"], "Journal", 2010)
    assert set(server.asked.values()) == {1} and len(server.asked) == 7
    # a later session asks only what is new
    more = spark.createDataFrame([("10.1/ok",), ("10.1/new",)], "doi string")
    later = web.Answers(spark.newSession(), f"{tmp_path}/cache", FAST)
    assert sorted(r.doi for r in web.lookups(later, more, server.base).collect()) == ["10.1/new", "10.1/ok"]
    assert server.asked["/works/10.1/ok"] == 1 and server.asked["/works/10.1/new"] == 1


def test_what_failed_may_be_asked_again(spark, tmp_path, server):
    answers = web.Answers(spark, f"{tmp_path}/cache", FAST)
    asked = spark.createDataFrame([("k", f"{server.base}/works/10.1/flaky"), ("m", f"{server.base}/works/10.1/missing")], "key string, url string")
    assert {r.key: r.status for r in answers.ask(asked).collect()} == {"k": 503, "m": 404}
    assert {r.key: r.status for r in answers.ask(asked).collect()} == {"k": 503, "m": 404}
    assert {r.key: r.status for r in answers.ask(asked, retry=True).collect()} == {"k": 200, "m": 404}
    assert server.asked == {"/works/10.1/flaky": 2, "/works/10.1/missing": 1}


def test_a_round_that_was_not_committed_is_asked_again(spark, tmp_path, server):
    answers = web.Answers(spark, f"{tmp_path}/cache", FAST)
    asked = spark.createDataFrame([(f"k{n}", f"{server.base}/works/10.1/n{n}") for n in range(20)], "key string, url string")
    assert answers.ask(asked).count() == 20 and len(answers._rounds()) == 4
    (tmp_path / "cache/round=3/_SUCCESS").unlink()  # as a driver that went away leaves it
    lost = 20 - answers.kept().count()
    assert lost > 0 and answers.ask(asked).count() == 20
    assert sorted(server.asked.values()) == [1] * (20 - lost) + [2] * lost


def test_rate_and_number_of_tasks(spark, tmp_path, server):
    limits = web.Limits(rate=40, tasks=2, batch=100)
    asked = spark.createDataFrame([(f"k{n}", f"{server.base}/works/10.1/n{n}") for n in range(40)], "key string, url string")
    assert web.Answers(spark, f"{tmp_path}/cache", limits).ask(asked).count() == 40
    assert max(server.times) - min(server.times) >= 0.9 * (40 - 2) / 40


def test_redirects_are_bounded(server):
    limits = web.Limits(timeout=2, redirects=3)
    assert web.fetch(f"{server.base}/html/moved", limits) == (200, PAGE, None)
    assert web.fetch(f"{server.base}/html/loop", limits) == (None, None, "too many redirects") and server.asked["/html/loop"] == 4
    assert web.fetch(f"{server.base}/html/elsewhere", limits)[2].startswith("no http address")
    assert web.fetch(f"{server.base}/html/moved", web.Limits(redirects=0))[0] == 302
    assert web.fetch(f"{server.base}/html/drip", web.Limits(timeout=0.4))[2] == "timeout"
    assert web.fetch(f"{server.base}/html/2401.00001v1", web.Limits(most_bytes=50))[2] == "too large"
    assert web.fetch("http://127.0.0.1:9/x", limits)[0] is None


def test_searches_pages_and_listing(spark, tmp_path, server):
    answers = web.Answers(spark, f"{tmp_path}/cache", web.Limits(rate=500, redirects=3))
    hits = registry.hit_records(web.searches(answers, spark.createDataFrame([("any title?",)], "title string"), server.base)).collect()
    assert [(r.query, r.rank, r.doi, r.score) for r in hits] == [("any title?", 1, "10.1/ok", 77.5)]
    listed = registry.papers(web.listing(answers, 10, "cs.AI", server.base))
    got = web.pages(answers, listed.select("id").unionByName(spark.createDataFrame([("gone",)], "id string")), server.base)
    refs = registry.references(got).collect()
    assert [r.paper for r in refs] == ["2401.00001"] * 3


def test_commands(spark, tmp_path, capsys, server):
    where = [f"--registry={server.base}", f"--preprints={server.base}", f"--cache={tmp_path}/cache"]
    assert cli.main(["verify", "10.1/ok", *where[::2]], spark) == 0 and "Roe, J." in capsys.readouterr().out
    assert cli.main(["verify", "10.1/missing", *where[::2]], spark) == 1 and "HTTP 404" in capsys.readouterr().out
    assert cli.main(["search", "A title of some length", *where[::2]], spark) == 0 and "10.1/ok" in capsys.readouterr().out
    assert cli.main(["arxiv", "1", *where, "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["stats"]["papers_audited"] == 1 and sorted(i["issue"] for i in out["issues"]) == ["DOI not found", "DOI-title mismatch"]
    assert cli.main(["verify", "10.1/ok"], spark) == 1 and "--snapshot" in capsys.readouterr().err
