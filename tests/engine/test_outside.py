"""Sources outside the file system: a local web server and an embedded database."""

import http.server
import io
import json
import threading
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from medsentry.errors import IngestError
from medsentry.sources import database, files, web


def _archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ascii/x.txt", bytes(i * i % 251 for i in range(200_000)))
    return out.getvalue()


class Handler(http.server.BaseHTTPRequestHandler):
    body, seen = _archive(), []

    def log_message(self, *args):
        pass

    def _answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_HEAD(self):  # noqa: N802
        self._answer(200, Content_Length=str(len(self.body)), Accept_Ranges="bytes")

    def do_GET(self):  # noqa: N802
        self.seen.append(self.path)
        times, asked = self.seen.count(self.path), self.headers.get("Range")
        if self.path == "/busy" and times < 3:
            self._answer(503, Retry_After="7")
        elif self.path == "/page":
            self._answer(200, b'<a href="d/faers_ascii_2026q2.zip">')
        elif self.path == "/gone":
            self._answer(404, b"no")
        elif asked and self.path != "/plain.zip":
            a, b = map(int, asked.removeprefix("bytes=").split("-"))
            own = self.body[a : b + 1]
            if self.path == "/short.zip" and len(own) > 9_000:  # breaks off without a word
                self._answer(206, own[:9_000], Content_Length=str(len(own)))
            else:
                self._answer(206, b"" if self.path == "/stuck.zip" else own)
        else:
            self._answer(200, self.body, Content_Length=str(len(self.body)))


@pytest.fixture
def server():
    Handler.seen.clear()
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()
    s.server_close()


def test_client(server, tmp_path):
    waits = []
    client = web.Client(tmp_path, sleep=waits.append)
    assert not client.holds(f"{server}/busy", {"q": "1"})
    first = client.get(f"{server}/busy", None)
    assert first.status == 200 and not first.stored and len(waits) == 2 and min(waits) >= 7
    again = client.get(f"{server}/busy")
    assert again.stored and again.body == first.body and client.holds(f"{server}/busy") and not client.holds(f"{server}/busy", {"q": "1"})
    for _ in range(2):  # no error is stored
        assert client.get(f"{server}/gone").status == 404
    assert Handler.seen.count("/gone") == 2
    with pytest.raises(IngestError):
        web.Client(sleep=waits.append, tries=2).get("http://127.0.0.1:9/none")


def test_asked_wait():
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    asked = {"Retry-After": "Thu, 01 Jan 2026 00:01:00 GMT"}
    assert [web.asked_wait(h, now) for h in (asked, {"retry-after": "3"}, {"Retry-After": "soon"}, {})] == [60, 3, 0, 0]


@pytest.mark.parametrize("name", ["whole.zip", "short.zip"])
def test_ranges(server, tmp_path, name):
    client = web.Client(sleep=lambda s: None)
    checksum = web.download(f"{server}/{name}", tmp_path / "a.zip", client, least=10, whole=10, tries=20)
    assert (tmp_path / "a.zip").read_bytes() == Handler.body and checksum == files.checksum(tmp_path / "a.zip")
    assert len(Handler.seen) == 4 if name == "whole.zip" else len(Handler.seen) > 4
    assert [p.name for p in tmp_path.iterdir()] == ["a.zip"]


def test_download_whole(server, tmp_path):
    web.download(f"{server}/plain.zip", tmp_path / "a.zip", least=10)
    assert (tmp_path / "a.zip").read_bytes() == Handler.body


@pytest.mark.parametrize(("name", "least", "whole"), [("stuck.zip", 10, 10), ("plain.zip", 10, 10), ("whole.zip", 1 << 30, 10), ("gone", 10, 1 << 30)])
def test_incomplete_downloads_leave_nothing(server, tmp_path, name, least, whole):
    with pytest.raises(IngestError):
        web.download(f"{server}/{name}", tmp_path / "a.zip", web.Client(sleep=lambda s: None), least=least, whole=whole, tries=3)
    assert not list(tmp_path.iterdir())


def test_discover(server, spark, tmp_path, capsys):
    from medsentry import cli

    for _ in range(2):
        assert cli.main(["--root", str(tmp_path / "r"), "discover", f"{server}/page"], spark) == 0
        assert json.loads(capsys.readouterr().out) == {"2026Q2": f"{server}/d/faers_ascii_2026q2.zip"}
    assert Handler.seen.count("/page") == 1
    assert cli.main(["--root", str(tmp_path / "s"), "discover", f"{server}/gone"], spark) == 1


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).select(F.col("id").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    rows.coalesce(1).write.jdbc(url, "THINGS", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    for key in (None, "ID"):
        df = database.table(spark, url, "THINGS", key, parts=4)
        assert df.rdd.getNumPartitions() == (4 if key else 1)
        assert sorted(r.NAME for r in df.filter("ID >= 990").collect()) == [f"n{i}" for i in range(990, 1000)] and df.count() == 1000
