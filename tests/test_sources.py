"""Manifests are checked before ingest, bundles appear whole, a service is asked once, and the command line takes optional tables."""

import hashlib
import http.server
import sys
import threading
import warnings

import pytest

from cohortweave.operators import network
from cohortweave.plans import cohort
from cohortweave.scratch import Scope
from cohortweave.sources import interactions, tables


@pytest.fixture
def samples(spark, tmp_path):
    """Five listed files in folders of their own, and the manifest."""
    rows = []
    for i in range(5):
        (tmp_path / f"id{i}").mkdir()
        data = f"p1\t0.{i}\np2\tNA\n".encode() * (1 + 3000 * (i == 4))
        (tmp_path / f"id{i}" / f"s{i}.txt").write_bytes(data)
        rows.append((f"id{i}", f"id{i}/s{i}.txt", hashlib.md5(data).hexdigest(), len(data), "validated"))
    return tmp_path, spark.createDataFrame(rows, tables.MANIFEST)


def test_a_sound_manifest_is_ingested(spark, samples, monkeypatch):
    monkeypatch.setattr(tables, "CHUNK", 7)
    folder, manifest = samples
    assert tables.verify_manifest(spark, str(folder), manifest).where("fault is not null").count() == 0
    got = tables.ingest_samples(spark, str(folder), manifest)
    assert {r["sample"] for r in got.collect()} == {f"id{i}" for i in range(5)} and got.count() == 2 * (4 + 3001)


def test_missing_short_and_altered_files_are_refused(spark, samples):
    folder, manifest = samples
    (folder / "id0" / "s0.txt").unlink()
    (folder / "id1" / "s1.txt").write_bytes(b"p1\t0.1\n")
    data = bytearray((folder / "id4" / "s4.txt").read_bytes())
    data[-2] ^= 1
    (folder / "id4" / "s4.txt").write_bytes(bytes(data))
    faults = {r["id"]: r["fault"] for r in tables.verify_manifest(spark, f"file://{folder}/", manifest).collect()}
    assert faults == {"id0": "missing", "id1": "short", "id2": None, "id3": None, "id4": "altered"}
    with pytest.raises(ValueError, match="3 files.*s0.txt .missing."):
        tables.ingest_samples(spark, str(folder), manifest)


def test_a_bundle_that_fails_midway_leaves_the_last_one(spark, tmp_path):
    at = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        tables.read_bundle(spark, at, ["t"])
    assert tables.write_bundle(spark, at, {"t": spark.range(4), "u": spark.range(1)}, {"x": 1}) == 1
    with pytest.raises(Exception):
        tables.write_bundle(spark, at, {"t": spark.range(9), "u": spark.range(1).selectExpr("raise_error('no') AS id")}, {"x": 2})
    got, params = tables.read_bundle(spark, at, ["t", "u"])
    assert got["t"].count() == 4 and params == {"x": 1}
    assert [tables.write_bundle(spark, at, {"t": spark.range(n)}, {"x": n}) for n in (5, 6)] == [3, 4]
    assert tables.read_bundle(spark, at, ["t"])[1] == {"x": 6} and tables.read_bundle(spark, at, ["t"], 3)[1] == {"x": 5}
    with pytest.raises(FileNotFoundError):
        tables.read_bundle(spark, at, ["t"], 1)


def test_the_service_is_asked_once(spark, tmp_path):
    asked = []
    text = "source_genesymbol\ttarget_genesymbol\tcuration_effort\treferences\tsources\nA\tB\t3\tp1;p1;p2\tx;y\nB\tA\t1\t\tx\n"

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write((text if "bad" not in self.path else "error\nsomething\n").encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/q"
        with Scope():
            df = interactions.fetch(spark, url, str(tmp_path / "saved"))
            assert df.count() == 2 and {r["source_genesymbol"]: r["n_references"] for r in df.collect()} == {"A": 2, "B": 0}
            assert len(asked) == 1 and interactions.load(spark, str(tmp_path / "saved")).count() == 2
        for _ in range(2):
            assert interactions.fetch(spark, url, landing=str(tmp_path / "land")).count() == 2
        assert len(asked) == 2
        with Scope(), pytest.raises(ValueError):
            interactions.fetch(spark, f"{url}/bad")
    finally:
        server.shutdown()


def test_a_network_without_confidence_warns(spark):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        edges = network.cost_graph(spark.createDataFrame([("A", "B")], "source string, target string"))
    assert edges.first()["cost"] == 0.5 and any("confidence" in str(w.message) for w in seen)


def test_the_command_line_takes_what_is_there(spark, tmp_path, monkeypatch):
    for name in (*cohort.NEEDED, "bad_probes"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}")
    spark.range(2).write.parquet(f"{tmp_path}/other")
    (tmp_path / "network.tsv").write_text("source_genesymbol\ttarget_genesymbol\tx\nA\tB\t1\n")
    got = {}
    monkeypatch.setattr(cohort, "run", lambda spark, tables, net: got.update(tables) or {"t": spark.range(1)})
    monkeypatch.setattr(sys, "argv", ["cohort", "--input", str(tmp_path), "--output", f"{tmp_path}/out", "--annotation-fallback", f"{tmp_path}/other"])
    cohort.main()
    assert set(got) == {*cohort.NEEDED, "bad_probes", "annotation_fallback"} and got["annotation_fallback"].count() == 2
    assert tables.read_bundle(spark, f"{tmp_path}/out", ["t"])[1]["optional_tables"] == ["annotation_fallback", "bad_probes"]
