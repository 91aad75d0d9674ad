import json
import os

from newsloom.sources import landing
from newsloom.streaming import streams as S


def put(root, path, data):
    full = f"{root}/{path}"
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return full


def rec(n, **more):
    return {"title": f"t{n}", "url": f"u{n}", "full_text": "text", **more}


def test_arrays_objects_lines_and_quarantine(spark, tmp_path):
    root = str(tmp_path / "raw")
    put(root, "en/bbc/a.json", json.dumps([rec(1), rec(2, full_text=None), "loose", None, {"title": "no text"}]))
    put(root, "en/bbc/b.json", json.dumps(rec(3, title={"nested": [1, "ß"]}, category=7)))
    put(root, "ar/x/c.json", json.dumps(rec(4)) + "\n\n" + "{broken\n" + json.dumps(rec(5)) + "\n")
    put(root, "ar/x/d.json", "[{\"cut\": ")
    put(root, "ar/x/e.json", b"\xff\xfe\x00bad")
    put(root, "ar/x/empty.json", " \n")
    put(root, "ar/x/seen_links.json", json.dumps([rec(6)]))
    put(root, "ar/x/notes.txt", "no")
    put(root, "ar/x/_temporary/f.json", json.dumps([rec(7)]))
    rows = landing.read_landed(spark, root, require=("full_text", "summary"))
    good = {r.url: r for r in landing.admitted(rows).collect()}
    assert set(good) == {"u1", "u2", "u3", "u4", "u5"}
    assert good["u2"].full_text is None and good["u1"].source_folder == "en/bbc" and good["u4"].source_folder == "ar/x"
    assert json.loads(good["u3"].title) == {"nested": [1, "ß"]} and good["u3"].category == "7"
    bad = sorted((os.path.basename(r.source_file), r.problem.split(":")[0], r.rejected[:7]) for r in landing.quarantined(rows).collect())
    assert bad == [("a.json", "not an object", "loose"), ("a.json", "not an object", "null"), ("c.json", "not JSON", "{broken"),
                   ("d.json", "not JSON", '[{"cut"'), ("e.json", "not UTF-8", "��\x00bad")]
    assert landing.read_landed(spark, str(tmp_path / "none")).collect() == []


def test_latest_run_per_folder(spark, tmp_path):
    root = str(tmp_path)
    for n, path in enumerate(["en/a/run_ts=20240101/p0.json", "en/a/run_ts=20240103/p0.json", "en/a/run_ts=20240103/p1.json",
                              "en/a/run_ts=20240102/p0.json", "en/b/old.json", "en/b/new.json"]):
        os.utime(put(root, path, json.dumps([rec(n)])), (1_700_000_000 + n, 1_700_000_000 + n))
    got = {r.url for r in landing.admitted(landing.read_landed(spark, root, latest=True)).collect()}
    assert got == {"u1", "u2", "u5"}


def test_stream_reads_every_file_once(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        S.run_available_now(landing.admitted(landing.stream_landed(spark, root)).select("url"), ckpt, S.versioned_sink(out))
        return sorted(r.url for r in spark.read.parquet(out).collect())

    os.utime(put(root, "a/1.json", json.dumps([rec(1), rec(2)])), (1_700_000_000, 1_700_000_000))
    assert run() == ["u1", "u2"]
    assert run() == ["u1", "u2"]
    # One more file in the same instant, and a later one.
    os.utime(put(root, "a/2.json", json.dumps([rec(3)])), (1_700_000_000, 1_700_000_000))
    put(root, "b/3.json", json.dumps(rec(4)))
    assert run() == ["u1", "u2", "u3", "u4"]
