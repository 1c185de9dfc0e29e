import gzip
import hashlib
import http.server
import io
import json
import sqlite3
import tarfile
import threading
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspan.operators import seams
from vocspan.sources import archives, remote, sinks, tables, wav
from vocspan.streaming import journal_stream


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿channel,file,speaker,start_time,end_time,text,audio,extra\nc,f,S,1,2,"a, ""quoted""\nline",u,x\nc,f,,3,4,,u,\n', encoding="utf-8")
    df = tables.read_segments(spark, str(path))
    rows = [tuple(r) for r in df.orderBy("source_row").select("source_row", "channel", "speaker", "text", "extra").collect()]
    assert rows == [(0, "c", "S", 'a, "quoted"\nline', "x"), (1, "c", "", "", "")]
    out = tmp_path / "out.csv"
    sinks.write_csv(df.withColumn("n", F.lit(None).cast("int")), str(out), "source_row", ["channel", "text"], ["text", "n"])
    assert out.read_text() == 'channel,text,n\nc,"a, ""quoted""\nline",\nc,,\n'
    with pytest.raises(ValueError):
        tables.read_segments(spark, str(out))


def test_csv_keeps_blanks_and_line_breaks(spark, tmp_path):
    values = ["  two before", "two after  ", " ", "tab\t", "a\r\nb\nc", '"', '","', "\\", "", None, "é 你好"]
    df = spark.createDataFrame([(i, *[v] * 7) for i, v in enumerate(values)], "source_row long, " + ", ".join(f"{c} string" for c in tables.REQUIRED))
    sinks.write_csv(df, str(tmp_path / "o.csv"), "source_row", list(tables.REQUIRED), [])
    got = tables.read_segments(spark, str(tmp_path / "o.csv")).orderBy("source_row").collect()
    assert [r["text"] for r in got] == [v or "" for v in values]


def test_json_lines(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"k": "é", "n": 1}\n\n{"k": "b", "n": null}\n')
    assert {tuple(r) for r in tables.read_jsonl(spark, str(good), "k string, n int").collect()} == {("é", 1), ("b", None)}
    torn = tmp_path / "b.jsonl"
    torn.write_text('{"k": "a", "n": 1}\n{"k": "b", "n"')
    assert [tuple(r) for r in tables.read_torn_jsonl(spark, str(torn), "k string, n int").collect()] == [("a", 1)]
    torn.write_text('{"k": "a", "n"\n{"k": "b", "n": 2}\n')
    with pytest.raises(ValueError):
        tables.read_torn_jsonl(spark, str(torn), "k string, n int")
    sinks.write_jsonl(tables.read_jsonl(spark, str(good), "k string, n int").coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert {"k": "b", "n": None} in lines


def test_sqlite_and_npz(spark, tmp_path):
    db = tmp_path / "j.db"
    with sqlite3.connect(db) as c:
        c.execute("create table results(row_key text primary key, vector blob, n integer)")
        c.executemany("insert into results values (?, ?, ?)", [(f"k{i}", np.array([i, 0.5], "<f4").tobytes(), i) for i in range(50)])
    df = tables.read_sqlite(spark, str(db), "results", "row_key string, vector binary, n long", 4)
    got = df.select("row_key", "n", tables.vector_of_blob(F.col("vector")).alias("v")).collect()
    assert len(got) == 50 and all(r["v"] == [float(r["n"]), 0.5] for r in got)
    np.savez(tmp_path / "p.npz", prototype=np.arange(3.0), windows=np.ones((2, 3)))
    rows = tables.read_npz(spark, str(tmp_path / "p.npz")).orderBy("array", "row").collect()
    assert [(r["array"], r["row"], len(r["vector"])) for r in rows] == [("prototype", 0, 3), ("windows", 0, 3), ("windows", 1, 3)]
    assert len(tables.file_digests(spark, str(db)).first()["sha256"]) == 64


def test_archives(spark, tmp_path):
    clips = [(f"r{i}", f"{i:064x}.mp3", "cache", "" if i % 5 else "Timeout", bytes([i]) * (100 + i) if i % 5 else None) for i in range(20)]
    df = spark.createDataFrame(clips, "row_key string, cache_name string, source string, error string, payload binary")
    folder = str(tmp_path / "cache")
    manifest = archives.write_archives(df, folder, 2)
    assert manifest.count() == 20 and not archives.too_many_failures(manifest)
    members = archives.read_members(spark, f"{folder}/*.tar")
    back = {r["cache_name"]: bytes(r["payload"]) for r in archives.verified(members, manifest).collect()}
    assert back == {c[1]: c[4] for c in clips if c[4]}
    with pytest.raises(ValueError):
        archives.verified(members, manifest.withColumn("sha256", F.lit("0" * 64))).count()
    with pytest.raises(ValueError):
        archives.verified(members, manifest.filter("row_key != 'r1'")).count()
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        for name, content in ((clips[1][1], clips[1][4]), (clips[2][1], b"z" * 5000)):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    broken = tmp_path / "broken.tar"
    broken.write_bytes(data.getvalue()[:3000])
    saved = archives.recovered(archives.read_members(spark, str(broken)), manifest).collect()
    assert [r["cache_name"] for r in saved] == [clips[1][1]]


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    """Plain entries in pieces, and what follows an extended header or a break, as tarfile reads it."""
    plain = [(f"{i:064x}.mp3", bytes([i % 256]) * (i % 1200)) for i in range(16_000)]
    odd = [("d/" * 80 + "long.mp3", b"x" * 600), ("é.mp3", b"y"), ("last.mp3", b"z" * 3000)]
    folder = tmp_path / "a b"
    folder.mkdir()
    with tarfile.open(folder / "whole.tar", "w") as tar:
        for name, content in [*plain, *odd]:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    rows = archives.read_members(spark, f"{folder}/whole.tar").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["name"], bytes(r["payload"]), r["bytes"], r["regular"], r["complete"]) for r in rows) == sorted((n, c, len(c), True, True) for n, c in [*plain, *odd])
    assert len({r["task"] for r in rows}) > 1
    data = (folder / "whole.tar").read_bytes()
    for name, content, whole, broken in (("cut.tar", data[: data.index(b"last.mp3") + 1024], [*plain, *odd[:2]], 1), ("short.tar", data[:1024], plain[:1], 1), ("header.tar", data[:2000], plain[:2], 0), ("zeros.tar", bytes(10_240), [], 0)):
        (folder / name).write_bytes(content)
        rows = archives.read_members(spark, f"{folder}/{name}").collect()
        assert sorted((r["name"], bytes(r["payload"])) for r in rows if r["complete"]) == sorted(whole) and sum(not r["complete"] for r in rows) == broken, name


def test_archives_are_read_once_when_verified(spark, tmp_path):
    clips = [(f"r{i}", f"{i:064x}.mp3", "cache", "", b"x" * i) for i in range(40)]
    manifest = archives.write_archives(spark.createDataFrame(clips, "row_key string, cache_name string, source string, error string, payload binary"), str(tmp_path / "cache"), 2)
    read = tmp_path / "read"

    def noted(batches):
        for batch in batches:
            with open(read, "a") as out:
                out.write("\n" * len(batch))
            yield batch

    members = archives.read_members(spark, f"{tmp_path}/cache/*.tar")
    back = archives.verified(members.mapInPandas(noted, members.schema), manifest)
    assert sorted((r["row_key"], bytes(r["payload"])) for r in back.collect()) == sorted((c[0], c[4]) for c in clips)
    assert len(read.read_text()) == 40


def test_archives_are_those_of_tarfile(spark, tmp_path):
    clips = [(f"r{i}", name, "cache", "", bytes([i]) * size) for i, (name, size) in enumerate([("a" * 64 + ".mp3", 0), ("b.mp3", 511), ("é.mp3", 512), ("c" * 120, 513), ("b.mp3", 511)])]
    clips[4] = (*clips[4][:4], clips[1][4])
    df = spark.createDataFrame(clips, "row_key string, cache_name string, source string, error string, payload binary").coalesce(1)
    manifest = archives.write_archives(df, str(tmp_path / "cache"), 1)
    assert sorted((r["row_key"], r["bytes"]) for r in manifest.collect()) == sorted((c[0], len(c[4])) for c in clips)
    payload = {c[1]: c[4] for c in clips}
    data, again = (tmp_path / "cache" / "audio-00000.tar").read_bytes(), io.BytesIO()
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        names = tar.getnames()
    with tarfile.open(fileobj=again, mode="w|") as tar:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = len(payload[name])
            tar.addfile(info, io.BytesIO(payload[name]))
    assert sorted(names) == sorted(payload) and data == again.getvalue()
    assert [json.loads(x)["row_key"] for x in (tmp_path / "cache" / "audio-00000.jsonl").read_text().splitlines()] == [r["row_key"] for r in manifest.collect()]


def test_wav(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16_000)
        w.writeframes(np.arange(32_000, dtype="<i2").tobytes())
    data = out.getvalue()
    reader = wav.ClipReader(lambda name, a, b: data[a : b + 1])
    clip = wave.open(io.BytesIO(reader.clip("x", 0.5, 1.0)))
    assert clip.getnframes() == 8000 and np.frombuffer(clip.readframes(2), "<i2").tolist() == [8000, 8001]
    assert wave.open(io.BytesIO(reader.clip("x", 1.5, 2.1))).getnframes() == 8000
    with pytest.raises(ValueError):
        reader.clip("x", 1.0, 2.2)
    with pytest.raises(ValueError):
        wav.range_reply(200, None, b"", 0, 1)
    a, b = wav.frame_range(F.col("s"), F.col("e"), F.lit(16_000), F.lit(32_000))
    assert [tuple(r) for r in spark.createDataFrame([(0.5, 1.0), (1.0, 2.2)], "s double, e double").select(a, b).collect()] == [(8000, 16000), (None, None)]
    faults = spark.createDataFrame([(2, 1, 16000, 1.0, 1.0, 5), (2, 2, 16000, 1.0, 1.0, 5), (2, 1, 16000, 0.1, 0.1, 5), (2, 1, 16000, 2.0, 1.0, 5), (2, 1, 16000, 1.0, 1.0, 0)], "w int, c int, r int, m double, e double, p int")
    assert [r[0] for r in faults.select(wav.audio_fault(*[F.col(c) for c in "wcrmep"])).collect()] == [None, "format", "length", "differs from annotation", "silent"]
    s = spark.createDataFrame([([0.5] * 4000,), ([0.0] * 4000,), ([1.0],), ([float("nan")] * 4000,)], "x array<double>")
    assert [r[0] for r in s.select(wav.sample_fault(F.col("x"))).collect()] == [None, "silent", "short", "not finite"]
    assert s.select(F.size(wav.padded(F.col("x"))).alias("n"), F.size(wav.loud_windows(F.col("x"), 1000)).alias("k")).first() == (16000, 4)


def test_clips_before_the_recording_are_refused(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16_000)
        w.writeframes(bytes(32_000))
    data = out.getvalue()
    reader = wav.ClipReader(lambda name, a, b: data[a : b + 1])
    for start, end in ((-0.001, 0.5), (0.5, 0.5), (0.6, 0.5), (float("nan"), 0.5)):
        with pytest.raises(ValueError):
            reader.clip("x", start, end)
    a, b = wav.frame_range(F.col("s"), F.col("e"), F.lit(16_000), F.lit(16_000))
    rows = spark.createDataFrame([(-0.001, 0.5), (0.5, 0.4), (0.0, 0.5)], "s double, e double").select(a, b).collect()
    assert [tuple(r) for r in rows] == [(None, None), (None, None), (0, 8000)]


def test_writer_gives_up(spark, tmp_path):
    kinds = "row_key string, cache_name string, source string, error string, payload binary"
    clip = lambda i, ok: (f"r{i}", f"{i:064x}.mp3", "url", "" if ok else "Timeout", b"x" if ok else None)
    assert not archives.hopeless(63, 63) and archives.hopeless(64, 58) and not archives.hopeless(64, 57)
    for i, (rows, fails) in enumerate((([clip(k, k < 6) for k in range(64)], True), ([clip(k, k < 7) for k in range(64)], False), ([clip(0, False)], True), ([], False))):
        write = lambda r=rows, i=i: archives.write_archives(spark.createDataFrame(r, kinds).coalesce(1).sortWithinPartitions("row_key"), str(tmp_path / f"c{i}"), 1).count()
        if fails:
            with pytest.raises(Exception, match="failed"):
                write()
            assert not list((tmp_path / f"c{i}").glob("*.tar"))
        else:
            assert write() == len(rows)


def test_training_archive(spark, tmp_path):
    def pack(name, entries):
        with tarfile.open(tmp_path / name, "w") as tar:
            for n, content in entries:
                info = tarfile.TarInfo(n)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return archives.read_members(spark, str(tmp_path / name))

    good = pack("good.tar", [("train.jsonl", b"{}"), ("validation.jsonl", b""), ("audio/a.wav", b"RIFF")])
    digest = tables.file_digests(spark, str(tmp_path / "good.tar")).first()["sha256"]
    assert archives.training_members(good, digest, digest).count() == 3
    with pytest.raises(ValueError):
        archives.training_members(good, digest, "0" * 64)
    for entry in ("other.txt", "audio/../a.wav", "audio/b.mp3"):
        with pytest.raises(ValueError, match="unexpected"):
            archives.training_members(pack("bad.tar", [("train.jsonl", b""), (entry, b"x")]))
    manifest = spark.createDataFrame([("audio/a.wav", 0.2, "t", "train"), ("audio/a.wav", 20.2, "t", "train")], "audio_filepath string, duration double, text string, split string")
    assert archives.check_manifest(manifest, "train", good).count() == 2
    for column, value in (("duration", 0.19), ("duration", None), ("split", "validation"), ("split", None), ("audio_filepath", "audio/z.wav")):
        with pytest.raises(ValueError):
            archives.check_manifest(manifest.withColumn(column, F.lit(value).cast(dict(manifest.dtypes)[column])), "train", good)


def test_documents_progress_and_arrays(spark, tmp_path):
    sinks.write_report({"rows": 3, "names": ["é"]}, str(tmp_path / "a.json"))
    assert tables.read_document(spark, str(tmp_path / "a.json")).first()["rows"] == 3
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(Exception):
        tables.read_document(spark, str(tmp_path / "b.json"), "rows long").collect()
    for i in range(3):
        sinks.append_progress({"done": i, "text": "é"}, str(tmp_path / "p.jsonl"))
    assert [r["done"] for r in tables.read_torn_jsonl(spark, str(tmp_path / "p.jsonl"), "done long, text string").collect()] == [0, 1, 2]
    sinks.write_npz({"prototype": np.arange(3.0), "windows": np.ones((2, 3))}, str(tmp_path / "p.npz"))
    assert tables.read_npz(spark, str(tmp_path / "p.npz")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_npz({"x": np.array([{}])}, str(tmp_path / "q.npz"))
    big = tmp_path / "odd name é.bin"
    big.write_bytes(b"abc" * 1000)
    assert tables.file_digests(spark, str(big), block=7).first()["sha256"] == hashlib.sha256(b"abc" * 1000).hexdigest()


def test_downloads_go_on(spark, tmp_path):
    data = {"u/1": bytes(range(200)) * 5, "u/2": b"tail" * 30}
    calls, broken = [], {"left": 1}

    def fetch(url, first, last):
        calls.append((url, first, last))
        if url == "u/1" and first == 600 and broken["left"]:
            broken["left"] -= 1
            raise OSError
        return data[url][first : last + 1]

    sha = lambda b: hashlib.sha256(b).hexdigest()
    parts = [{"url": u, "bytes": len(b), "sha256": sha(b)} for u, b in data.items()]
    whole, target = data["u/1"] + data["u/2"], str(tmp_path / "f.bin")
    with pytest.raises(OSError):
        remote.download(parts, target, sha(whole), fetch=fetch, block=300, tries=1, pause=lambda s: None)
    calls.clear()
    assert remote.download(parts, target, sha(whole), fetch=fetch, block=300, pause=lambda s: None)
    assert calls[0] == ("u/1", 600, 899) and open(target, "rb").read() == whole and sorted(p.name for p in tmp_path.iterdir()) == ["f.bin"]
    assert not remote.download(parts, target, sha(whole), fetch=fetch)
    zipped = gzip.compress(whole)
    data["z"] = zipped
    assert remote.download([{"url": "z", "bytes": len(zipped), "sha256": sha(zipped)}], str(tmp_path / "g.bin"), sha(whole), unzip=True, fetch=fetch)
    for bad in ([{**parts[0], "sha256": "0"}], [parts[0]]):
        with pytest.raises(ValueError):
            remote.download(bad, str(tmp_path / "h.bin"), sha(whole), fetch=fetch)
    rows = spark.createDataFrame([(1, "u", 0, 3), (2, "x", 0, 3)], "k int, url string, a long, b long")
    got = remote.read_ranges(rows, "k", "url", "a", "b", fetch=lambda u, a, b: {"u": b"abcd"}[u][a : b + 1], tries=1).collect()
    assert {r["k"]: (bytes(r["payload"] or b""), r["error"]) for r in got} == {1: (b"abcd", ""), 2: (b"", "KeyError")}


def test_ranges_over_http(tmp_path):
    data = bytes(range(256)) * 4

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            good = "bad" not in self.path
            body = data[first : last + 1] if good else data
            self.send_response(206 if good else 200)
            if good:
                self.send_header("Content-Range", f"bytes {first}-{last}/{len(data)}")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    assert remote.http_range(base + "a", 5, 9) == data[5:10]
    with pytest.raises(ValueError):
        remote.http_range(base + "bad", 5, 9)
    server.shutdown()


def test_transcoding(spark):
    df = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "k string, p binary")
    got = {r["k"]: (bytes(r["payload"] or b""), r["error"]) for r in seams.transcode(df, "k", "p", ("tr", "a-z", "A-Z")).collect()}
    assert got == {"a": (b"XYZ", ""), "b": (b"", "ValueError")}
    assert {r["error"] for r in seams.transcode(df, "k", "p", ("no-such-program",)).collect()} == {"FileNotFoundError"}


def test_only_buckets_with_news_are_written_again(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda ks, seq: spark.createDataFrame([(f"k{k}", seq, "x") for k in ks], "row_key string, seq long, v string")
    sinks.upsert_table(rows(range(40), 1), folder, "row_key", "seq", buckets=8)
    before = json.load(open(f"{folder}/CURRENT"))["buckets"]
    held = sinks.read_table(spark, folder)
    sinks.upsert_table(rows([3], 2), folder, "row_key", "seq", buckets=99)
    after = json.load(open(f"{folder}/CURRENT"))["buckets"]
    assert len(after) == 8 and sum(before[b] != after[b] for b in after) == 1
    assert held.count() == 40  # a reader of the version before is not disturbed
    sinks.upsert_table(rows([3], 0), folder, "row_key", "seq")
    got = {r["row_key"]: r["seq"] for r in sinks.read_table(spark, folder).collect()}
    assert len(got) == 40 and got["k3"] == 2 and set(got.values()) == {1, 2}
    sinks.upsert_table(rows([], 5), folder, "row_key", "seq")
    assert sinks.read_table(spark, folder).count() == 40


def test_seams(spark):
    calls = {"tries": 0}

    def flaky():
        calls["tries"] += 1
        if calls["tries"] < 3:
            raise OSError
        return "done"

    pauses = []
    assert seams.with_retries(flaky, 3, pauses.append) == "done" and pauses == [1.0, 2.0]
    df = spark.createDataFrame([("a", b"x"), ("b", b""), ("c", b"yy")], "k string, p binary")

    def service(data):
        if not data:
            raise TimeoutError
        return {"transcription": "t" * len(data), "duration": "inf" if len(data) > 1 else "1.5"}

    got = {r["k"]: (r["generated_text"], r["duration_seconds"], r["error"]) for r in seams.transcribe(df, "k", "p", service, 1).collect()}
    assert got == {"a": ("t", 1.5, ""), "b": ("", None, "TimeoutError"), "c": ("", None, "ValueError")}
    out = seams.map_batches(df.repartition(1), "k", "p", lambda v: [len(x) for x in v], "int", 2).collect()
    assert {r["k"]: r["result"] for r in out} == {"a": 1, "b": 0, "c": 2}
    got = {r["k"]: (r["source"], r["error"]) for r in seams.first_source(df, "k", {"cache": lambda r: b"1" if r["k"] == "a" else None, "url": lambda r: r["p"]}).collect()}
    assert got == {"a": ("cache", ""), "b": (None, "ValueError"), "c": ("url", "")}
    titles = seams.resolve_titles(spark.createDataFrame([("v1", "f1"), ("v2", "f2"), ("v3", "f3")], "video string, fallback string"), spark.createDataFrame([("v1", "T1", "service"), ("v9", "T9", "service")], "video string, title string, source string"), lambda v: "T2" if v == "v2" else None)
    assert {tuple(r) for r in titles.collect()} == {("v1", "T1", "service"), ("v2", "T2", "service"), ("v3", "f3", "file name")}


def test_embeddings_are_checked(spark):
    df = spark.createDataFrame([(i, i) for i in range(6)], "k int, s int").coalesce(1)
    vectors = [[1.0, 2.0], [1.0], [float("nan"), 1.0], [0.0, 0.0], None, [float("inf"), 0.0]]
    got = {r["k"]: (r["vector"], r["error"]) for r in seams.embed(df, "k", "s", lambda ks: [vectors[k] for k in ks], dimensions=2, size=4).collect()}
    assert got == {0: ([1.0, 2.0], "")} | {k: (None, "InvalidEmbedding") for k in range(1, 6)}


def test_streamed_journal(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    batch = lambda rows: spark.createDataFrame(rows, journal_stream.ATTEMPTS).coalesce(1).write.mode("append").parquet(folder)
    batch([(1, "a", None, None, "Timeout"), (2, "b", "x", 1.0, "")])
    journal_stream.keep_journal(journal_stream.attempts(spark, folder), table, checkpoint).awaitTermination(120)
    batch([(3, "a", "y", 2.0, ""), (0, "b", None, None, "late")])
    journal_stream.keep_journal(journal_stream.attempts(spark, folder), table, checkpoint).awaitTermination(120)
    assert {r["row_key"]: (r["seq"], r["error"]) for r in sinks.read_table(spark, table).collect()} == {"a": (3, ""), "b": (2, "")}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    assert sinks.counter(df, "k", "n") == {"a": 1, "b": 2}
    report = sinks.report_of(df.agg(F.sum("n").alias("n")))
    sinks.write_report(report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 3} and sinks.summary_text(report) == "n: 3\n"
    sinks.write_titles(df.select(F.col("k").alias("title")).union(df.select("k")), str(tmp_path / "t"))
    sinks.write_by(df, str(tmp_path / "by"), "k")
    assert spark.read.parquet(str(tmp_path / "by")).filter("k = 'a'").count() == 1
