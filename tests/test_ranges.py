"""Byte-range scans of lines and records against files read whole."""

from __future__ import annotations

import bz2
import gzip
import lzma
import random

import pytest

from fleetlens.sources import ranges
from fleetlens.sources.lines import read_lines
from fleetlens.sources.records import read_records


def brute_lines(data: bytes):
    out, at = [], 0
    for number, raw in enumerate(data.split(b"\n"), 1):
        if raw or at < len(data) and data[at: at + 1] == b"\n":
            out.append((number, at, raw.rstrip(b"\r")))
        at += len(raw) + 1
    return out


def some_bytes(seed, n):
    rng = random.Random(seed)
    return b"".join(rng.choice([b"line %d" % k, b"", b"x" * rng.randrange(900), b"\xff\xfe bad", "ü漢".encode(), b"cr\r", b"two\r\r"]) + b"\n"
                    for k in range(n))


FILES = {
    "h1/collected/files/var/log/a.log": some_bytes(1, 120), "h1/collected/files/var/log/no end": some_bytes(2, 40) + b"open",
    "h1/collected/files/home/u/.bash_history": b"ls\n\ncd /\n", "h2/collected/files/var/log/a.log": b"", "h2/collected/files/var/log/b+c%20d.log": b"one\r\n\n\ntwo",
    "h2/collected/files/var/log/one line": b"y" * 5000, "h2/collected/files/var/log/ends.log": b"\n\n\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("raw files")
    for name, data in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    packed = FILES["h1/collected/files/var/log/a.log"]
    for suffix, pack in ((".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress)):
        (top / f"h1/collected/files/var/log/a.log{suffix}").write_bytes(pack(packed))
    return str(top)


def stored(root):
    out = {}
    for name, data in FILES.items():
        host, path = name.split("/collected/files/")
        out[host, path] = brute_lines(data)
    for suffix in (".gz", ".bz2", ".xz"):
        out["h1", "var/log/a.log" + suffix] = brute_lines(FILES["h1/collected/files/var/log/a.log"])
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("split", [1, 700, 1 << 20])
def test_lines_of_ranges(spark, root, split, monkeypatch):
    if split == 1:
        # Every byte its own range: only the short files.
        want = {k: v for k, v in stored(root).items() if k[1] in ("var/log/b+c%20d.log", "var/log/ends.log", "home/u/.bash_history")}
        paths = [f"{root}/h2/collected/files/var/log/{{b*,ends.log}}", f"{root}/h1/collected/files/home"]
    else:
        want, paths = stored(root), f"{root}/*/collected/files"
    rows = read_lines(spark, paths, root, split_bytes=split)
    got: dict = {}
    for r in rows.selectExpr("host_id", "artifact_path", "line_no", "byte_offset", "cast(line as binary) line", "had_decode_error").collect():
        got.setdefault((r.host_id, r.artifact_path), []).append((r.line_no, r.byte_offset, bytes(r.line)))
        assert r.had_decode_error == (b"\xff" in bytes(r.line))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_uri_and_patterns(root):
    names = lambda *p: sorted(f.uri[len(root) + 1:] for f in ranges.list_files(p))
    assert names(f"{root}/*/collected/files/var/log/a.log") == ["h1/collected/files/var/log/a.log", "h2/collected/files/var/log/a.log"]
    assert names(f"{root}/h?/collected/files/home") == ["h1/collected/files/home/u/.bash_history"]
    assert names(f"{root}/h1/collected/files/var/log/a.log.{{gz,xz}}") == [f"h1/collected/files/var/log/a.log.{x}" for x in ("gz", "xz")]
    assert names(f"{root}/nothing/here", f"{root}/*/no") == []
    [file] = ranges.list_files([f"file://{root}/h2/collected/files/var/log/b+c%20d.log"])
    assert file.uri.startswith("file://") and file.size == 10 and ranges.open_at(file, 5).read() == b"\n\ntwo"[-5:]


def test_small_files_share_tasks(root):
    files = ranges.list_files([root])
    tasks = ranges.plan_ranges(files, 1 << 20)
    assert len(tasks) < len(files) and sorted((f.uri, s) for t in tasks for f, s, _ in t.parts) == sorted((f.uri, 0) for f in files)
    cut = ranges.plan_ranges([f for f in files if f.uri.endswith("/a.log") and f.size], 1000, 384)
    spans = sorted(p[1:] for t in cut for p in t.parts)
    assert all(s % 384 == 0 for s, _ in spans) and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_short_ranges_share_tasks_and_read_little(tmp_path, monkeypatch):
    """Ranges far shorter than a task: few tasks, each file opened once a task, and hardly more bytes read than there are."""
    data = some_bytes(5, 4000) + b"z" * 70_000 + b"\n" + some_bytes(6, 400)
    (tmp_path / "a.log").write_bytes(data)
    reader = ranges.LineReader({"paths": str(tmp_path), "split_bytes": "1000", "cores": "2"})
    tasks = reader.partitions()
    assert len(tasks) <= 2 * 2 * ranges.TASKS_PER_CORE and sum(len(t.parts) for t in tasks) == -(-len(data) // 1000)
    opened, read = [], []

    class Counted:
        def __init__(self, raw):
            self.raw, self.seek = raw, raw.seek

        def read(self, n):
            got = self.raw.read(n)
            read.append(len(got))
            return got

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.raw.close()

    real = ranges.open_at
    monkeypatch.setattr(ranges, "open_at", lambda file, start: opened.append(file) or Counted(real(file, start)))
    rows = [(at, raw) for t in tasks for batch in reader.read(t) for at, raw in zip(batch["byte_offset"].to_pylist(), batch["raw"].to_pylist())]
    assert sorted(rows) == [(at, data[at: end]) for at, end in zip(
        [0, *(k + 1 for k, b in enumerate(data) if b == 10)], [k + 1 for k, b in enumerate(data) if b == 10])]
    assert len(opened) == len(tasks) and sum(read) < 30 * len(data)
    records = ranges.RecordReader({"paths": str(tmp_path), "split_bytes": "1000", "width": "12", "cores": "2"})
    assert len(records.partitions()) <= 2 * 2 * ranges.TASKS_PER_CORE


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_records_of_ranges(spark, tmp_path, split):
    data = random.Random(4).randbytes(12 * 333 + 5)
    folder = tmp_path / "h1" / "collected" / "files" / "var" / "log"
    folder.mkdir(parents=True)
    (folder / "wtmp").write_bytes(data)
    (folder / "wtmp.1.gz").write_bytes(gzip.compress(data))
    (folder / "btmp").write_bytes(b"short")
    rows = read_records(spark, str(tmp_path), str(tmp_path), 12, split_bytes=split).collect()
    want = [(k, data[12 * k: 12 * k + 12]) for k in range(333)]
    for name in ("wtmp", "wtmp.1.gz"):
        assert sorted((r.record_index, bytes(r.record)) for r in rows if r.artifact_path == f"var/log/{name}") == want
    assert len(rows) == 666 and {r.host_id for r in rows} == {"h1"}


def test_manifest_and_empty_tree(spark, root, tmp_path):
    facts = spark.createDataFrame([("h1", "home/u/.bash_history", "a" * 64, "12.5")], "host_id string, artifact_path string, sha256 string, mtime string")
    rows = read_lines(spark, f"{root}/h1/collected/files/home", root, facts).collect()
    assert {(r.artifact_sha256, r.artifact_mtime) for r in rows} == {("a" * 64, 12.5)}
    assert read_lines(spark, str(tmp_path), str(tmp_path)).count() == 0
