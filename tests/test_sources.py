import gzip
import hashlib
import io
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError

import numpy as np
import pytest

from driftlake.operators.labeling import remaining
from driftlake.sources import archive, fasta, fetch, releases, sinks, streams, tables, upload
from driftlake.streaming import incremental


def test_fasta(spark, tmp_path):
    (tmp_path / "g1_protein.faa").write_text(">a first > one\nACGT\nTT\n>b\nGG*\n>a\nCC\n")
    (tmp_path / "g2_protein.faa").write_text(">c\r\nAA\r\nCC\r\n")
    rows = fasta.genome_of(fasta.read_fasta(spark, str(tmp_path))).orderBy("genome", "position").collect()
    assert [(r["genome"], r["record_id"], r["description"], r["seq"]) for r in rows] == [("g1", "a", "first > one", "ACGTTT"), ("g1", "b", "", "GG*"), ("g1", "a", "", "CC"), ("g2", "c", "", "AACC")]
    last = fasta.last_of_each_id(fasta.read_fasta(spark, str(tmp_path)))
    assert {r["record_id"]: r["seq"] for r in last.collect()} == {"a": "CC", "b": "GG*", "c": "AACC"}
    fasta.write_fasta(last, str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).count() == 3


@pytest.fixture
def tar(tmp_path):
    path = tmp_path / "x.tar.gz"
    with tarfile.open(path, "w:gz") as t:
        d = tarfile.TarInfo("reps")
        d.type = tarfile.DIRTYPE
        t.addfile(d)
        for name, data in (("reps/A_protein.faa", b">p\nAC\n"), ("reps/B_protein.faa", b">q\nGT\n"), ("reps/readme.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def test_archives(spark, tar):
    wanted = spark.createDataFrame([("A",), ("Z",)], "key string")
    got = archive.read_archives(spark, tar, "_protein.faa", wanted)
    assert [(r["key"], bytes(r["content"])) for r in got.collect()] == [("A", b">p\nAC\n")]
    assert [r["key"] for r in remaining(wanted, got, "key").collect()] == ["Z"]
    assert archive.read_archives(spark, tar, "_protein.faa").count() == 2


def test_streamed_archive(spark, tar):
    spark.dataSource.register(archive.TarMembers)
    got = spark.read.format("tar_members").option("paths", tar).option("suffix", "_protein.faa").option("wanted", "B").load().collect()
    assert [r["name"] for r in got] == ["reps/B_protein.faa"]


def test_tables(spark, tmp_path):
    with gzip.open(tmp_path / "bac.tsv.gz", "wt") as f:
        f.write("G1\td__B;p__X;g__g1;s__\n\nG2\td__B;p__Y\n")
    t = tables.read_taxonomy(spark, {"bac": str(tmp_path / "bac.tsv.gz")}).orderBy("accession").collect()
    assert [(r["accession"], r["phylum"], r["species"]) for r in t] == [("G1", "X", ""), ("G2", "Y", "")]
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("accession\tother\tgtdb_representative\nG1\tx\tt\nG2\tx\tf\nG1\ty\tt\n")
    with tarfile.open(tmp_path / "n.tar.gz", "w:gz") as f:
        data = b"accession\tgtdb_representative\nG9\tt\n"
        info = tarfile.TarInfo("d/n.tsv")
        info.size = len(data)
        f.addfile(info, io.BytesIO(data))
    found = [tables.representatives(tables.read_metadata(spark, tables.first_existing(spark, str(tmp_path / n)), ["accession", "gtdb_representative"])).collect() for n in "mn"]
    assert [[r[0] for r in x] for x in found] == [["G1"], ["G9"]]
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, str(tmp_path / "none"))
    (tmp_path / "fam.tsv").write_text("PF1\ta\n\nPF2\tb\nPF1\tc\n")
    assert sorted(r[0] for r in tables.read_family_ids(spark, str(tmp_path / "fam.tsv")).collect()) == ["PF1", "PF2"]


def test_matrix(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position long, id string")
    assert {r["id"]: r["embedding"] for r in tables.read_matrix(spark, str(tmp_path / "m.npy"), ids).collect()}["c"] == [4.0, 5.0]
    with pytest.raises(ValueError, match="3 vectors"):
        tables.read_matrix(spark, str(tmp_path / "m.npy"), ids.limit(2))


def test_sinks(spark, tmp_path):
    for k in range(2):
        sinks.append_manifest(spark, str(tmp_path / "m"), "s", f"r{k}", {"a": 3, "b": None})
        sinks.log_run(spark, str(tmp_path / "l"), f"t{k}")
    m = sinks.read_manifest(spark, str(tmp_path / "m")).orderBy("release").collect()
    assert len(m) == 2 and m[0]["files"][0]["size_bytes"] == 3 and m[0]["files"][1]["size_bytes"] is None and m[0]["fetched_at_utc"].endswith("Z")
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    sinks.write_document(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["b"] == "x"


class Answer(io.BytesIO):
    def __init__(self, data, stated):
        super().__init__(data)
        self.headers = {"Content-Length": str(stated)}


def test_download(tmp_path):
    answers, waits = [Answer(b"ab", 3), Answer(b"abc", 3)], []
    assert fetch.download("u", tmp_path / "x", open_url=lambda _: answers.pop(0), sleep=waits.append) == 3
    assert waits == [5] and (tmp_path / "x").read_bytes() == b"abc"
    with pytest.raises(OSError, match="2 of 3"):
        fetch.download("u", tmp_path / "y", tries=2, open_url=lambda _: Answer(b"ab", 3), sleep=waits.append)
    fetch.verify_md5(tmp_path / "x", "900150983cd24fb0d6963f7d28e17f72")


def test_range_reader():
    data = bytes(range(256)) * 10
    failed = set()

    def get(a, b):
        if a not in failed:
            failed.add(a)
            raise OSError("again")
        return data[a : b + 1]

    r = fetch.RangeReader(get, len(data), chunk=100, workers=3, sleep=lambda _: None)
    assert io.BufferedReader(r, 64).read() == data


def test_incremental(spark, tmp_path):
    schema = "genome string, n long"
    write = lambda g: spark.createDataFrame([(g, 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: incremental.run_available(spark, str(tmp_path / "in"), schema, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp"))
    write("a")
    run()
    write("b")
    run()
    run()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("genome").collect()) == ["a", "b"]
    assert incremental.finished(spark, str(tmp_path / "out"), "genome").count() == 2


def test_event_rates(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = incremental.event_rates(ev.withColumn("ts", ev["ts"].cast("timestamp")))
    assert sum(r["n"] for r in got.collect()) == ev.count()


@pytest.fixture
def server(tar):
    """Answers ranges of the archive and counts the bytes that it sends."""
    data = open(tar, "rb").read()
    sent = []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            sent.append(last - first + 1)
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[first : last + 1])

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/x.tar.gz", data, sent
    http.shutdown()


def test_archive_over_http(spark, server):
    url, data, _ = server
    fetch_range, total = streams.ranges(url)
    assert total == len(data) and fetch_range(3, 9) == data[3:10]
    assert streams.open_stream(url, chunk=7, workers=3).read() == data
    got = archive.read_archives(spark, url, "_protein.faa", spark.createDataFrame([("B",)], "key string"))
    assert [(r["archive"], r["key"]) for r in got.collect()] == [(url, "B")]


def test_early_exit(tmp_path):
    """A large archive is not read on when all that is wanted has come."""
    path, rng = str(tmp_path / "big.tar.gz"), np.random.default_rng(1)
    with tarfile.open(path, "w:gz") as t:
        for k in range(40):
            data = rng.bytes(100_000)
            info = tarfile.TarInfo(f"d/G{k}_protein.faa")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    read, (plain, total) = [], streams.ranges(path)

    def counted(_):
        def get(a, b):
            read.append(b - a + 1)
            return plain(a, b)

        return get, total

    streams.OPENERS["counted"] = counted
    try:
        stream = streams.open_stream("counted://x", chunk=50_000, workers=2)
        with tarfile.open(fileobj=stream, mode="r|gz") as t:
            assert next(iter(t)).name == "d/G0_protein.faa"
        assert sum(read) < total / 2
        assert [m[1] for m in archive.members("counted://x", "_protein.faa", frozenset({"G1", "G3"}))] == ["d/G1_protein.faa", "d/G3_protein.faa"]
        assert len(list(archive.members("counted://x", "_protein.faa"))) == 40
        assert len(list(archive.members("counted://x", "_protein.faa", frozenset({"none"})))) == 0
    finally:
        del streams.OPENERS["counted"]


class Bucket:
    def __init__(self):
        self.begun, self.held, self.done, self.lock = {}, {}, {}, threading.Lock()

    def unfinished(self, key):
        return next((u for u, k in self.begun.items() if k == key), None)

    def begin(self, key):
        self.begun["u1"] = key
        return "u1"

    def parts(self, key, number):
        return [(n, len(d), f"t{n}") for n, d in reversed(self.held.items())]

    def put(self, key, number, n, data):
        with self.lock:
            self.held[n] = data
        return f"t{n}"

    def complete(self, key, number, parts):
        assert [n for n, _ in parts] == list(range(1, len(parts) + 1)) and all(t == f"t{n}" for n, t in parts)
        self.done[key] = b"".join(self.held[n] for n, _ in parts)


def test_upload_goes_on():
    data, bucket, asked, seen = bytes(range(251)) * 9, Bucket(), [], []

    def get(a, b):
        asked.append(a)
        if len(asked) == 4:
            raise OSError("broke off")
        return data[a : b + 1]

    with pytest.raises(OSError, match="broke off"):
        upload.upload(bucket, "k", get, len(data), 300, 1)
    before = set(bucket.held)
    assert 0 < len(before) < 8 and "k" not in bucket.done
    sent = upload.upload(bucket, "k", get, len(data), 300, 3, lambda done, total: seen.append((done, total)))
    assert bucket.done["k"] == data and sent == 8 - len(before) and seen[-1] == (len(data), len(data))
    assert upload.upload(bucket, "k", get, len(data), 300, 3) == 0
    bucket.held[2] = b"short"
    assert upload.plan(len(data), 300, {n: len(d) for n, d in bucket.held.items()}) == [(2, 300, 599)]


def test_releases(spark, tmp_path):
    asked = []

    def get(url, to):
        asked.append(url)
        if url.endswith("metadata_r207.tsv.gz") or url.endswith("ar53_taxonomy_r207.tsv.gz") or url.endswith("taxonomy_r207.tar.gz"):
            raise HTTPError(url, 404, "none", {}, None)
        if url.endswith("relnotes.txt"):
            raise HTTPError(url, 500, "down", {}, None)
        sums = f"{hashlib.md5(b'data').hexdigest()}  ./x/bac120_taxonomy_r207.tsv.gz\n"
        to.write_bytes(sums.encode() if "MD5SUM" in url else b"data")
        return to.stat().st_size

    sizes = releases.snapshot(spark, "taxonomy", "R207", str(tmp_path), True, get)
    assert set(sizes) == {"bac120_taxonomy_r207.tsv.gz", "ar53_taxonomy_r207.tsv", "bac120_metadata_r207.tar.gz", "ar53_metadata_r207.tar.gz", "VERSION.txt", "MD5SUM.txt"}
    before = len(asked)
    releases.snapshot(spark, "taxonomy", "R207", str(tmp_path), True, get)
    assert len(asked) == before  # nothing anew
    (tmp_path / "taxonomy" / "R207" / "bac120_taxonomy_r207.tsv.gz").write_bytes(b"other")
    with pytest.raises(ValueError, match="md5"):
        releases.fetch_taxonomy("R207", tmp_path / "taxonomy" / "R207", get=get)
    with pytest.raises(HTTPError, match="500"):
        releases.fetch_families("35.0", tmp_path / "f", get=get)
    assert not list((tmp_path / "f").glob("*.part"))
    assert sinks.read_manifest(spark, str(tmp_path / "manifest")).count() == 2


def test_matrix_by_ranges(spark, tmp_path):
    m = np.random.default_rng(2).normal(size=(1003, 5)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    ids = spark.range(1003).withColumnRenamed("id", "position")
    got = {r["position"]: r["embedding"] for r in tables.read_matrix(spark, str(tmp_path / "m.npy"), ids, block=100).collect()}
    assert all(np.allclose(got[i], m[i]) for i in range(1003))
