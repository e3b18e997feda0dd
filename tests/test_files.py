"""Listings, archives and sinks of files: empty and hidden files, archives of over 2 GB, members that are refused, tasks that fail."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.session import names_in
from larkspur.sources import annotations as sources
from larkspur.sources import files


def as_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, src string")


def test_listing_has_empty_files_and_a_task_a_folder(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"train/images/{k}").mkdir(parents=True)
        (tmp_path / f"train/images/{k}/a.png").write_bytes(b"x" * k)
    (tmp_path / "top.png").write_bytes(b"1")
    for hidden in ("_done", ".x.crc"):
        (tmp_path / hidden).write_bytes(b"1")
    df = files.listing(spark, str(tmp_path))
    found = {r.path.removeprefix(f"file:{tmp_path}/"): r.length for r in df.collect()}
    assert found == {"top.png": 1, **{f"train/images/{k}/a.png": k for k in range(5)}}
    assert df.rdd.getNumPartitions() >= 5 and df.where("modified is null").count() == 0
    assert [r.length for r in files.listing(spark, f"file:{tmp_path}", recursive=False).collect()] == [1]
    assert files.listing(spark, str(tmp_path / "none")).collect() == []
    # Folders beyond the number that is planned are gone down into by tasks.
    few = spark.read.format("larkspur_files").option("folders", "2").load(str(tmp_path))
    assert few.count() == 6 and few.rdd.getNumPartitions() < 5
    assert {(r.stem, r.ext) for r in sources.files(spark, str(tmp_path), "s", [".png"]).where("length = 0").collect()} == {("a", ".png")}


def archive(path, members, at=0):
    with open(path, "wb") as f:
        f.seek(at)
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in members:
                z.writestr(zipfile.ZipInfo(name), text)


def test_members_are_read_by_many_tasks(spark, tmp_path):
    archive(tmp_path / "a.zip", [(f"train/labels/f{k}.txt", f"{k} 0.5 0.5 1 1\n" * 50) for k in range(200)] + [("x/", ""), ("other.png", b"\x89\x00")])
    df = files.archives(spark, str(tmp_path / "a.zip"), ".txt", task_bytes=500)
    assert df.rdd.getNumPartitions() > 8
    found = {r.member: bytes(r.content).decode() for r in df.collect()}
    assert len(found) == 200 and found["train/labels/f7.txt"] == "7 0.5 0.5 1 1\n" * 50
    every = files.archives(spark, str(tmp_path))
    assert {bytes(r.content) for r in every.where("member = 'other.png'").collect()} == {b"\x89\x00"} and every.count() == 201
    lines = sources.zip_label_lines(spark, str(tmp_path), "z").where("stem = 'f7'").collect()
    assert len(lines) == 50 and (lines[0].source, lines[0].split, lines[0].value) == ("z", "train", "7 0.5 0.5 1 1")


def test_an_archive_of_over_two_gigabytes(spark, tmp_path):
    """The members lie behind 2.2 GB that take no room on disk."""
    archive(tmp_path / "big.zip", [("a.txt", "one"), ("b.txt", "two" * 1000)], at=2_200_000_000)
    assert (tmp_path / "big.zip").stat().st_size > 1 << 31
    assert {(r.member, r.text[:3]) for r in sources.zip_members(spark, str(tmp_path / "big.zip")).collect()} == {("a.txt", "one"), ("b.txt", "two")}


def test_members_that_are_refused(spark, tmp_path):
    archive(tmp_path / "a.zip", [("../up.txt", "x"), ("/abs.txt", "x"), ("a\\..\\..\\b.txt", "x"), ("C:\\c.txt", "x"), ("fine..txt", "ok"), ("é.txt", "ü"), ("damaged.txt", "0123456789" * 20), ("locked.txt", "x"), ("empty.txt", "")])
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        infos = {x.filename: x for x in z.infolist()}
        spots = z.start_dir
    raw[infos["damaged.txt"].header_offset + 30 + len("damaged.txt") + 2] ^= 255
    at = raw.index(b"locked.txt", spots) - 46
    raw[at + 8] |= 1  # the directory says that it is encrypted
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    found = {r.member: (r.problem, r.content and bytes(r.content).decode()) for r in files.archives(spark, str(tmp_path / "a.zip")).collect()}
    assert {k: v[0] for k, v in found.items() if v[0]} == {
        "../up.txt": "unsafe name", "/abs.txt": "unsafe name", "a\\..\\..\\b.txt": "unsafe name", "C:\\c.txt": "unsafe name", "damaged.txt": "damaged", "locked.txt": "encrypted",
    }
    assert found["fine..txt"][1] == "ok" and found["é.txt"][1] == "ü" and found["empty.txt"][0] is None
    with pytest.raises(Exception, match="none.zip"):
        files.archives(spark, str(tmp_path / "none.zip")).collect()


def test_files_are_written_and_copied(spark, tmp_path):
    (tmp_path / "in.png").write_bytes(bytes(range(256)) * 5000)
    out = tmp_path / "out"
    files.write_files(as_rows(spark, [("a/b.txt", "ü\n", None), ("a/none.txt", "", None), ("c.png", None, f"file:{tmp_path}/in.png")]).repartition(3), str(out))
    assert (out / "a/b.txt").read_bytes() == "ü\n".encode() and (out / "a/none.txt").read_bytes() == b"" and (out / "c.png").read_bytes() == (tmp_path / "in.png").read_bytes()
    assert sorted(x.name for x in out.iterdir()) == ["a", "c.png"]


@pytest.mark.parametrize("zipped", [False, True])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, zipped):
    """One task writes its files, then another finds no source: what had been moved is taken back, and nothing is half there."""
    rows = [(f"f{k}.txt", "x" * 1000, None) for k in range(50)] + [("last.png", None, str(tmp_path / "missing.png"))]
    out = tmp_path / "out"
    with pytest.raises(Exception, match="missing.png"):
        files.write_files(as_rows(spark, rows).repartition(4), str(out), zipped)
    for _ in range(50):  # tasks that still ran when the job was given up
        left = [x for x in out.rglob("*") if x.is_file()] + list(out.glob("_staging*"))
        if not left:
            break
        time.sleep(0.2)
    assert left == []
    with pytest.raises(Exception, match="not a path below"):
        files.write_files(as_rows(spark, [("../x.txt", "x", None)]), str(out))
    assert not (tmp_path / "x.txt").exists()


def test_label_files_go_round(spark, tmp_path):
    lines = spark.createDataFrame([("train", "a", 1, "1 2"), ("train", "a", 0, "0 1"), ("val", "b c", 0, "")], "split string, stem string, line_no int, value string")
    root = str(tmp_path / "labels")
    sources.write_labels(lines, root)
    assert (tmp_path / "labels/train/labels/a.txt").read_text() == "0 1\n1 2\n"
    found = {(r.split, r.stem, r.line_no, r.value) for r in sources.label_lines(spark, root, "s").collect()}
    assert found == {("train", "a", 0, "0 1"), ("train", "a", 1, "1 2"), ("val", "b c", 0, "")} or found == {("train", "a", 0, "0 1"), ("train", "a", 1, "1 2"), ("val", "b%20c", 0, "")}
    with pytest.raises(FileExistsError):
        sources.write_labels(lines, root)
    sources.write_labels(lines.where("split = 'val'"), root, overwrite=True)
    assert names_in(spark, root) == ["val"]


def test_no_report_of_nothing(spark, tmp_path):
    some = spark.createDataFrame([(" a ", [1, 2])], "k string, v array<int>")
    assert not sources.write_csv(some.where(F.lit(False)), str(tmp_path / "r")) and not (tmp_path / "r").exists()
    assert sources.write_csv(some, str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == [(" a ", "[1,2]")]


def test_label_lines_are_listed_and_read_by_tasks(spark, tmp_path):
    folder = tmp_path / "valid" / "labels"
    folder.mkdir(parents=True)
    for name, text in {"a.txt": "0 1\r\n\r\n2 3\n", "b c.txt": "4 5", "empty.txt": "", "_hidden.txt": "x", "d.TXT": "x", "e.jpg": "x"}.items():
        (folder / name).write_bytes(text.encode())
    read = sources.label_lines(spark, str(tmp_path), "s")
    assert read.inputFiles() == []  # the driver holds no file of the folder
    assert sorted((r.split, r.stem, r.line_no, r.value) for r in read.collect()) == [("val", "a", 0, "0 1"), ("val", "a", 1, ""), ("val", "a", 2, "2 3"), ("val", "b c", 0, "4 5")]
