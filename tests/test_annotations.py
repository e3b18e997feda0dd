"""Label files: line and file mode, sources on disk, remapping, splits."""

import zipfile

import pytest

from larkspur.operators import annotations as A
from larkspur.operators import split
from larkspur.sources import annotations as S

FILES = {
    "ok": "1 0.5 0.5 0.2 0.2\n", "trunc": "1.9 0.5 0.5 0.2 0.2\n", "class7": "7 0.5 0.5 0.2 0.2\n", "out": "1 1.2 0.5 0.2 0.2\n", "zero": "1 0.5 0.5 0 0.2\n",
    "four": "1 0.5 0.5 0.2\n", "word": "x 0.5 0.5 0.2 0.2\n", "nan": "nan 0.5 0.5 0.2 0.2\n", "nanw": "1 0.5 0.5 nan 0.2\n", "empty": "", "blank": "\n  \n", "two": "0 0.5 0.5 0.2 0.2\n2\t0.5 0.5 0.2 0.2\r\n",
    "score": "1_0 0.5 0.5 0.2 0.2\n", "tail": "1 0.5 0.5 0.2 5d\n", "inf": "inf 0.5 0.5 0.2 0.2\n",
}
STATUS = {
    "ok": "sample", "trunc": "sample", "class7": "invalid", "out": "invalid", "zero": "invalid", "four": "invalid", "word": "invalid", "nan": "invalid", "nanw": "invalid", "empty": "empty", "blank": "blank",
    "two": "multi_class", "score": "invalid", "tail": "invalid", "inf": "invalid",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("set")
    (base / "valid" / "labels").mkdir(parents=True)
    for name, text in FILES.items():
        (base / "valid" / "labels" / f"{name}.txt").write_text(text, newline="")
    return base


def test_modes_on_files(spark, root):
    lines, files = S.label_lines(spark, str(root), "s"), S.label_files(spark, str(root), "s")
    checked = A.valid_files(files, lines).collect()
    assert {r.stem: r.status for r in checked} == STATUS and {r.split for r in checked} == {"val"}
    mapping = spark.createDataFrame([(k, k) for k in range(4)], "old_id int, new_id int")
    kept = A.kept_lines(lines, mapping)
    assert sorted((r.stem, r.class_id) for r in kept.collect()) == [("ok", 1), ("trunc", 1), ("two", 0), ("two", 2)]
    assert [r.n_boxes for r in A.class_counts(kept).orderBy("class_id").collect()] == [1, 2, 1, 0]
    assert {r.stem for r in A.samples(A.valid_files(files, lines), take_smallest=True).collect()} == {"ok", "trunc", "two"}


def test_pairing(spark):
    key = "source string, split string, stem string"
    files = spark.createDataFrame([("s", "train", x) for x in "ab"], key)
    images = spark.createDataFrame([("s", "train", "a", ".png"), ("s", "train", "a", ".jpg"), ("s", "train", "c", ".jpg")], key + ", ext string")
    assert [(r.stem, r.ext) for r in A.with_images(files, images).collect()] == [("a", ".jpg")]
    assert [(r.stem, r.n) for r in A.collisions(images).collect()] == [("a", 2)]
    kept = files.where("stem = 'a'")
    reasons = {(r.stem, r.ext): r.reason for r in A.with_labels(images, files, kept).collect()}
    assert reasons == {("a", ".png"): None, ("a", ".jpg"): None, ("c", ".jpg"): "Missing label file"}


def test_names_and_description(spark, tmp_path):
    names = spark.createDataFrame([(0, "Engaged"), (1, " Boredom "), (2, "disengaged"), (3, "sleepy")], "old_class_id int, old_class_name string")
    assert [(r.new_class_id, r.action) for r in A.name_mapping(names).orderBy("old_class_id").collect()] == [(0, "KEEP"), (2, "KEEP"), (0, "KEEP"), (None, "DROP")]
    text = S.description({0: "engaged", 1: "bored"})
    assert S.described(text)["names"] == {0: "engaged", 1: "bored"}
    assert S.described("names: [a, 'b']\n")["names"] == {0: "a", 1: "b"}
    assert S.described("names:\n  - a\n  - b\n")["names"] == {0: "a", 1: "b"}
    with pytest.raises(ValueError):
        S.described("nc: 3\n")


def test_zip_members(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("train/labels/a.txt", "1 0.5 0.5 0.2 0.2")
        z.writestr("../evil.txt", "x")
        z.writestr("a.jpg", "x")
    found = {r.member: r.text for r in S.zip_members(spark, str(path)).collect()}
    assert found == {"train/labels/a.txt": "1 0.5 0.5 0.2 0.2", "../evil.txt": None}


def test_split_counts_are_exact(spark):
    sizes = {"engaged": 524, "confused": 386, "bored": 368, "frustrated": 420}
    want = {"engaged": (419, 52, 53), "confused": (308, 38, 40), "bored": (294, 36, 38), "frustrated": (336, 42, 42)}
    rows = spark.createDataFrame([(f"{c}_{i}", c) for c, n in sizes.items() for i in range(n)], "path string, label string")
    done = split.stratified_split(rows, "label", "path")
    counts = split.split_counts(done, "label")
    found = {(r.new_split, r.label): r.images for r in counts.collect()}
    assert {c: tuple(found[s, c] for s in split.SPLITS) for c in sizes} == want
    assert split.readiness(counts).first().verdict == "READY_FOR_TRAINING"
    assert {r.new_split: r.text for r in split.imbalance(counts).collect()}["train"] == "1.43"
    with pytest.raises(ValueError):
        split.check_ratios((0.5, 0.2, 0.2))


def test_null_class_is_counted(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else "a") for k in range(40)], "key long, kind string")
    counts = split.split_counts(split.stratified_split(rows, "kind", "key"), "kind").collect()
    assert sum(r.images for r in counts) == 40 and sum(r.images for r in counts if r.kind is None) == 20


def test_long_zip_members_are_whole(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/long.txt", "line of text\n" * 300_000)
        z.writestr("../up.txt", "no")
    found = {r.member: r.text for r in S.zip_members(spark, str(tmp_path / "a.zip")).collect()}
    assert len(found["x/long.txt"]) == 13 * 300_000 and found["../up.txt"] is None


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("s", "train", "a", 0, "1 0.5 0.5 0.2 0.2")], "source string, split string, stem string, line_no int, value string")
    plan = A.kept_lines(lines, A.id_mapping(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
