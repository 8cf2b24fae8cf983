import json

import pytest

from tracemill.sources import files

RECORD = {"sample_id": "a", "image_path": "x.png", "boxes": [[1.0, 2.0, 3.0, 4.0]], "seed_box": [8.0, 4.0, 20.0, 60.0], "seed_label": 1, "attributes": [float(i) for i in range(16)], "source_file": "s", "study_id": "t", "instrument_id": "i", "subsets": ["low_snr"], "metadata": {"k": "v"}}


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps(RECORD) + "\n\n" + json.dumps(RECORD | {"sample_id": "b", "attributes": [None] * 16}) + "\n")
    rows = files.manifest(spark, f"file://{tmp_path}/m.jsonl")
    files.save_manifest(rows, f"file://{tmp_path}/out")
    again = files.manifest(spark, f"file://{tmp_path}/out")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect())) and rows.count() == 2


@pytest.mark.parametrize("line", ["not json", json.dumps(RECORD | {"attributes": [1.0] * 15})])
def test_bad_manifest_line(spark, tmp_path, line):
    (tmp_path / "m.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match="bad manifest line"):
        files.manifest(spark, f"file://{tmp_path}/m.jsonl").collect()


def test_feature_table_gets_ids(spark, tmp_path):
    (tmp_path / "f.csv").write_text("mz,RT\n200.5,1\n100.5,2\n")
    rows = files.feature_table(spark, f"file://{tmp_path}/f.csv", order=["mz"]).orderBy("mz").collect()
    assert [r.Feature_ID for r in rows] == ["F000001", "F000002"]


def test_files_and_annotations(spark, tmp_path):
    for d in ("img", "doc"):
        (tmp_path / d).mkdir()
    for stem in "ab":
        (tmp_path / "img" / f"{stem}.png").write_bytes(stem.encode())
    (tmp_path / "doc" / "b.json").write_text(json.dumps({"shapes": [{"label": "Peak", "points": [[1, 2], [3, 4]], "shape_type": "rectangle"}, {"label": "x", "points": [], "shape_type": "p"}], "imageWidth": 4}))
    top = f"file://{tmp_path}"
    assert [(r.stem, r.aligned) for r in files.pairs(spark, f"{top}/img", f"{top}/doc").orderBy("stem").collect()] == [("a", False), ("b", True)]
    assert [(r.stem, r.points) for r in files.annotations(spark, f"{top}/doc/*.json", ["Peak"]).collect()] == [("b", [[1.0, 2.0], [3.0, 4.0]])]
    h = files.hashes(spark, f"{top}/img/*")
    assert {(r.kind, r.size) for r in h.collect()} == {("png", 1)} and files.newest(spark, f"{top}/img/*").endswith(".png")


def test_resolve(spark):
    inventory = spark.createDataFrame([("A.mzML", "/x/A.mzML", "1"), ("a.mzml", "/longer/a.mzml", "1"), ("B", "/b", "1"), ("b", "/c/b", "2")], "name string, path string, sha256 string")
    wanted = spark.createDataFrame([("a.MZML",), ("b",), ("c",)], "name string")
    assert {r.name: (r.path, r.status) for r in files.resolve(wanted, inventory).collect()} == {"a.MZML": ("/x/A.mzML", "found"), "b": (None, "conflict"), "c": (None, "missing")}


def test_hashes_of_folders_within_folders(spark, tmp_path):
    for k, at in enumerate(("k=1", "k=2", "k=2/deeper")):
        (tmp_path / at).mkdir()
        (tmp_path / at / f"{k}.txt").write_bytes(b"x" * (k + 1))
        (tmp_path / at / f"{k}.bin").write_bytes(b"no")
    got = {r.path.rpartition("/")[2]: (r.kind, r.size) for r in files.hashes(spark, f"file://{tmp_path}", "*.txt").collect()}
    assert got == {f"{k}.txt": ("txt", k + 1) for k in range(3)}
