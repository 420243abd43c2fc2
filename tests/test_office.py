"""Office files as data sources: names asked for before payloads are read, damage as rows, folders that appear whole."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.sources import containers, office
from tests.test_containers import PNG, compound, zipped


@pytest.fixture
def folder(spark, tmp_path):
    office.register(spark)
    held = [("FileHeader", b"HWP".ljust(256, b"\0")), ("DocInfo", b"x" * 5000), ("Other", b"skip"), ("empty", b"")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.hwp").write_bytes(compound(held))
    (tmp_path / "sub" / "b.HWPX").write_bytes(zipped({"Contents/section0.xml": b"<a/>", "BinData/i.png": PNG, "mimetype": b"m"}))
    (tmp_path / "c.hwp").write_bytes(bytes.fromhex(containers.OLE_MAGIC) + b"cut")
    (tmp_path / "d.txt").write_bytes(b"no")
    (tmp_path / "_e.hwp").write_bytes(b"hidden")
    broken = zipped({"Contents/header.xml": b"<h/>", "BinData/j.png": b"j" * 50})
    (tmp_path / "f.hwpx").write_bytes(broken.replace(b"<h/>", b"<g/>", 1))
    return tmp_path


def read(spark, folder, **options):
    return spark.read.format("office_streams").options(**options).load(str(folder))


def test_the_same_rows_as_the_reader_of_whole_files(spark, folder):
    files = containers.read_files(spark, str(folder))
    whole = {(r.doc_id, r.path, r.source_path, bytes(r.payload)) for r in containers.streams(files, wanted_only=False).where("error is null").collect()}
    found = read(spark, folder, groupbytes="1").collect()
    good = {(r.doc_id, r.path, r.source_path, bytes(r.payload)) for r in found if r.error is None}
    # The other reader gives up a file at its first damaged part.
    assert good - whole == {r for r in good if r[0].startswith("f_hwpx")} and whole <= good
    assert len(good) == 8 and {r[1] for r in good - whole} == {"BinData/j.png"}
    assert sorted((r.doc_id.split("_")[0], r.path) for r in found if r.error) == [("c", None), ("d", None), ("f", "FileHeader")]
    assert read(spark, folder, groupbytes="1").rdd.getNumPartitions() == 5


def test_filters_reach_the_source(spark, folder, capsys):
    df = read(spark, folder).where("path = 'DocInfo'")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(path,DocInfo)]" in plan and not re.search(r"\bFilter \(", plan)
    assert [(r.size, bytes(r.payload)) for r in df.collect()] == [(5000, b"x" * 5000)]
    # A damaged stream answers to its name; no other file's error does.
    header = read(spark, folder).where("path in ('FileHeader', 'none')").collect()
    assert sorted((r.doc_id.split("_")[0], r.error is None) for r in header) == [("a", True), ("f", False)]
    assert [r.path for r in read(spark, folder).where("path like 'BinData/i%'").collect()] == ["BinData/i.png"]
    one = read(spark, folder).where("path = 'BinData/i.png'").first().doc_id
    asked = read(spark, folder, groupbytes="1").where(F.col("doc_id") == one)
    assert (asked.rdd.getNumPartitions(), asked.count()) == (1, 3)
    # What isn't pushed still holds.
    assert [r.path for r in read(spark, folder).where("path = 'DocInfo' or size = 4").orderBy("path").select("path").distinct().collect()] == ["BodyText/Section0", "DocInfo", "FileHeader", "Other"]
    assert read(spark, folder).where("path is null").count() == 2
    assert read(spark, folder).where("path = 'DocInfo' and path = 'FileHeader'").count() == 0


def test_payloads_of_other_names_are_not_read(folder):
    reader = office.StreamReader({"path": str(folder)})
    assert list(reader.pushFilters([office.EqualTo(("path",), "DocInfo")])) == []
    asked = []
    entries = [(n, 1, lambda n=n: asked.append(n) or b"x") for n in ("FileHeader", "DocInfo", "BinData/x")]
    assert [r[1] for r in reader._streams("d", entries)] == ["DocInfo"] and asked == ["DocInfo"]


def test_listing_and_wanted(spark, folder):
    listed = read(spark, folder, payload="false").where("doc_id like 'a_%'").orderBy(F.lower("source_path")).collect()
    assert [(r.source_path, r.size, r.payload) for r in listed] == [("DocInfo", 5000, None), ("empty", 0, None), ("FileHeader", 256, None), ("Other", 4, None)]
    kept = read(spark, folder, wanted="true").where("error is null").collect()
    assert sorted(r.path for r in kept) == ["BinData/i.png", "BinData/j.png", "BodyText/Section0", "DocInfo", "FileHeader"]
    (folder / "none").mkdir()
    assert read(spark, folder / "none").count() == 0


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def rows(spark, *given):
    return spark.createDataFrame([(d, n, c) for d, n, c in given], "doc_id string, name string, content binary")


def test_files_are_written_once(spark, tmp_path):
    office.register(spark)
    out = tmp_path / "out"
    df = rows(spark, ("a_hwp", "summary.json", b"{}"), ("a_hwp", "BodyText/Section0.json", b"[]"), ("b_hwp", "summary.json", b"")).repartition(3)
    df.write.format("office_files").mode("append").save(str(out))
    assert tree(out) == {"a_hwp/summary.json": b"{}", "a_hwp/BodyText/Section0.json": b"[]", "b_hwp/summary.json": b""}
    with pytest.raises(Exception, match="there already"):
        rows(spark, ("c_hwp", "x", b"1"), ("a_hwp", "summary.json", b"2")).write.format("office_files").mode("append").save(str(out))
    assert "c_hwp/x" not in tree(out) and len(tree(out)) == 3
    rows(spark, ("a_hwp", "summary.json", b"2")).write.format("office_files").mode("overwrite").save(str(out))
    assert tree(out)["a_hwp/summary.json"] == b"2" and len(tree(out)) == 3
    df.where("false").write.format("office_files").mode("append").save(str(tmp_path / "none"))
    assert tree(tmp_path / "none") == {}


@pytest.mark.parametrize("bad", [("x", "../y", b""), ("x", "/y", b""), ("..", "y", b""), ("x/z", "y", b""), ("x", None, b""), ("x", "y", None), ("x", "n5", b"again")])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    office.register(spark)
    given = [("x", f"n{k}", b"1") for k in range(20)]
    with pytest.raises(Exception):
        rows(spark, *given, bad).repartition(4).write.format("office_files").mode("append").save(str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file() or p.name.startswith("_job")] == []


def test_two_attempts_of_a_task_leave_one_file(tmp_path):
    writer = office.FileWriter({"path": str(tmp_path)}, False)
    given = [{"doc_id": "a", "name": "n", "content": b"1"}]
    writer.write(given)  # lost before it could be counted
    second = writer.write(given)
    writer.commit([second, None])
    assert tree(tmp_path) == {"a/n": b"1"} and sorted(p.name for p in tmp_path.iterdir()) == ["a"]
