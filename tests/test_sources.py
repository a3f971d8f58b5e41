"""The folder of documents as a data source, and the table function of turns."""

import os

import pytest
from pyspark.sql import functions as F

from loomcode.functions import tables
from loomcode.operators import conventions, segment
from loomcode.sources import datasource, sinks


def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("  x \r\n\n caf\xe9".encode("latin-1"))
    (tmp_path / "sub" / "b.HTM").write_text("<p>A &amp; B<br>c</p>")
    (tmp_path / "c.docx").write_bytes(sinks.docx("one\n\n two < three "))
    (tmp_path / "d.xlsx").write_bytes(sinks.packed({"s": (["ID", " text "], [(1, "x"), (2, None), (3, " ")]), "empty": (["h"], [])}))
    for name, data in (("e.docx", b"broken"), ("f.xlsx", b""), ("g.doc", b"old"), ("h.pdf", b"?"), ("~$a.txt", b"lock"), ("_SUCCESS", b""), ("i.txt", b"")):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_a_mixed_folder(spark, tmp_path):
    datasource.register(spark)
    rows = spark.read.format(datasource.NAME).option("group_bytes", 10).load(folder(tmp_path))
    got = {}
    for r in rows.collect():
        got.setdefault(r["filename"], []).append((r["kind"], r["text"], r["row_no"], r["column"], (r["error"] or "").split(":")[0]))
    assert got["a.txt"] == [("transcript", "x\ncafé", None, None, "")] and got["b.HTM"] == [("transcript", "A & B\nc", None, None, "")] and got["c.docx"] == [("transcript", "one\ntwo < three", None, None, "")]
    assert got["d.xlsx"] == [("workbook", "1", 2, "ID", ""), ("workbook", "x", 2, "text", ""), ("workbook", "2", 3, "ID", ""), ("workbook", "3", 4, "ID", "")]
    assert got["e.docx"][0][4] == got["f.xlsx"][0][4] == "BadZipFile" and got["g.doc"][0][4] == "old Word format" and got["h.pdf"][0][4] == "unknown suffix"
    assert got["i.txt"] == [("transcript", "", None, None, "")] and len(got) == 9
    assert rows.rdd.getNumPartitions() > 3
    assert {r["filename"] for r in rows.where("kind = 'workbook'").collect()} == {"d.xlsx", "f.xlsx"}


def test_files_are_not_opened_for_what_the_list_knows(tmp_path):
    from pyspark.sql.types import StructType

    path = folder(tmp_path)
    os.chmod(tmp_path / "a.txt", 0)
    thin = datasource.DocumentReader(path, StructType().add("filename", "string").add("size", "long"), 1 << 20)
    thin.rows = lambda *_: pytest.fail("a file was opened")
    parts = thin.partitions()
    assert len(parts) == 1 and sorted(thin.read(parts[0]))[0][0] == "a.txt"
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(thin.pushFilters([EqualTo(("filename",), "a.txt"), GreaterThan(("size",), 1), In(("kind",), ("transcript",))]))
    assert len(rest) == 1 and [f for p in thin.partitions() for f, _ in p.listed] == [str(tmp_path / "a.txt")]
    assert [f for p in datasource.DocumentReader(f"file:{path}/sub", StructType(), 1).partitions() for f, _ in p.listed] == [f"{path}/sub/b.HTM"]


TEXTS = [
    "head\n\nA [00:00:01]: hi\nmore\nB [00:00:02]: yes \nA [00:00:03]: no", "", None, "no turns here\nat all", "A: \nA: x\nA: \nA: \nA: y\nB: \nA: z\nplain\nB:  ", "  i. : hello\nI: again", "B: \n tail\nB: \nB: ", "A: b: c\n: x\n. : y",
    " A : wide  \nA: \n",
]


@pytest.mark.parametrize("name", ["plain", "default", "f4", "happyscribe"])
def test_turns_in_sql(spark, name):
    tables.register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(20, "[00:00:01.000] - ANNA\nhi\n[00:00:02.000] - ANNA\n[00:00:03.000] - ANNA\nyes"), (21, "A: x #0:00:01-1#\nB: y #0:00:02-1#")], "doc_id long, text string").repartition(3)
    docs.createOrReplaceTempView("some_transcripts")
    regex = conventions.PRESETS[name]
    literal = regex.replace("\\", "\\\\").replace("'", "\\'")
    got = spark.sql(f"select t.* from transcript_turns(table(some_transcripts) partition by doc_id, regex => '{literal}') t")
    plain = segment.utterances(docs, conventions.Pattern(regex))
    columns = ["doc_id", "position", "speaker", "ts", "text", "front"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert got.select(F.countDistinct("doc_id")).first()[0] >= 5
