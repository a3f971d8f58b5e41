"""Sinks for small results: workbooks, codebook and project exchange files, corpus bundles, chart data."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcode.operators.numbering import numbered
from loomcode.sources.datasource import file_system
from loomcode.store import written

_QDA = "urn:QDA-XML:codebook:1.0"
_PROJECT = "urn:QDA-XML:project:1.0"
BUNDLE = "loomcode-corpus/1"
#: Rows of a sheet under its header.
MOST_ROWS = (1 << 20) - 1


def _name(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """An .xlsx of the sheets that have rows; for results of a report's size. More rows than a sheet can hold are refused."""
    kept = {k: (df.columns, df.limit(MOST_ROWS + 1).collect()) for k, df in sheets.items()}
    for k, (_, rows) in kept.items():
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{k} has more rows than a sheet can hold")
    return packed({k: v for k, v in kept.items() if v[1]} or dict(list(kept.items())[:1]))


def packed(kept: dict[str, tuple[list[str], list]]) -> bytes:
    """An .xlsx of (header, rows) for each sheet."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(kept) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(k[:31])}" sheetId="{i}" r:id="s{i}"/>' for i, k in enumerate(kept, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="s{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(kept) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, (columns, rows) in enumerate(kept.values(), 1):
            out = []
            for r, row in enumerate([columns, *rows], 1):
                cells = []
                for c, v in enumerate(row):
                    ref = f"{_name(c)}{r}"
                    if isinstance(v, bool | int | float):
                        cells.append(f'<c r="{ref}"><v>{float(v):.17g}</v></c>')
                    elif v is not None:
                        shown = "; ".join(map(str, v)) if isinstance(v, list) else str(v)
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(shown)}</t></is></c>')
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>')
    return buffer.getvalue()


def docx(text: str) -> bytes:
    """A .docx with a paragraph for each line."""
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{main}"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """rows: filename, content. Writes a file for each on the executors, under a folder that all machines see: filename, size."""

    def run(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for name, data in zip(b["filename"], b["content"], strict=True):
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(data)
            yield b.assign(size=b["content"].str.len())[["filename", "size"]]

    return rows.mapInPandas(run, "filename string, size long")


def _guid(kind: str, key) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"loomcode:{kind}:{key}"))


def _codes(parent, codes: list, ns: str) -> None:
    for c in codes:
        e = ElementTree.SubElement(parent, f"{{{ns}}}Code", guid=_guid("code", c["code_id"]), name=c["label"], isCodable="true")
        if c["description"]:
            ElementTree.SubElement(e, f"{{{ns}}}Description").text = c["description"]


def codebook_xml(codes: DataFrame) -> bytes:
    """A QDC codebook: a Code for each active code."""
    root = ElementTree.Element(f"{{{_QDA}}}CodeBook")
    _codes(ElementTree.SubElement(root, f"{{{_QDA}}}Codes"), codes.where("not coalesce(is_deleted, false)").orderBy("label").collect(), _QDA)
    ElementTree.register_namespace("", _QDA)
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def project_file(codes: DataFrame, documents: DataFrame, codings: DataFrame) -> bytes:
    """A QDPX: project.qde and a text for each document (doc_id, name, text); codings (doc_id, code_id, start_offset, end_offset) are selections.

    For one run's documents; each is a file of the archive that the driver builds.
    """
    root = ElementTree.Element(f"{{{_PROJECT}}}Project", name="project")
    book = ElementTree.SubElement(ElementTree.SubElement(root, f"{{{_PROJECT}}}CodeBook"), f"{{{_PROJECT}}}Codes")
    _codes(book, codes.orderBy("label").collect(), _PROJECT)
    sources = ElementTree.SubElement(root, f"{{{_PROJECT}}}Sources")
    per = codings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "code_id", "end_offset"))).alias("spans"))
    rows = documents.where("coalesce(trim(text), '') <> ''").join(per, "doc_id", "left").orderBy("doc_id")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for d in rows.toLocalIterator():
            guid = _guid("doc", d["doc_id"])
            z.writestr(f"sources/{guid}.txt", d["text"])
            s = ElementTree.SubElement(sources, f"{{{_PROJECT}}}TextSource", guid=guid, name=d["name"], plainTextPath=f"internal://{guid}.txt")
            for k, r in enumerate(d["spans"] or ()):
                at = ElementTree.SubElement(s, f"{{{_PROJECT}}}PlainTextSelection", guid=_guid("sel", (d["doc_id"], k)), startPosition=str(r["start_offset"]), endPosition=str(r["end_offset"]))
                coding = ElementTree.SubElement(at, f"{{{_PROJECT}}}Coding", guid=_guid("coding", (d["doc_id"], k)))
                ElementTree.SubElement(coding, f"{{{_PROJECT}}}CodeRef", targetGUID=_guid("code", r["code_id"]))
        ElementTree.register_namespace("", _PROJECT)
        z.writestr("project.qde", ElementTree.tostring(root, encoding="utf-8", xml_declaration=True))
    return buffer.getvalue()


def project_of_run(codes: DataFrame, documents: DataFrame, codings: DataFrame, run_documents: DataFrame) -> bytes:
    """The QDPX of a run: active codes and those that codings name, completed documents, and codings at places found anew.

    documents: doc_id, name, text; codings: coding_id, run_id, doc_id, code_id, segment_text, start_offset, end_offset.
    """
    from loomcode.operators import codebook, segment, workspace

    done = workspace.of_completed(codings, run_documents)
    ranked = done.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("start_offset"), "coding_id")))
    places = segment.reanchored(documents, ranked.select("doc_id", "ord", F.col("segment_text").alias("text"), "start_offset", "end_offset"))
    placed = ranked.select("doc_id", "ord", "code_id").join(places.drop("text"), ["doc_id", "ord"])
    complete = documents.join(run_documents.where("status = 'completed'").select("doc_id"), "doc_id", "left_semi")
    return project_file(codebook.active_or_referenced(codes, done), complete, placed)


def bundle(documents: DataFrame, input_type: str, conventions: dict[str, str], to=None) -> bytes | None:
    """documents: filename, file_path, content, language, grp. A zip of a manifest and each distinct file once, written to the open file
    `to`, or returned. Files pass through the driver one after the other; it holds a line of the manifest for each document."""
    first = documents.groupBy("file_path").agg(F.min("filename").alias("filename"))
    files = documents.join(first, ["file_path", "filename"]).dropDuplicates(["file_path"]).orderBy("filename", "file_path").select("file_path", "filename", "content")
    buffer = io.BytesIO() if to is None else to
    keys: dict[str, str] = {}
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.toLocalIterator():
            keys[r["file_path"]] = f"files/{len(keys)}_{r['filename']}"
            z.writestr(keys[r["file_path"]], bytes(r["content"]))
        rows = documents.select("filename", "file_path", "language", "grp").orderBy("filename", "file_path").toLocalIterator()
        entries = [{"filename": r["filename"], "key": keys[r["file_path"]], "language": r["language"], "group": r["grp"]} for r in rows]
        z.writestr("manifest.json", json.dumps({"format": BUNDLE, "input_type": input_type, "conventions": conventions, "documents": entries}))
    return buffer.getvalue() if to is None else None


def unbundled(data: bytes, input_type: str, conventions: dict[str, str]) -> tuple[list[dict], dict[str, str]]:
    """(documents with content, conventions merged); existing conventions stay."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        m = json.loads(z.read("manifest.json"))
        if m.get("format") != BUNDLE or m.get("input_type") != input_type:
            raise ValueError("not a corpus bundle of this kind")
        docs = [d | {"content": z.read(d["key"])} for d in m["documents"]]
    return docs, m.get("conventions", {}) | conventions


def read_bundles(spark, path: str, input_type: str, library: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: filename, file_path, language, grp, content; conventions: name, regex; errors: path, error) of the bundles under path.

    Bundles are read on the executors. One of another kind, or that is none, is an error of its own and gives nothing else. Conventions are the library's and those of the
    bundles that it has not; of bundles that differ in one, that with the first path counts.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                try:
                    docs, found = unbundled(data, input_type, {})
                    rows = [("document", name, d["filename"], f"{name}!{d['key']}", d["language"], d["group"], d["content"]) for d in docs]
                    rows += [("convention", name, k, v, None, None, None) for k, v in found.items()]
                except Exception as e:  # a broken bundle fails alone
                    rows = [("error", name, f"{type(e).__name__}: {e}", None, None, None, None)]
                yield pd.DataFrame(rows, columns=["kind", "path", "a", "b", "language", "grp", "content"])

    rows = written(files.mapInPandas(run, "kind string, path string, a string, b string, language string, grp string, content binary"), "bundles")
    documents = rows.where("kind = 'document'").select(F.col("a").alias("filename"), F.col("b").alias("file_path"), "language", "grp", "content")
    own = spark.createDataFrame(list((library or {}).items()), "name string, regex string")
    new = rows.where("kind = 'convention'").groupBy(F.col("a").alias("name")).agg(F.min_by("b", "path").alias("regex"))
    conventions = own.unionByName(new.join(own.select("name"), "name", "left_anti"))
    return documents, conventions, rows.where("kind = 'error'").select("path", F.col("a").alias("error"))


def chart_data(block: DataFrame, label: str, value: str, most: int | None = None) -> DataFrame:
    """label, value, ord: bars in falling order, the first `most` of them, or all, of any number."""
    rows = block.select(F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
    order = [F.desc("value"), F.col("label")]
    if most is None:
        return numbered(rows, "ord", order).withColumn("ord", (F.col("ord") + 1).cast("int"))
    return rows.orderBy(*order).limit(most).withColumn("ord", F.row_number().over(Window.orderBy(*order)))  # `most` rows


def available_charts(blocks: dict[str, DataFrame]) -> list[str]:
    return [k for k, df in blocks.items() if not df.isEmpty()]
