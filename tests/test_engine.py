"""Operators on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.operators import codebook, conventions, dictionary, runs, segment, units, workspace
from loomcode.operators.analysis import Analysis
from loomcode.sources import files, reports, sinks

F4 = """Interview 7
Place: somewhere
Notes
I: How are you? #0:00:05-1#
E: Fine. Very fine. #0:00:09-2#
and more
I: And now? #0:00:15-0#
e: Well. #0:00:20-0#
E. Yes indeed. #0:00:25-0#
I: Thanks. #0:00:30-0#
E: Bye. #0:00:35-0#"""


def doc(spark, text, doc_id=1, lang="en"):
    return spark.createDataFrame([(doc_id, text, lang)], "doc_id long, text string, lang string")


def test_utterances_and_front_matter(spark):
    found = conventions.detect(doc(spark, F4), conventions.candidates()).first()
    assert found["name"] == "f4" and found["roles"] == {"E": "participant", "I": "interviewer"}
    pattern = conventions.Pattern(conventions.PRESETS["f4"])
    speakers = spark.createDataFrame([(1, ["E", "I"])], "doc_id long, accepted array<string>")
    u = segment.utterances(doc(spark, F4), pattern, speakers)
    roles = spark.createDataFrame([(1, {"I": "interviewer", "E": "participant"})], "doc_id long, roles map<string,string>")
    rows = segment.with_exclusion(u, roles, ["interviewer"]).orderBy("position").collect()
    assert [r["front"] for r in rows[:4]] == [True, True, True, False]
    assert [r["speaker"] for r in rows[3:]] == ["I", "E", "E", "I", "E", "E", "I", "E"]
    assert sum(r["excluded"] for r in rows) == 6
    assert rows[4]["ts"] == "0:00:09"
    parts = segment.speaker_sentences(segment.with_exclusion(u, roles, ["interviewer"])).orderBy("position").collect()
    assert [r["text"] for r in parts if r["speaker"] == "E"][:2] == ["Fine.", "Very fine."]


def test_other_conventions(spark):
    plain = "S00: one\nS01: two\nS00: three\nS01: four"
    assert conventions.detect(doc(spark, plain), conventions.candidates()).first()["name"] in ("plain", "f4")
    odd = "\n".join(f">>P{i % 2}<< text {i}" for i in range(10))
    assert conventions.detect(doc(spark, odd), conventions.candidates()).count() == 0
    own = conventions.candidates({"mine": r"^>>(?P<speaker>\w+)<<\s*(?P<text>.*)$"})
    found = conventions.detect(doc(spark, odd), own).first()
    assert found["name"] == "mine" and "P0" in found["roles"]
    assert conventions.scores(doc(spark, ""), conventions.candidates()).count() == 0
    with pytest.raises(ValueError):
        conventions.Pattern("^nothing$")


def test_header_merge(spark):
    text = "[00:00:01.000] - A\n[00:00:02.000] - A\nhi\n[00:00:03.000] - B\nthere\nmore\n[00:00:09.000] - A"
    rows = segment.utterances(doc(spark, text), conventions.Pattern(conventions.PRESETS["happyscribe"])).orderBy("position").collect()
    assert [(r["speaker"], r["ts"], r["text"]) for r in rows] == [("A", None, "hi"), ("B", "00:00:03", "there"), ("B", None, "more")]


def parsed_by_hand(name, line):
    """(speaker, time, text) of a line by the rules of a layout, without a pattern; null if it is no turn."""

    def clock(x, hours):
        p = x.split(":")
        return len(p) == 3 and all(y.isdigit() for y in p) and len(p[0]) in hours and len(p[1]) == len(p[2]) == 2

    def label(x, refused, spaces):
        return 1 <= len(x) <= 24 and not any(c in refused or (c.isspace() and not spaces) for c in x)

    def spoken(rest):
        return bool(rest) and rest[0].isspace() and bool(rest.strip())

    if name in ("f4", "plain"):
        signs = ":." if name == "f4" else ":"
        i = next((i for i, c in enumerate(line) if c in signs + "[]" or c.isspace()), len(line))
        who, rest = line[:i], line[i:].lstrip()
        if not label(who, ":[]" if name == "plain" else ":.[]", False) or rest[:1] not in tuple(signs) or not spoken(rest[1:]):
            return None
        text, ts = rest[1:].strip(), None
        if name == "f4" and text.endswith("#") and "#" in text[:-1]:
            body, mark = text[:-1].rsplit("#", 1)
            if "-" in mark and clock(mark.rsplit("-", 1)[0], (1, 2)) and mark.rsplit("-", 1)[1].isdigit() and body.strip():
                text, ts = body.strip(), mark.rsplit("-", 1)[0]
        return who, ts, text
    if name == "default":
        i, j = line.find("["), line.find("]")
        who, rest = line[:i].strip(), line[j + 1 :].lstrip()
        ok = 0 < i < j and label(line[:i].rstrip(), ":[]", True) and clock(line[i + 1 : j], (1, 2)) and rest.startswith(":") and rest[1:].strip()
        return (who, line[i + 1 : j], rest[1:].strip()) if ok else None
    j = line.find("]")
    if not line.startswith("[") or j < 0:
        return None
    if name == "ts_lead":
        rest = line[j + 1 :]
        if not clock(line[1:j], (1, 2)) or not rest[:1].isspace() or ":" not in rest:
            return None
        who, said = rest.lstrip().split(":", 1)
        return (who.rstrip(), line[1:j], said.strip()) if label(who.rstrip(), ":", False) and spoken(said) else None
    time, _, ms = line[1:j].partition(".")
    rest = line[j + 1 :].lstrip()
    return (rest[1:].strip(), time, "") if clock(time, (2,)) and len(ms) == 3 and ms.isdigit() and rest.startswith("-") and rest[1:].strip() else None


def test_presets_on_generated_lines(spark):
    import random

    rng = random.Random(3)
    who, gaps = ["I", "S 01", "Änne", "E.", "http", "10", "a" * 25, "[x", "B\u00a0C"], ["", " ", "  "]
    times, said = ["[0:01:02]", "[00:01:02]", "[00:01:02.123]", "[1:2:3]", "", "(0:00)"], ["hi", "//a.b/c", "", "we met: at 5", "yes #0:00:01-12#", "#0:00:01-1#", "no #0:01-1#", "é 👍"]
    rows = []
    for _ in range(9000):
        g = lambda: rng.choice(gaps)
        w, t, x, sep = rng.choice(who), rng.choice(times), rng.choice(said), rng.choice([":", ":", ".", "-", ""])
        line = rng.choice([f"{w}{g()}{t}{g()}{sep}{g()}{x}", f"{t}{g()}{w}{g()}{sep}{g()}{x}", f"{t}{g()}-{g()}{w}", f"{w}{g()}{sep}{g()}{x}{g()}"]).strip()
        if line:
            rows.append(line)
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, line string")
    for name, regex in conventions.PRESETS.items():
        speaker, ts, text, ok = conventions.Pattern(regex).columns(F.col("line"))
        got = {r["i"]: r for r in lines.select("i", speaker.alias("who"), ts.alias("ts"), T.strip(text).alias("text"), ok.alias("ok")).collect()}
        want = [parsed_by_hand(name, x) for x in rows]
        assert sum(w is not None for w in want) > 40, name
        for i, w in enumerate(want):
            r = got[i]
            assert r["ok"] == (w is not None), (name, rows[i])
            if w:
                assert (r["who"].strip(), r["ts"], r["text"]) == w, (name, rows[i])


def test_rounding_is_on_the_binary_value(spark):
    import random

    rng = random.Random(5)
    values = [100 * n / d for d in (1, 3, 7, 8, 16, 40, 80, 160, 400, 2000, 8000) for n in range(0, d + 1, max(d // 200, 1))] + [-0.25, -12.35, 0.0, 2.5, 1e6 + 0.05]
    values += [rng.uniform(0, 100) for _ in range(500)] + [k / 20 for k in range(400)] + [k / 20000 for k in range(1, 4000, 7)]
    got = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", T.rounded(F.col("x"), 1).alias("a"), T.rounded(F.col("x"), 3).alias("b"), T.rounded(F.col("x"), 4).alias("c")).collect()
    for r in got:
        assert (r["a"], r["b"], r["c"]) == (round(r["x"], 1), round(r["x"], 3), round(r["x"], 4))


def plain_offsets(full, texts):
    cursor, out = 0, []
    for t in texts:
        at = full.find(t, cursor)
        at = full.find(t) if at < 0 else at
        out.append((0, len(t)) if at < 0 else (at, at + len(t)))
        cursor = cursor if at < 0 else at + len(t)
    return out


def test_offsets(spark):
    full = "ab 😀 ab cd ab"
    texts = ["ab", "ab", "cd", "😀", "zz", "ab", "ab"]
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, position int, text string")
    rows = segment.anchored(doc(spark, full), units).orderBy("position").collect()
    assert [(r["start_offset"], r["end_offset"]) for r in rows] == plain_offsets(full, texts)
    codings = spark.createDataFrame([(1, 0, "cd", 1, 2), (1, 1, "cd", 1, 2), (1, 2, "zz", 3, 4), (1, 3, "yy", None, None)], "doc_id long, ord int, text string, start_offset int, end_offset int")
    rows = segment.reanchored(doc(spark, full), codings).orderBy("ord").collect()
    assert [(r["start_offset"], r["end_offset"]) for r in rows] == [(8, 10), (8, 10), (3, 4), (0, len(full))]


ANSWERS = ["The staff were great staff.", "I had to borrow money. The medication costs are high.", "Nothing.", "I like to go where I want.", "I want where I go."]


def survey(spark):
    cells = spark.createDataFrame([(i, 0, t, "en") for i, t in enumerate(ANSWERS, 2)], "doc_id long, position int, text string, lang string")
    codes = spark.createDataFrame([(1, "staff", None, None, False, None), (2, "money", "about money", None, False, None), (3, "bare", None, None, False, None), (4, "agency", None, None, False, None)], codebook.CODES)
    exprs = spark.createDataFrame([(1, 1, "en", "great staff"), (2, 2, "en", "borrow money"), (3, 2, "en", "medication costs"), (4, 4, "en", '"go where I want"'), (5, 4, "en", "of the to")], codebook.EXPRESSIONS)
    return cells, codes, exprs


def test_dictionary(spark):
    cells, codes, exprs = survey(spark)
    found = {(r["doc_id"], r["code_id"]): r for r in runs.dictionary_codings(cells, codes, exprs).collect()}
    assert set(found) == {(2, 1), (3, 2), (5, 4)}
    assert found[3, 2]["score"] == 2 and found[3, 2]["matched_expressions"] == ["borrow money", "medication costs"]
    index = dictionary.build_index(codes, exprs)
    assert index.count() == 4
    rows = dictionary._match_inverted(dictionary.unit_sentences(cells), index)
    assert {(r["doc_id"], r["code_id"]) for r in rows.collect()} == set(found)
    preview = codebook.lemma_preview(spark, ["of the to", '"of the"', "great"], "en").collect()
    assert [(r["lemmas"], r["warning"]) for r in preview] == [([], "inert"), (["of", "the"], None), (["great"], "weak")]


def test_analysis(spark):
    cells, codes, exprs = survey(spark)
    found = runs.dictionary_codings(cells, codes, exprs)
    segs = runs.segments(cells, found)
    docs = cells.select("doc_id", "lang", F.when(F.col("doc_id") < 4, "a").alias("grp"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    a = Analysis(segs, found, docs, codes, {"en": [" Staff ", "clinic", ""]})
    assert a.meta().first().asDict() == {"n_segments": 5, "n_coded": 3, "n_excluded": 0}
    assert [r["pct_units"] for r in a.codes().collect()] == [20.0, 20.0, 20.0]
    groups = {(r["label"], r["grp"]): r for r in a.groups().collect()}
    assert groups["staff", "a"]["pct"] == 50.0 and groups["staff", ""]["pct"] == 0.0 and groups["staff", "a"]["deviation"] == 25.0
    lemmas = {r["lemma"]: r for r in a.lemmas().collect()}
    assert "staff" not in lemmas and lemmas["great"]["freq"] == 1 and lemmas["great"]["flagged"]
    assert {(r["label_a"], r["units"]) for r in a.cooccurrence().collect()} == {("staff", 1), ("money", 1), ("agency", 1)}
    assert a.top_extracts().where("label = 'money'").first()["score"] == 2
    assert a.segments_export().where("doc_id = 2").first()["codes"] == "staff"
    empty = Analysis(segs.where("false"), found.where("false"), docs.where("false"), codes)
    assert all(df.count() == 0 for k, df in empty.blocks().items() if k != "meta")
    book = sinks.workbook({k: v for k, v in a.blocks().items() if k in ("codes", "lemmas")})
    assert ("codes", 1, 0, "code_id") in files.workbook_cells(book)
    sheets = reports.analysis_sheets(a)
    assert {"codes", "groups", "cooccurrence", "documents", "lemmas_en", "lemmas_by_code_en", "lemmas_by_code_group_en", "expressions_en", "expr_by_code_group_en", "top_extracts"} == set(sheets)
    assert sheets["documents"].columns == ["document", "group", "segments", "coded", "coverage_pct", *[r["label"] for r in a.codes().collect()]]
    square = {r["label_a"]: r for r in sheets["cooccurrence"].collect()}
    assert square["staff"]["staff"] == 1 and square["staff"]["money"] == 0
    cells_ = files.workbook_cells(sinks.workbook(sheets))
    assert any(c[0] == "groups" and c[3] == "(no group)" for c in cells_)
    assert [r["ord"] for r in reports.chart_rows(a, "expressions", "money").collect()] == [1, 2]
    assert reports.chart_scale(reports.chart_rows(a, "codes")).first()["most"] == 1.0 and "codes" in sinks.available_charts(a.blocks())
    with pytest.raises(ValueError):
        reports.chart_rows(a, "pie")


def test_cube(spark, tmp_path, monkeypatch):
    from loomcode.operators import analysis

    cells, codes, exprs = survey(spark)
    found = runs.dictionary_codings(cells, codes, exprs)
    a = Analysis(runs.segments(cells, found), found, cells.select("doc_id", "lang", F.lit("g").alias("grp")), codes)
    root = str(tmp_path)
    assert analysis.read_cube(spark, 4, root) is None
    analysis.write_cube(a, 4, root)
    back = analysis.read_cube(spark, 4, root)
    assert set(back) == set(a.blocks()) and back["codes"].count() == 3
    monkeypatch.setattr(analysis, "SCHEMA_VERSION", 99)
    assert analysis.read_cube(spark, 4, root) is None


UNITS = "doc_id long, text string, source_type string, lang string, convention string, roles map<string,string>"


def test_units(spark):
    talk = "Header\nI: How are you? Well?\nE: Fine. Very fine.\nand more. Yes.\nX: stray"
    docs = spark.createDataFrame(
        [
            (1, talk, "docx", "en", "plain", {"I": "interviewer", "e.": "participant"}), (2, "One. Two.\n\n Three. ", "docx", None, None, None), (3, None, "excel", "en", None, None),
            (4, "", "docx", "en", None, None), (5, "A [00:00:01]: x y", "docx", "en", "gone", {}),
        ], UNITS,
    )
    cells = spark.createDataFrame([(3, 5, "Late. Very late."), (3, 2, " one "), (3, 4, "  ")], "doc_id long, row_no int, text string")
    ws = units.Workspace(excluded_roles=("interviewer",))

    def got(unit, context=0, **more):
        found, failed = units.units_for(docs, unit, units.Workspace(**({"excluded_roles": ("interviewer",)} | more)), cells, context)
        by = {}
        for r in found.orderBy("doc_id", "position").collect():
            by.setdefault(r["doc_id"], []).append(r)
        assert all([r["position"] for r in x] == list(range(len(x))) for x in by.values())
        return by, {r["doc_id"]: r["reason"] for r in failed.collect()}

    by, failed = got("sentence")
    assert [(r["text"], r["speaker"], r["excluded"]) for r in by[1]] == [("Header", None, True), ("How are you? Well?", "I", True), ("Fine.", "E", False), ("Very fine.", "E", False), ("and more.", "E", False), ("Yes.", "E", False), ("X: stray", "E", False)]
    assert [r["text"] for r in by[3]] == ["one", "Late.", "Very late."] and [r["row_no"] for r in by[3]] == [2, 5, 5]
    assert by[3][0]["context"] is None and by[3][1]["context"][0]["text"] == "Late. Very late."
    assert failed == {2: "no language", 4: "no units"}
    by, failed = got("sentence", language="de")
    assert [r["text"] for r in by[2]] == ["One.", "Two.", "Three."] and failed == {4: "no units"}
    by, _ = got("paragraph", 2)
    assert [r["text"] for r in by[1]][2:4] == ["Fine. Very fine.", "and more. Yes."] and by[2][1]["speaker"] is None
    assert [len(r["context"]) for r in by[1]] == [0, 1, 2, 2, 2] and by[3][0]["context"] is None
    by, _ = got("per_row")
    assert [len(by[d]) for d in (1, 2)] == [1, 1] and by[2][0]["text"] == "One. Two.\n\n Three."
    by, _ = got("utterance_regex")
    assert by[5][0]["speaker"] == "A" and by[5][0]["ts"] == "00:00:01" and all(r["excluded"] for r in by[2])
    assert got("per_utterance", mode="utterance_regex")[0].keys() == by.keys()
    with pytest.raises(ValueError):
        units.units_for(docs, "word", ws)


def test_runs_stand_or_fall_by_document(spark, tmp_path):
    cells, codes, exprs = survey(spark)
    state = spark.createDataFrame([(9, d, "pending") for d in range(2, 7)] + [(8, 2, "completed")], "run_id long, doc_id long, status string")
    bad = spark.createDataFrame([(3, "no language")], "doc_id long, reason string")
    code = lambda u: runs.dictionary_codings(u, codes, exprs)
    after = runs.executed(9, cells, bad, state, code, str(tmp_path))
    rows = {(r["run_id"], r["doc_id"]): (r["status"], r["error"]) for r in after.collect()}
    assert rows[9, 3] == ("failed", "no language") and rows[9, 2] == ("completed", None) and rows[8, 2] == ("completed", None)
    assert runs.read_facts(spark, str(tmp_path), 9)[0].count() == 4
    again = runs.executed(9, cells, bad.where("false"), after.select("run_id", "doc_id", "status"), code, str(tmp_path))
    assert all(r["status"] == "completed" for r in again.collect())
    segments, found = runs.read_facts(spark, str(tmp_path), 9)
    assert segments.count() == 5 and found.count() == 3 and runs.read_facts(spark, str(tmp_path), 9, [3])[1].count() == 1


def test_coder_waits_and_gives_up(spark):
    u = segment.with_context(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc_id long, position int, text string"), 0)

    def coder(text, context, seen={}):  # noqa: B006
        seen[text] = seen.get(text, 0) + 1
        if text == "a" and seen[text] < 3 or text == "b":
            raise TimeoutError
        if text == "c":
            raise KeyError
        return "[]", 100, 7

    got = {r["position"]: r for r in runs.model_answers(u.coalesce(1), coder, retries=4, pause=0.01).collect()}
    assert got[0]["answer"] == "[]" and (got[0]["tokens_in"], got[0]["tokens_out"]) == (100, 7)
    assert got[1]["answer"] is None and got[2]["answer"] is None


def test_workspaces(spark):
    docs = spark.createDataFrame([(1, 5, "f", "en", "a", "plain", {"X": "other"}, "A: hi\nB: yes\nA: no\nB: so", "docx"), (2, 5, "f", None, None, None, None, "the and", "docx"), (3, 6, "g", "de", " ", None, None, "x", "excel")],
        "doc_id long, workspace_id long, file_path string, lang string, grp string, convention string, roles map<string,string>, text string, source_type string")
    new, n = workspace.grouped(docs, 5, [1, 3], "  ")
    assert n == 1 and new.where("doc_id = 1").first()["grp"] is None and new.where("doc_id = 3").first()["grp"] == " "
    one = workspace.described(docs, 1, convention="f4", lang="fr").where("doc_id = 1").first()
    assert one["roles"] == {"A": "participant", "B": "participant"} and one["lang"] == "fr" and one["convention"] == "f4"
    same = workspace.described(docs, 1, convention="plain").where("doc_id = 1").first()
    assert same["roles"] == {"X": "other"}
    gone = workspace.described(docs, 1, convention="", grp="").where("doc_id = 1").first()
    assert gone["roles"] is None and gone["convention"] is None and gone["grp"] is None
    for bad in ({"convention": "none"}, {"lang": "xx"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            workspace.described(docs, 1, **bad)
    with pytest.raises(ValueError):
        workspace.with_roles(docs, 1, {"A": "boss"})
    again = {r["doc_id"]: r for r in workspace.redetected(docs).collect()}
    assert again[2]["lang"] == "en" and again[1]["convention"] in ("plain", "f4") and again[2]["convention"] is None
    members = spark.createDataFrame([(5, 1)], "workspace_id long, user_id long")
    assert workspace.with_member(workspace.with_member(members, 5, 2), 5, 1).count() == 2 and workspace.without_member(members, 5, 1).count() == 0
    runs_ = spark.createDataFrame([(1, 5), (2, 6)], "run_id long, workspace_id long")
    tables = {"documents": docs, "members": members, "runs": runs_, "codings": spark.createDataFrame([(1, 1), (2, 3)], "run_id long, doc_id long")}
    left = workspace.without_workspace(tables, 5)
    assert left["documents"].count() == 1 and left["codings"].count() == 1 and left["members"].count() == 0 and left["runs"].count() == 1
    left, files_ = workspace.without_documents(tables, docs.where("doc_id = 1"))
    assert files_.count() == 0 and left["documents"].count() == 2
    left, files_ = workspace.without_documents(tables, docs.where("workspace_id = 5"))
    assert [r[0] for r in files_.collect()] == ["f"]
    assert [r["doc_id"] for r in workspace.sorted_by(docs, "grp").collect()] == [2, 3, 1]
    with pytest.raises(ValueError):
        workspace.checked_columns(["a"], ["b"])
    cells = spark.createDataFrame([("c", f"v{i}") for i in range(31)], "column string, text string")
    with pytest.raises(ValueError):
        workspace.group_values(cells, "c")
    assert workspace.group_values(cells.limit(3), "c") == ["v0", "v1", "v2"]


def test_library_of_conventions():
    mine = conventions.with_convention({}, " mine ", r"^(?P<speaker>\w+)>(?P<text>.*)$")
    assert [k for k, _ in conventions.candidates(mine)][-1] == "mine"
    for name, regex in (("plain", r"(?P<speaker>a)(?P<text>b)"), ("x", "(a)(b)"), (" ", r"(?P<speaker>a)(?P<text>b)")):
        with pytest.raises(ValueError):
            conventions.with_convention({}, name, regex)
    assert conventions.suggested(["A> x", ""], lambda sample, _: r"`^(?P<speaker>\w+)> (?P<text>.*)$`") and conventions.suggested(["A"], lambda *_: "(") is None


def test_model_coder(spark):
    answers = {
        "one": '```json\n[{"action": "create_new", "code": "New-Code", "rationale": "x"}]\n```',
        "two": '[{"action": "create_new", "code": "new code"}, {"action": "use_existing", "code": "STAFF"}]',
        "three": '[{"action": "no_code", "rationale": "r1"}, {"action": "no_code", "rationale": "r2"}]',
        "four": '{"action": "no_code"}',
    }
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(answers)], "doc_id long, position int, text string")
    got = runs.model_answers(segment.with_context(units, 2), lambda text, context: answers[text])
    named, failed, none = runs.model_entries(got)
    _, codes, _ = survey(spark)
    resolved, after = codebook.resolve(codes, named, 10)
    assert sorted((r["position"], r["code_id"]) for r in resolved.collect()) == [(0, 10), (1, 1), (1, 10)]
    assert after.where("code_id = 10").first()["label"] == "New-Code"
    assert [r["position"] for r in failed.collect()] == [3]
    assert none.where("position = 2").first()["no_code_rationale"] == "r1 | r2"
    status = {r["position"]: r["status"] for r in runs.segments(units, resolved, failed).collect()}
    assert status == {0: "coded", 1: "coded", 2: "no_code", 3: "error"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  x \n\n caf\xe9".encode("latin-1"))
    (tmp_path / "b.html").write_text("<title>t</title><p>A &amp; B<br>c</p><p>d</p>tail")
    (tmp_path / "old.doc").write_text("no")
    (tmp_path / "~$a.txt").write_text("lock")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tbl><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "bad.docx").write_text("broken")
    rows = {r["filename"]: r for r in files.read_transcripts(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "x\ncafé" and rows["b.html"]["text"] == "tA & B\nc\nd\ntail" and rows["c.docx"]["text"] == "one\ntwo"
    assert rows["bad.docx"]["error"] and set(rows) == {"a.txt", "b.html", "c.docx", "bad.docx"}
    table = spark.createDataFrame([("A", "x"), ("B", None), ("A", "z")], "arm string, feedback string")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "w.xlsx").write_bytes(sinks.workbook({"Sheet": table}))
    cells = files.read_workbooks(spark, str(tmp_path / "s"))
    assert [(r["row_no"], r["text"]) for r in files.column_cells(cells, "feedback", "arm", "A").orderBy("row_no").collect()] == [(2, "x"), (4, "z")]
    assert {(r["grp"], r["n"]) for r in files.group_documents(cells, ["feedback"], "arm").collect()} == {("A", 2)}
    assert files.profiled(cells).where("column = 'arm'").first()["samples"] == ["A", "B", "A"]
    with pytest.raises(ValueError):
        files.column_cells(cells, "none")
    c, e = codebook.parsed_rows(spark.createDataFrame([(1, " Fear ", "nan", "a; b;"), (2, "", None, None)], "ord int, CODE string, Description string, expressions_EN string"))
    assert c.first()["label"] == "Fear" and c.first()["description"] is None and c.count() == 1
    assert [(r["lang"], r["expression"]) for r in e.collect()] == [("en", "a"), ("en", "b")]


def test_exchange(spark, tmp_path):
    _, codes, _ = survey(spark)
    assert sinks.codebook_xml(codes).count(b"<Code ") + sinks.codebook_xml(codes).count(b":Code ") >= 4
    docs = spark.createDataFrame([(1, "d", "abc def"), (2, "e", " ")], "doc_id long, name string, text string")
    cods = spark.createDataFrame([(1, 1, 0, 3)], "doc_id long, code_id long, start_offset int, end_offset int")
    with zipfile.ZipFile(io.BytesIO(sinks.project_file(codes, docs, cods))) as z:
        assert len([n for n in z.namelist() if n.startswith("sources/")]) == 1 and b'endPosition="3"' in z.read("project.qde")
    rows = spark.createDataFrame([("a.txt", "/p/a", bytearray(b"x"), "en", None), ("b.txt", "/p/a", bytearray(b"x"), "en", "g")], "filename string, file_path string, content binary, language string, grp string")
    data = sinks.bundle(rows, "docx", {"m": "1"})
    (tmp_path / "b.zip").write_bytes(data)
    (tmp_path / "a.zip").write_bytes(sinks.bundle(rows.limit(1), "docx", {"m": "2", "n": "3", "own": "4"}))
    (tmp_path / "c.zip").write_bytes(sinks.bundle(rows, "excel", {"x": "1"}))
    (tmp_path / "d.zip").write_bytes(b"none")
    read, found, errors = sinks.read_bundles(spark, str(tmp_path / "*.zip"), "docx", {"own": "0"})
    assert sorted(r["filename"] for r in read.collect()) == ["a.txt", "a.txt", "b.txt"] and read.select("file_path").distinct().count() == 2
    assert {r["name"]: r["regex"] for r in found.collect()} == {"own": "0", "m": "2", "n": "3"}
    assert sorted(r["error"].split(":")[0] for r in errors.collect()) == ["BadZipFile", "ValueError"]
    back, merged = sinks.unbundled(data, "docx", {"m": "0"})
    assert len(back) == 2 and merged == {"m": "0"} and back[0]["key"] == back[1]["key"]
    with pytest.raises(ValueError):
        sinks.unbundled(data, "excel", {})


def test_project_of_run(spark):
    _, codes, _ = survey(spark)
    docs = spark.createDataFrame([(1, "d", "ab ab cd"), (2, "e", "x")], "doc_id long, name string, text string")
    coded = spark.createDataFrame([(1, 9, 1, 1, "ab", 5, 7), (2, 9, 1, 2, "cd", 0, 1), (3, 9, 2, 1, "x", 0, 1)], "coding_id long, run_id long, doc_id long, code_id long, segment_text string, start_offset int, end_offset int")
    state = spark.createDataFrame([(9, 1, "completed"), (9, 2, "failed")], "run_id long, doc_id long, status string")
    with zipfile.ZipFile(io.BytesIO(sinks.project_of_run(codes, docs, coded, state))) as z:
        made = z.read("project.qde")
        assert len(z.namelist()) == 2 and made.count(b"<PlainTextSelection") + made.count(b":PlainTextSelection ") >= 2
        assert b'startPosition="6"' in made and b'endPosition="8"' in made


def test_single_flight():
    import threading
    import time

    flight, made = runs.SingleFlight(), []

    def job():
        made.append(1)
        time.sleep(0.2)
        return len(made)

    got = []
    threads = [threading.Thread(target=lambda: got.append(flight.run("a", job))) for _ in range(5)]
    for t in threads:
        t.start()
    assert flight.active() == ["a"]
    for t in threads:
        t.join()
    assert got == [1] * 5 and flight.active() == [] and flight.run("a", job) == 2
    with pytest.raises(KeyError):
        flight.run("b", lambda: {}["x"])


def test_text(spark):
    row = spark.createDataFrame([(" A_b-c  D ", "  e. ", "1:02:03", "x" * 9)], "a string, b string, c string, d string").select(
        T.normalize_label(F.col("a")), T.normalize_speaker(F.col("b")), T.seconds(F.col("c")), T.estimated_tokens("d"), T.duration(F.lit(3700)), T.stem_name(F.lit("x.DOCX")), T.display_name(F.lit("f.xlsx"), F.lit("q"), F.lit("A"))
    ).first()
    assert tuple(row) == ("a b c d", "E", 3723, 2, "1 h 1 m", "x", "f.xlsx [q] (A)")
    assert runs.estimate_seconds("dictionary", 1000, 5) == 20 and runs.estimate_seconds("llm", 11, 5) == 12
    with pytest.raises(ValueError):
        runs.validated("llm", 21, 5, "document", ["document"])


def test_codebook_changes(spark):
    _, codes, exprs = survey(spark)
    assert codebook.new_codes(codes, spark.createDataFrame([(1, "STAFF", None, None), (2, "x-y", None, None), (3, "X Y", None, None)], "ord int, label string, description string, example string"), 9).collect()[0]["code_id"] == 9
    with pytest.raises(ValueError):
        codebook.renamed(codes, 1, "Money")
    with pytest.raises(ValueError):
        codebook.with_code(codes, "STAFF", 9)
    assert codebook.with_code(codes, " New ", 9).where("code_id = 9").first()["label"] == "New"
    after = codebook.with_expressions(exprs, 2, spark.createDataFrame([(1, "en", "A"), (2, "en", "a"), (3, "en", " ")], "ord int, lang string, expression string"), 50)
    assert [r["expression"] for r in after.where("code_id = 2").collect()] == ["A"]
    assert codebook.active(codebook.soft_deleted(codes, 1)).count() == 3
    langs = spark.createDataFrame([("en",), ("fr",)], "lang string")
    assert {r["lang"]: r["n_codes"] for r in codebook.uncovered(codes, exprs, langs).collect()} == {"en": 1, "fr": 4}


def test_stream(spark, tmp_path):
    from loomcode.streaming.ingest import coded_stream, ingested

    cells, codes, exprs = survey(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        rows.select("doc_id", "text", "lang").coalesce(1).write.mode("append").parquet(folder)
        coded_stream(spark, folder, codes, exprs, out, str(tmp_path / "ck")).awaitTermination()
        segments, found = ingested(spark, out)
        return {r["doc_id"]: r["text"] for r in segments.collect()}, sorted((r["doc_id"], r["code_id"]) for r in found.collect())

    texts, found = arrive(cells.unionByName(cells.where("doc_id = 2")))  # one of them twice in a batch
    assert len(texts) == 5 and found == [(2, 1), (3, 2), (5, 4)]
    # One comes again as it was, one with another text, one is new, and one has nothing to say any more.
    more = cells.where("doc_id = 2").unionByName(cells.where("doc_id = 3").withColumn("text", F.lit("great staff"))).unionByName(cells.where("doc_id = 5").withColumn("text", F.lit(" ")))
    texts, found = arrive(more.unionByName(cells.where("doc_id = 2").withColumn("doc_id", F.lit(9).cast("long"))))
    assert set(texts) == {2, 3, 4, 6, 9} and texts[3] == "great staff" and found == [(2, 1), (3, 1), (9, 1)]
    assert spark.read.parquet(f"{out}/documents").where("doc_id = 2").count() == 1
    texts, found = arrive(cells.where("doc_id = 3"))
    assert found == [(2, 1), (3, 2), (9, 1)]
    assert ingested(spark, out, 7)[0].count() == 0


def test_languages_by_trigrams(spark):
    """Held-out documents: their language, or none where the engine has no model for it."""
    from loomcode.operators import language

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fitted(d.where("doc_id % 2 = 0").unionByName(d.limit(5).withColumn("lang", F.lit(None).cast("string"))))
    assert model.languages == ("de", "en", "es", "fr")
    rows = d.where("doc_id % 2 = 1 and length(text) >= 100").withColumn("found", language.detected(F.col("text"), model)).collect()
    right = sum(r["found"] == (r["lang"] if r["lang"] != "es" else None) for r in rows)
    assert len(rows) > 400 and right / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "the " * 4000)], "i int, text string")
    assert [r["x"] for r in odd.select(language.detected(F.col("text"), model).alias("x")).collect()] == [None, None, None, "en"]
    assert language.fitted(d.where("false")).of("text") is None


def test_language_votes_on_the_whole_text(spark):
    late = "xx " * 2000 + "der die das und"
    turned = "the " * 1250 + "und " * 1300
    df = spark.createDataFrame([(0, late), (1, turned), (2, "xx"), (3, None)], "id int, text string")
    got = df.select("id", T.detect_language(F.col("text")).alias("all"), T.detect_language(F.col("text"), 5000).alias("first")).orderBy("id").collect()
    assert [r["all"] for r in got] == ["de", "de", None, None]
    assert [r["first"] for r in got] == [None, "en", None, None]
