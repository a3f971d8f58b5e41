"""Runs that stand or fall by document, coders that are asked once, and a codebook that grows while a run goes on."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomcode.operators import codebook, dictionary, facts, runs, segment
from loomcode.operators.numbering import numbered

UNIT = "doc_id long, position int, text string, excluded boolean"


def book(spark, *labels):
    return spark.createDataFrame([(i, x, None, None, False, None) for i, x in enumerate(labels, 1)], codebook.CODES)


def run_of(spark, ids, status="pending"):
    return spark.createDataFrame([(1, d, status) for d in ids], "run_id long, doc_id long, status string")


def no_reason(spark):
    return spark.createDataFrame([], "doc_id long, reason string")


def asker(folder):
    """A coder that leaves a file for each call, and says what its unit's text is; and what it has been asked."""

    def ask(system, message):
        import os
        import uuid

        text = message.split("To be coded:\n")[1]
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(text)
        if text == "raises":
            raise KeyError("answered with an error")
        if text == "fatal":
            raise OSError("the service has gone")
        return text

    return ask, lambda: sorted(x.read_text() for x in Path(folder).iterdir())


def test_a_document_fails_alone_and_a_retry_codes_the_rest(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    root, one = str(tmp_path / "facts"), '[{"code": " New-Code ", "description": " d "}, {"action": "no_code", "rationale": " "}, {"code": "  "}]'
    two = '```json\n[{"action": "create_new", "code": "new code"}, {"action": "use_existing", "code": "STAFF"}, {"action": "no_code", "rationale": " r "}]\n```'
    rows = [(1, 0, one, False), (1, 1, "secret", True), (2, 0, two, False), (2, 1, "fatal", False), (3, 0, two, False), (3, 1, "raises", False), (3, 2, "no json", None), (4, 0, "{\"a\": 1}", False), (4, 1, "[]", False), (5, 0, "[]", False)]
    units = spark.createDataFrame(rows, UNIT).repartition(3)
    bad = spark.createDataFrame([(5, "no language")], "doc_id long, reason string")
    ask, asked = asker(str(calls))
    coder = facts.ModelCoder(ask, study=(None, " ", "a study"), pause=0.01, fails=(OSError,))
    codes = book(spark, "staff")
    after, grown = facts.execute(1, units, bad, run_of(spark, range(1, 6)), coder, root, codes)
    state = {r["doc_id"]: (r["status"], r["error"]) for r in after.collect()}
    assert state[1] == state[3] == ("completed", None) and state[5] == ("failed", "no language")
    assert state[2] == ("failed", "OSError: the service has gone") and state[4][0] == "failed" and state[4][1].startswith("malformed answer")
    assert asked() == sorted(t for d, _, t, x in rows if not x and d != 5)  # each unit once, and no excluded one
    segments, codings = facts.read_facts(spark, root, 1)
    got = {(r["doc_id"], r["position"]): (r["status"], r["n_codings"], r["no_code_rationale"]) for r in segments.collect()}
    assert got == {(1, 0): ("coded", 1, None), (1, 1): ("excluded", 0, None), (3, 0): ("coded", 2, "r"), (3, 1): ("error", 0, None), (3, 2): ("error", 0, None)}
    labels = {r["code_id"]: r["label"] for r in grown.collect()}
    assert sorted((r["doc_id"], labels[r["code_id"]]) for r in codings.collect()) == [(1, "New-Code"), (3, "New-Code"), (3, "staff")] and len(labels) == 2
    assert grown.where("label = 'New-Code'").first()["description"] == "d"

    mended = units.withColumn("text", F.when(F.col("text").isin("fatal", '{"a": 1}'), "[]").otherwise(F.col("text")))
    again, _ = facts.execute(1, mended, bad, after.select("run_id", "doc_id", "status"), coder, root, grown)
    assert {r["doc_id"]: r["status"] for r in again.collect()} == {1: "completed", 2: "completed", 3: "completed", 4: "completed", 5: "failed"}
    assert len(asked()) == 8 + 4  # documents 2 and 4 only
    segments, codings = facts.read_facts(spark, root, 1)
    assert segments.count() == 9 and segments.groupBy("doc_id", "position").count().where("count > 1").isEmpty() and codings.where("doc_id = 2").count() == 2
    assert facts.read_facts(spark, root, 1, [2, 9])[0].count() == 2 and facts.read_facts(spark, root, 1, [])[0].count() == 0
    assert not [f for f in facts.read_units(spark, root, 1, [2]).inputFiles() if "attempt=3" in f]


def test_what_is_not_committed_is_not_there(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    units = spark.createDataFrame([(1, 0, '[{"code": "a"}]', False)], UNIT)
    coder = facts.ModelCoder(lambda system, message: message.split("\n")[1])

    def crash(*_):
        raise RuntimeError("the driver has gone")

    with monkeypatch.context() as m:
        m.setattr(facts, "_commit", crash)
        with pytest.raises(RuntimeError):
            facts.execute(1, units, no_reason(spark), run_of(spark, [1]), coder, root, book(spark, "a"))
    with pytest.raises(ValueError):
        facts.read_facts(spark, root, 1)
    facts.execute(1, units, no_reason(spark), run_of(spark, [1]), coder, root, book(spark, "a"))
    assert facts.read_facts(spark, root, 1)[1].count() == 1
    # A run anew replaces what it has said before, and a run without documents to do changes nothing.
    facts.execute(1, units.withColumn("text", F.lit("[]")), no_reason(spark), run_of(spark, [1], "completed"), coder, root, book(spark, "a"), anew=True)
    assert facts.read_facts(spark, root, 1)[1].count() == 0
    done, _ = facts.execute(1, units, no_reason(spark), run_of(spark, [1], "completed"), coder, root, book(spark, "a"))
    assert done.first()["status"] == "completed" and facts.read_facts(spark, root, 1)[0].count() == 1
    # Documents that all fail write no facts, and their states.
    seen, other = facts.Progress(), str(tmp_path / "other")
    bad = spark.createDataFrame([(1, "no units")], "doc_id long, reason string")
    done, _ = facts.execute(1, units, bad, run_of(spark, [1]), coder, other, book(spark, "a"), progress=seen)
    assert done.first()["error"] == "no units" and seen.counts()["n_units"] == 0 and facts.read_facts(spark, other, 1)[0].count() == 0


def test_codes_proposed_in_a_batch_stand_in_the_next_prompts(spark, tmp_path):
    units = spark.createDataFrame([(d, p, f"{d} {p}", False) for d in range(7) for p in range(2)], UNIT)

    def propose(system, message):
        """Names how many codes the prompt has; each unit of a batch proposes the same new one, and its own."""
        n = system.count("\n- ")
        return json.dumps([{"action": "create_new", "code": f"seen {n}"}, {"code": "only " + message.split("\n")[1].split()[0]}])

    def sequential(size):
        """The label map of a run by batches of documents, as a plain loop."""
        known, said = ["first"], []
        for at in range(0, 7, size):
            n, new = len(known), []
            for d in range(at, min(at + size, 7)):
                for p in range(2):
                    for label in (f"seen {n}", f"only {d}"):
                        said.append((d, p, label))
                        new += [label] if label not in known + new else []
            known += new
        return known, sorted(said)

    for size in (1, 3, 7):
        root = str(tmp_path / str(size))
        _, codes = facts.execute(1, units, no_reason(spark), run_of(spark, range(7)), facts.ModelCoder(propose), root, book(spark, "first"), batch=size)
        known, said = sequential(size)
        rows = codes.orderBy("code_id").collect()
        assert [r["label"] for r in rows] == known and [r["code_id"] for r in rows] == list(range(1, len(known) + 1))
        labels = {r["code_id"]: r["label"] for r in rows}
        assert sorted((r["doc_id"], r["position"], labels[r["code_id"]]) for r in facts.read_facts(spark, root, 1)[1].collect()) == said


def test_prompts(spark):
    seen = []
    units = segment.with_context(spark.createDataFrame([(1, 0, " one ", "A"), (1, 1, "two", None)], "doc_id long, position int, text string, speaker string"), 1)
    codes = spark.createDataFrame([(1, "b", "about b", None, False, None), (2, "a", None, None, False, None), (3, "gone", None, None, True, None)], codebook.CODES)

    def ask(system, message):
        return json.dumps([{"code": system}, {"code": message}])

    rows = facts.ModelCoder(ask, study=("", None, " The study. ")).outcomes(units, codes).orderBy("position").collect()
    for r in rows:
        seen.append([c["label"] for c in r["codings"]])
        assert r["tokens_in"] == (len(seen[-1][0]) + len(facts.user_message(r["text"], "A:  one " if r["position"] else ""))) // 4
    assert seen[0][0] == "Study: The study.\n\nCodebook:\n- a\n- b: about b"
    assert seen[0][1] == "To be coded:\none" and seen[1][1] == "Before it, not to be coded:\nA:  one \n\nTo be coded:\ntwo"
    assert facts.system_block(facts.format_codebook(None), "") == "Study: (not described)\n\nCodebook:\n(no codes yet: propose some)"


@pytest.mark.parametrize(("answer", "labels", "why", "failed"), [
    (None, None, None, False), ("", None, None, False), ("null", None, None, False), ("[1", None, None, False), ("[]", [], None, False), ("{}", [], None, False), ('""', [], None, False), ("0", [], None, False),
    ("[1]", [], None, True), ('{"a": 1}', [], None, True), ('"x"', [], None, True), ("7", [], None, True), ('[{"code": 5}]', [], None, True),
    ('x ```json\n[{"code": "a"}]\n``` y', ["a"], None, False), ('[{"action": "no_code", "rationale": "p"}, {"action": "no_code"}, {"action": "no_code", "rationale": "q", "code": "z"}]', [], "p | q", False),
    ('[{"action": null, "code": "a"}, {"code": " a "}]', ["a", "a"], None, False),
])
def test_answers(answer, labels, why, failed):
    entries, reason, error = facts.parsed_entries(answer)
    assert (None if entries is None else [e["label"] for e in entries]) == labels and reason == why and (error is not None) == failed


def test_entries_without_an_action_are_kept(spark):
    rows = spark.createDataFrame([(1, 0, '[{"code": " x "}, {"code": "  "}, {"action": "no_code", "code": "y", "rationale": "  "}]')], "doc_id long, position int, answer string")
    named, failed, why = runs.model_entries(rows)
    assert [r["label"] for r in named.collect()] == ["x"] and failed.isEmpty() and why.first()["no_code_rationale"] is None


def sentences_of(spark, n=400):
    rng = random.Random(7)
    vocabulary = ["the", "of", "in", "a", "to"] + [f"w{i}" for i in range(60)]
    rows = [(d, 0, ". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 4))), ["en", "de", None][d % 3]) for d in range(n)]
    return spark.createDataFrame(rows, "doc_id long, position int, text string, lang string").repartition(3), vocabulary


def test_large_codebooks_match_as_small_ones(spark):
    units, vocabulary = sentences_of(spark)
    rng = random.Random(8)
    exprs = []
    for i in range(1, 400):
        words = " ".join(rng.choices(vocabulary if i % 2 else vocabulary[5:], k=rng.randint(1, 3)))
        exprs.append((i, i % 40 + 1, ["en", "de"][i % 2 if i % 5 else 0], f'"{words}"' if i % 2 else words))
    exprs += [(1000, 1, "en", '"of the"'), (1001, 1, "en", "nowhere w1"), (1002, 2, "en", "the of")]
    e = spark.createDataFrame(exprs, codebook.EXPRESSIONS)
    codes = book(spark, *(f"c{i}" for i in range(40)))
    index = dictionary.build_index(codes, e)
    key = ["doc_id", "position", "sent", "expr_id"]
    small = sorted(tuple(r[k] for k in key) for r in dictionary.match_sentences(units, index).collect())
    assert len(small) > 200
    rows = dictionary.unit_sentences(units)
    for broadcast in (10_000, 0):
        assert sorted(tuple(r[k] for k in key) for r in dictionary._match_inverted(rows, index, broadcast).collect()) == small
    more = index.unionByName(spark.range(49_600).select((F.col("id") + 5000).alias("expr_id"), F.lit(3).cast("long").alias("code_id"), F.lit("en").alias("lang"), F.concat(F.lit('"the '), F.hex("id"), F.lit('zz"')).alias("expression"), F.lit(True).alias("phrase"), F.array(F.lit("the"), F.concat(F.lower(F.hex("id")), F.lit("zz"))).alias("lemmas")))
    assert sorted(tuple(r[k] for k in key) for r in dictionary.match_sentences(units, more).collect()) == small
    # A phrase with a stop word is posted under its other lemma.
    keys = {r["expr_id"]: r["key"] for r in dictionary.key_lemmas(rows, index).where("phrase and size(array_distinct(lemmas)) > 1").collect()}
    assert 1000 in keys and not [k for i, k in keys.items() if k == "the" and i != 1000 and any(w.startswith("w") for w in dict((x[0], x[3]) for x in exprs)[i].strip('"').split())]


def test_codings_in_a_unit_s_row(spark):
    units, vocabulary = sentences_of(spark, 150)
    units = units.withColumn("excluded", F.col("doc_id") % 10 == 9)
    e = spark.createDataFrame([(i, i % 7 + 1, "en" if i % 3 else "de", f'"{w} {v}"' if i % 4 == 0 else w) for i, (w, v) in enumerate(zip(vocabulary, vocabulary[1:], strict=False))], codebook.EXPRESSIONS)
    index = dictionary.build_index(book(spark, *(f"c{i}" for i in range(7))), e)
    names = ["code_id", "score", "matched_expressions", "sentences", "rationale"]
    plain = dictionary.codings(dictionary.match_sentences(units.where("not excluded"), index)).collect()
    rows = dictionary.coded_units(units, index)
    assert rows.count() == 150
    assert sorted((r["doc_id"], *(str(c[k]) for k in names)) for r in rows.collect() for c in r["codings"]) == sorted((r["doc_id"], *(str(r[k]) for k in names)) for r in plain) != []


def test_numbers_over_ranges(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.randint(0, 5), f"x{i}") for i in range(500)] + [("hot", 1, f"y{i}") for i in range(900)]
    rows = spark.createDataFrame(data, "k string, v int, name string").repartition(5)
    out = numbered(rows, "at", [F.desc("v"), F.col("name")], ("k",), {"total": "v"})
    assert "Window" in out._jdf.queryExecution().toString()
    got = {r["name"]: (r["at"], r["total"]) for r in out.collect()}
    for k in ("a", "b", None, "hot"):
        own = sorted((r for r in data if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(i, sum(x[1] for x in own)) for i in range(len(own))]
    assert sorted(r["at"] for r in numbered(rows, "at", [F.col("name")]).collect()) == list(range(1400))
    assert numbered(rows.where("false"), "at", [F.col("name")]).count() == 0


def plain_spans(full, units, repeats):
    """The places of texts one after the other; units: (text, stored start, stored end)."""
    at, last, out = 0, None, []
    for text, s, e in units:
        if repeats and last is not None and last[0] == text:
            out.append(last[1])
            continue
        i = full.find(text, at)
        i = full.find(text) if i < 0 else i
        if i >= 0:
            span, at = (i, i + len(text)), i + len(text)
        else:
            span = ((s, e) if s is not None else (0, len(full))) if repeats else (0, len(text))
        last = (text, span)
        out.append(span)
    return out


def test_spans_forward_backward_and_absent(spark):
    rng, docs, rows = random.Random(1), [], []
    for d in range(40):
        full = " ".join(rng.choice(["ab", "cd", "é😀", "x", "yy z", "q"]) for _ in range(rng.randint(1, 300)))
        docs.append((d, full))
        for i in range(rng.randint(1, 200)):
            a = rng.randrange(len(full))
            text = full[a : a + rng.randint(1, 12)] if rng.random() < 0.7 else f"zz{i}"
            text = rows[-1][2] if rows and rows[-1][0] == d and rng.random() < 0.2 else text
            rows.append((d, i, text, *((3, 9) if i % 3 else (None, None))))
    t = spark.createDataFrame(docs, "doc_id long, text string")
    c = spark.createDataFrame(rows, "doc_id long, ord int, text string, start_offset int, end_offset int").repartition(3)
    for repeats in (False, True):
        found = segment.reanchored(t, c) if repeats else segment.anchored(t, c.select("doc_id", F.col("ord").alias("position"), "text")).withColumnRenamed("position", "ord")
        assert "Python" not in found._jdf.queryExecution().toString()
        got = {(r["doc_id"], r["ord"]): (r["start_offset"], r["end_offset"]) for r in found.collect()}
        assert len(got) == len(rows)
        for d, full in docs:
            want = plain_spans(full, [r[2:] for r in rows if r[0] == d], repeats)
            assert [got[d, i] for i in range(len(want))] == want


def test_strip_is_as_the_pattern_on_every_character(spark):
    """Trimmed characters are those of the pattern that defines white space."""
    from pyspark.sql import functions as F

    from loomcode.functions import text as T

    rows = spark.range(0x10000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    x = F.concat(F.lit("\n"), "c", F.lit(" a"), "c", F.lit("b."), "c", F.lit("\t"))
    differ = rows.where(~T.strip(x).eqNullSafe(F.regexp_replace(x, rf"(?U)^{T.SPACE}+|{T.SPACE}+$", "")))
    assert [r["id"] for r in differ.collect()] == []
    assert "regexp_replace" not in str(T.strip(F.col("c")))


def test_sentences_without_a_lemma_are_not_cut_to_tokens(spark):
    """Texts that have an expression's lemma as a part of a word alone, or at the edges of words of all kinds, hit as a plain look at the tokens says."""
    import re

    from loomcode.operators import dictionary

    words = ["thst", "athst", "thst-", "x thst", "THST.", "thst'", "of the", "of, the", "ofthe", "co-op", "Co-Op!", "co", "é thst", "éthst", "thst b", "", "thst. eron", "thst eron"]
    docs = spark.createDataFrame([(i, 0, w, "en") for i, w in enumerate(words)], "doc_id long, position int, text string, lang string")
    index = spark.createDataFrame(
        [(1, 1, "en", "thst", False, ["thst"]), (2, 1, "en", '"of the"', True, ["of", "the"]), (3, 2, "en", "co-op", False, ["co-op"]), (4, 2, "en", "thst eron", False, ["thst", "eron"])],
        "expr_id long, code_id long, lang string, expression string, phrase boolean, lemmas array<string>",
    )
    want = set()
    for i, w in enumerate(words):
        for s in re.split(r"(?<=[.!?])\s+", w):
            seq = re.findall(r"[\w'-]+", s.lower())
            want |= {(i, 1)} if "thst" in seq else set()
            want |= {(i, 2)} if any(seq[k : k + 2] == ["of", "the"] for k in range(len(seq))) else set()
            want |= {(i, 3)} if "co-op" in seq else set()
            want |= {(i, 4)} if {"thst", "eron"} <= set(seq) else set()
    assert {(r["doc_id"], r["expr_id"]) for r in dictionary.match_sentences(docs, index).collect()} == want
    coded = dictionary.coded_units(docs, index).selectExpr("doc_id", "explode(codings) c").selectExpr("doc_id", "c.code_id", "c.score").collect()
    code = {1: 1, 2: 1, 3: 2, 4: 2}
    assert {(r["doc_id"], r["code_id"]): r["score"] for r in coded} == {(i, c): sum(1 for d, e in want if d == i and code[e] == c) for i, c in {(d, code[e]) for d, e in want}}
    plan = dictionary.match_sentences(docs, index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "thst" in plan  # texts are looked at before they are cut


def test_counts_of_lemmas_rank_nothing(spark):
    """lemma_counts gives the counts of the ranked cells, without their range exchange."""
    from loomcode.plans import catalog

    a = catalog.analysis(spark, "/root/testdata/sf0.001")
    for level, block in enumerate((a.lemmas(), a.lemmas_by_code(), a.lemmas_by_code_group())):
        counts = a.lemma_counts(level)
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, block.select(counts.columns).collect()))
        assert "rangepartitioning" not in counts._jdf.queryExecution().executedPlan().toString().lower()


def test_readers_of_numbers_count_nothing_again(spark):
    """The counts that numbers are made of are a table."""
    from pyspark.sql import functions as F

    from loomcode.operators.numbering import numbered

    out = numbered(spark.range(100).withColumn("k", F.col("id") % 3), "n", [F.col("id")], ("k",), {"total": "id"})
    assert sorted(tuple(r) for r in out.select("id", "k", "total", "n").collect()) == [(i, i % 3, sum(range(i % 3, 100, 3)), i // 3) for i in range(100)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_lemmas_that_no_expression_has_are_not_counted(spark):
    """Lemmas meet the index's before they are counted."""
    from loomcode.operators import dictionary

    units = spark.createDataFrame([(1, 0, "one two three. two four", "en")], "doc_id long, position int, text string, lang string")
    index = spark.createDataFrame([(1, 1, "en", "two four", False, ["two", "four"])], "expr_id long, code_id long, lang string, expression string, phrase boolean, lemmas array<string>")
    rows = dictionary.unit_sentences(units)
    keyed = dictionary.key_lemmas(rows, index)
    assert [r["key"] for r in keyed.collect()] == ["four"]
    assert "LeftSemi" in keyed._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:3] for r in dictionary._match_inverted(rows, index).collect()] == [(1, 0, 1)]
