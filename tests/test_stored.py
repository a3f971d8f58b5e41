"""Relations on disk, JSON columns, and progress while a run goes on."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomcode import store
from loomcode.operators import codebook, facts, persisted, workspace
from loomcode.sources import stored


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_change_rewrites_its_workspace_alone(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.createDataFrame([(i, i % 3, f"f{i % 2}", None, "en") for i in range(12)], "doc_id long, workspace_id long, file_path string, grp string, lang string")
    codes = spark.createDataFrame([(i, i % 2, f"c{i}", None, None, False, None) for i in range(4)], "code_id long, workspace_id long, label string, description string, example string, is_deleted boolean, proposed_in_run_id long")
    spaces = spark.createDataFrame([(i,) for i in range(3)], "workspace_id long").withColumn("name", F.lit("w"))
    persisted.create(root, {"documents": docs, "codes": codes, "workspaces": spaces})
    before = files(root)
    persisted.changed(spark, root, 1, lambda r: {"documents": workspace.grouped(r["documents"], 1, [1, 2, 4], "north")[0]}, ["documents", "codes"])
    after = files(root)
    assert {k for k in before if k not in after} == {k for k in before if "/documents/workspace_id=1/" in k} and all(after[k] == v for k, v in before.items() if k in after)
    assert {r["doc_id"]: r["grp"] for r in persisted.opened(spark, root, "documents").collect()} == {i: "north" if i in (1, 4) else None for i in range(12)}
    read = persisted.opened(spark, root, "documents", 2).select("_metadata.file_path").distinct().collect()
    assert read and all("workspace_id=2" in r[0] for r in read)

    def without_three(r):
        return workspace.without_documents({"documents": r["documents"]}, r["documents"].where("doc_id in (2, 5, 8, 11)"))[0]

    persisted.changed(spark, root, 2, without_three, ["documents"])
    assert persisted.opened(spark, root, "documents").count() == 8 and not os.path.exists(f"{root}/documents/workspace_id=2")

    def copy(r):
        # Ids follow the largest ones of all workspaces, which only the reader of all rows knows.
        top = persisted.opened(spark, root, "documents").agg(F.max("doc_id")).first()[0]
        mine = r["documents"]
        return {"documents": mine.unionByName(mine.withColumn("doc_id", F.col("doc_id") + top + 1).withColumn("workspace_id", F.lit(7).cast("long")))}

    held = files(f"{root}/documents/workspace_id=0")
    persisted.changed(spark, root, 1, copy, ["documents"])
    assert persisted.opened(spark, root, "documents", 7).count() == 4 and files(f"{root}/documents/workspace_id=0") == held
    persisted.changed(spark, root, 1, lambda r: r, ["documents", "codes"])  # nothing changes
    assert persisted.opened(spark, root, "codes").count() == 4


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Session:
        def __init__(self, master, **conf):
            self.held = conf
            self.conf = self.sparkContext = self
            self.master = master

        def get(self, key, default=None):
            return self.held.get(key, default)

        def set(self, key, value):
            self.held[key] = value

    for folder in ("file:/x", "/x", "x"):
        with pytest.raises(ValueError):
            store.shared_dir(Session("spark://host:1", **{"spark.sql.warehouse.dir": folder}))
    assert store.shared_dir(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs://n/w/"})).startswith("hdfs://n/w/loomcode-")
    assert store.shared_dir(Session("yarn", **{"spark.checkpoint.dir": "file:/shared/"})) == "file:/shared"
    assert store.shared_dir(Session("local[4]", **{"spark.sql.warehouse.dir": "file:/x"})).startswith("file:/x/loomcode-")


def test_json_columns(spark):
    rows = [(1, '{"A": "other"}', '["a", "b"]'), (2, "{}", "[]"), (3, None, " "), (4, "[1]", '{"a": 1}'), (5, '{"A": ', "x"), (6, '{"A": {"b": 1}}', '["a", [1]]'), (7, '{"B": "x"} trailing', '[""]')]
    t = spark.createDataFrame(rows, "doc_id long, roles string, matched_expressions string")
    good, bad = stored.read_json(t, "roles", keys=("doc_id",))
    assert {r["doc_id"]: r["roles"] for r in good.collect()}[1] == {"A": "other"} and good.count() == 7
    assert good.where("roles is not null").count() + bad.count() == 6 and {4, 5} <= {r["doc_id"] for r in bad.collect()}
    good, bad = stored.read_json(good, "matched_expressions", keys=("doc_id",))
    assert {r["doc_id"]: r["matched_expressions"] for r in good.collect() if r["matched_expressions"] is not None and r["doc_id"] in (1, 2, 7)} == {1: ["a", "b"], 2: [], 7: [""]}
    assert {4, 5} <= {r["doc_id"] for r in bad.collect()} and {r["text"] for r in bad.where("doc_id = 5").collect()} == {"x"}
    again, none = stored.read_json(stored.as_json(good.where("doc_id < 3"), "roles"), "roles")
    assert [r["roles"] for r in again.orderBy("doc_id").collect()] == [{"A": "other"}, {}] and none.isEmpty()
    codes = spark.createDataFrame([(1, "a", "d", None, False, None)], codebook.CODES)
    exprs = spark.createDataFrame([(1, 1, "en", '"x y"')], codebook.EXPRESSIONS)
    kept, none = stored.read_json(workspace.snapshot(codes, exprs), "codebook")
    assert kept.first()["codebook"][0]["expressions"][0]["expression"] == '"x y"' and none.isEmpty()


def test_progress_is_seen_before_a_run_ends(spark, tmp_path):
    units = spark.createDataFrame([(d, p, "x", p == 2) for d in range(4) for p in range(3)], "doc_id long, position int, text string, excluded boolean")
    go = str(tmp_path / "go")

    def ask(system, message):
        import os
        import time

        while "- first" in system and not os.path.exists(go):  # from the second batch on, the codebook has a code
            time.sleep(0.05)
        return '[{"code": "first"}]'

    seen, done = facts.Progress(), []
    state = spark.createDataFrame([(1, d, "pending") for d in range(4)], "run_id long, doc_id long, status string")
    none = spark.createDataFrame([], "doc_id long, reason string")
    codes = spark.createDataFrame([], codebook.CODES)
    work = threading.Thread(target=lambda: done.append(facts.execute(1, units, none, state, facts.ModelCoder(ask), str(tmp_path / "facts"), codes, batch=2, progress=seen)))
    work.start()
    until = time.time() + 120
    while not seen.counts()["n_batches"] and time.time() < until:
        time.sleep(0.05)
    assert seen.counts() == {"n_batches": 1, "n_units": 6, "n_excluded": 2, "n_coded": 4, "n_error": 0} and not seen.ended
    open(go, "w").close()
    work.join(120)
    assert seen.ended and seen.counts()["n_units"] == 12 and done[0][0].where("status = 'completed'").count() == 4
