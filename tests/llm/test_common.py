from types import SimpleNamespace

import pytest

from tidemark.llm import _common
from tidemark.llm.components import components


def test_the_sessions_folder_is_used(spark):
    assert _common.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,512]", "spark://host:7077"])
def test_a_cluster_must_name_its_folder(master):
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.scratch_root(bare)


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)]
    star = [(100, i) for i in range(101, 160)]
    edges = [*chain, *star, (5, 5), (5, 4), (None, 3), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(df.limit(0)).count() == 0


def test_append_columns_replaces_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 9), (2, None, 9)], "id long, text string, n int")
    found = _common.append_columns(rows, ["text"], lambda t: {"n": [len(x or "") for x in t]}, "n long")
    assert found.columns == ["id", "text", "n"] and sorted(map(tuple, found.collect())) == [(1, "a", 1), (2, None, 0)]


def test_append_columns_takes_inputs_with_names_of_its_own(spark):
    rows = spark.createDataFrame([("a", "b", "c")], "text string, _in_text string, _in_0 string")
    found = _common.append_columns(rows, ["text"], lambda t: {"text": [x + "!" for x in t]}, "text string")
    assert found.columns == ["_in_text", "_in_0", "text"] and tuple(found.first()) == ("b", "c", "a!")


def test_append_columns_sends_inputs_once(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "id long, text string, more string")
    found = _common.append_columns(rows, ["text", "more"], lambda t, m: {"more": [x + y for x, y in zip(t, m)]}, "more string")
    assert tuple(found.first()) == (1, "a", "ab")
    plan = found._jdf.queryExecution().analyzed()
    assert plan.nodeName() == "MapInArrow" and list(plan.children().head().schema().fieldNames()) == ["id", "text", "_in_0"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_apart(spark, monkeypatch, how):
    monkeypatch.setattr(_common, "FEW", 4)
    monkeypatch.setattr(_common, "LIGHT", 8)
    keys = [1] * 50 + [2] * 30 + list(range(3, 20)) + [None] * 9 + [99]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key long")
    table = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in set(keys) - {None, 99}], "key long, n long, value string")
    got = _common.join_hot(rows, table, "key", "n", len(keys), how)
    want = rows.join(table.drop("n"), "key", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tables_go_with_the_folder_of_the_application(spark, tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from pyspark.sql import functions as F
from tidemark.llm import _common
_common.materialize(s.range(3), "a")
gone = _common.materialize(s.range(3), "b")
_common.drop(gone)
try:
    _common.materialize(s.range(3).select(F.raise_error(F.lit("no")).alias("x")), "c")
except Exception:
    pass
import os
(folder,) = [x for x in os.listdir("{tmp_path}") if x.startswith("tidemark-")]
assert not [x for x in os.listdir("{tmp_path}/" + folder) if x.startswith("b-")]
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)
    import time

    for _ in range(50):  # the JVM ends a moment after its driver
        if not list(tmp_path.glob("tidemark-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("tidemark-*"))
