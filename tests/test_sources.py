import json

import pytest
from pyspark.sql.utils import AnalysisException

from factlake.operators.checks import CheckFailed
from factlake.sources import corpus, manifest, sinks
from tests.helpers import rows, table


def test_read_corpus(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.c").write_text("one\ntwo\n")
    (tmp_path / "deep" / "er" / "b.c").write_text("three")
    (tmp_path / "skip.h").write_text("no")
    got = corpus.read_corpus(spark, str(tmp_path), "*.c")
    assert sorted((r["path"].rsplit("/", 1)[1], r["text"]) for r in got.collect()) == [("a.c", "one\ntwo\n"), ("b.c", "three")]
    records = corpus.read_records(spark, str(tmp_path), glob="*.c")
    assert [r[1:] for r in rows(records)] == [(0, "one\n"), (1, "two\n"), (0, "three")]


def test_union_and_changes(spark):
    a, b = table(spark, [(1, "x")], "id int, t string"), table(spark, [(2,)], "id int")
    assert rows(corpus.union_sources([("a", a), ("b", b)])) == [(1, "x", "a"), (2, None, "b")]
    with pytest.raises(ValueError):
        corpus.union_sources([])
    after = table(spark, [(1, "y"), (2, None), (3, "new")], "id int, t string")
    before = table(spark, [(1, "x"), (2, None)], "id int, t string")
    assert rows(corpus.changed_only(before, after, ["id"], "t")) == [(1, "y")]


TARGETS = {
    "exe.json": {
        "type": "EXECUTABLE",
        "artifacts": [{"path": "app"}],
        "link": {"commandFragments": [{"fragment": "-O2", "role": "flags"}, {"fragment": "-lm", "role": "libraries"},
                                      {"fragment": "x.o", "role": "libraries"}, {"fragment": "z", "role": "flags"}]},
        "sources": [{"path": "main.c"}],
    },
    "objs.json": {"type": "OBJECT_LIBRARY", "artifacts": [{"path": "x.o"}, {"path": "y.o"}], "sources": [{"path": "x.c"}, {"path": "y.c"}]},
}


def write_manifest(folder, targets, configurations=1):
    folder.mkdir(parents=True, exist_ok=True)
    names = {"targets": [{"jsonFile": n} for n in targets]}
    (folder / "index.json").write_text(json.dumps({"reply": {"codemodel-v2": {"jsonFile": "model.json"}}, "more": 1}))
    (folder / "model.json").write_text(json.dumps({"configurations": [names] * configurations}))
    for name, body in targets.items():
        if body is not None:
            (folder / name).write_text(json.dumps(body))
    return str(folder)


def test_manifest(spark, tmp_path):
    targets, deps = manifest.read_manifest(spark, write_manifest(tmp_path / "m", TARGETS))
    assert rows(targets, "target", "type", "artifact") == [
        ("exe.json", "EXECUTABLE", "app"), ("objs.json", "OBJECT_LIBRARY", "x.o"), ("objs.json", "OBJECT_LIBRARY", "y.o")
    ]
    assert rows(deps, "artifact", "pos", "dep") == [("app", 0, "x.o"), ("app", 1, "main.c"), ("x.o", 0, "x.c"), ("y.o", 0, "y.c")]


@pytest.mark.parametrize(
    "change",
    [
        {"exe.json": {**TARGETS["exe.json"], "type": "STATIC_LIBRARY"}},
        {"two.json": {**TARGETS["exe.json"]}},
        {"objs.json": {**TARGETS["objs.json"], "sources": [{"path": "x.c"}]}},
        {"exe.json": {**TARGETS["exe.json"], "artifacts": []}},
        {"exe.json": {k: v for k, v in TARGETS["exe.json"].items() if k != "sources"}},
        {"gone.json": None},
    ],
)
def test_manifest_faults(spark, tmp_path, change):
    folder = write_manifest(tmp_path / "m", {**TARGETS, **change})
    with pytest.raises(CheckFailed):
        manifest.read_manifest(spark, folder)


def test_manifest_needs_one_configuration(spark, tmp_path):
    with pytest.raises(CheckFailed):
        manifest.read_manifest(spark, write_manifest(tmp_path / "m", TARGETS, configurations=2))


def test_hints(spark, tmp_path):
    path = tmp_path / "hints.csv"
    path.write_text("from,to,kind\nbar,b.bar,function\nbar,b.t,type\n")
    assert rows(manifest.read_hints(spark, str(path), "csv")) == [("bar", "b.bar", "function"), ("bar", "b.t", "type")]
    for line in ("bar,c.bar,function\n", "x,y,module\n"):
        path.write_text("from,to,kind\nbar,b.bar,function\n" + line)
        with pytest.raises(CheckFailed):
            manifest.read_hints(spark, str(path), "csv")


def test_write_tree(spark, tmp_path):
    df = table(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k1 string, k2 string, v int")
    sinks.write_tree(df, ["k1", "k2"], str(tmp_path / "t"))
    assert (tmp_path / "t" / "k1=a" / "k2=y").is_dir()
    assert rows(spark.read.parquet(str(tmp_path / "t")), "k1", "k2", "v") == rows(df)


def test_write_modes(spark, tmp_path):
    path, one = str(tmp_path / "m"), table(spark, [(1,)], "v int")
    with pytest.raises(AnalysisException):
        sinks.write_mode(None, path, "r", spark)
    with pytest.raises(AnalysisException):
        sinks.write_mode(one, path, "r+")
    assert sinks.write_mode(one, path, "a") is None
    assert rows(sinks.write_mode(one, path, "a+")) == [(1,), (1,)]
    assert rows(sinks.write_mode(one, path, "w+")) == [(1,)]
    assert rows(sinks.write_mode(one, path, "r+")) == [(1,), (1,)]
    for bad in ("x", "", "+w"):
        with pytest.raises(ValueError):
            sinks.write_mode(one, path, bad)
    with pytest.raises(ValueError):
        sinks.write_mode(None, path, "w", spark)
    with pytest.raises(ValueError):
        sinks.write_mode(one, path, "r")
