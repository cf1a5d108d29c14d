"""Whole jobs on files, the stream, and the named queries."""

from __future__ import annotations

import json
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from twinseek.catalog import QUERIES, pairing
from twinseek.catalog.extraction import q_scan_files, q_scan_folder
from twinseek.operators.match import match_units, with_texts
from twinseek.operators.thresholds import ThresholdConfig
from twinseek.plans.jobs import build_pairs, check_changes, evaluate_measures, module_functions
from twinseek.schema import UNIT_SCHEMA
from twinseek.session import materialize, scratch_root
from twinseek.sources.files import changed_set, scan_files, scan_folder
from twinseek.sources.sinks import load_pairs, report_document, write_report
from twinseek.streaming.check import read_stream_matches, stream_check

ADD = """def total(items):
    result = 0
    for item in items:
        result += item
    return result
"""


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "project"
    (root / "pkg").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / "a.py").write_text(ADD)
    (root / "pkg" / "b.py").write_text("import os\n\n\n" + ADD.replace("total", "sum_up").replace("item", "thing"))
    (root / "pkg" / "c.py").write_bytes(ADD.replace("total", "count_all").replace("\n", "\r\n").encode())
    (root / "tests" / "d.py").write_text(ADD)
    (root / "latin.py").write_bytes(b"# caf\xe9\n" + ADD.encode())
    (root / "notes.txt").write_text(ADD)
    (root / "broken.py").write_text("def f(:\n")
    return str(root)


def test_scans(spark, project):
    found = {r["file_path"]: r["content"] for r in scan_files(spark, project).collect()}
    assert set(found) == {"a.py", "pkg/b.py", "pkg/c.py", "tests/d.py", "broken.py"}
    assert "\r" not in found["pkg/c.py"]
    assert {r["file_path"] for r in scan_folder(spark, project).collect()} == {"a.py", "broken.py"}
    lists = spark.createDataFrame([("  a.py \n\nnope.py\nnotes.txt\npkg/b.py",)], "value STRING")
    assert {r["file_path"] for r in changed_set(lists, scan_files(spark, project)).collect()} == {"a.py", "pkg/b.py"}


def test_check_changes(spark, project, tmp_path):
    out = str(tmp_path / "report")
    found = check_changes(spark, project, "a.py\nmissing.py", thresholds=ThresholdConfig(0.5), report_path=out)
    assert {(r["new_name"], r["old_path"], r["old_name"]) for r in found.collect()} == {
        ("total", "pkg/b.py", "sum_up"), ("total", "pkg/c.py", "count_all"),
    }
    written = spark.read.json(f"{out}/matches").collect()
    assert len(written) == spark.read.json(f"{out}/summary").first().total_matches == 2
    for r in written:
        assert r.new_function.body_content.startswith("def total") and r.new_function.signature == "def total(items)"
        assert r.existing_function.name in r.existing_function.body_content and r.existing_function.signature
    document = json.loads(report_document(found, 1).first()[0])
    assert document["summary"]["total_matches"] == 2 and document["summary"]["analysis_complete"]
    assert len(document["matches"]) == document["matches_left_out"] == 1
    assert document["matches"][0]["new_function"]["file_path"] == "a.py"
    lines = spark.createDataFrame([("a.py", 3)], "file_path STRING, line INT")
    assert check_changes(spark, project, "a.py", thresholds=ThresholdConfig(0.5), changed_lines=lines).count() == 2
    lines = spark.createDataFrame([("a.py", 30)], "file_path STRING, line INT")
    assert check_changes(spark, project, "a.py", thresholds=ThresholdConfig(0.5), changed_lines=lines).count() == 0


def test_pairs_and_evaluation(spark, project, tmp_path):
    for i in range(4):
        with open(f"{project}/m{i}.py", "w") as f:
            f.write("\n\n".join(ADD.replace("item", w).replace("total", f"t{i}{w}") * 1 for w in ("x", "yy", "zzz")).replace("result", f"res{i}"))
    for file_format in ("json", "parquet", "csv"):
        path = str(tmp_path / file_format)
        pairs, index = build_pairs(module_functions(spark, project), path, file_format, 0.5, 3)
        assert (index.n_same, index.n_cross) == (12, (13 * 13 - 4 * 9 - 1) // 2)
        assert pairs.filter("clone").count() == 12 and pairs.filter("NOT clone").count() == 12
    assert load_pairs(spark, str(tmp_path / "json"), multi_line=False).count() == 24
    array = tmp_path / "pairs.json"
    array.write_text(json.dumps([{"func1": "a", "func2": "a", "clone": True}, {"func1": "a", "func2": "b", "clone": False}]))
    metrics = evaluate_measures(spark, str(array), metrics_path=str(tmp_path / "metrics"))
    assert {r["method"]: r["roc_auc"] for r in metrics.collect()} == dict.fromkeys(
        ("jaccard_tokens", "sequence_matcher", "levenshtein_norm"), 1.0
    )
    array.write_text(json.dumps([{"func1": "a", "clone": True}]))
    with pytest.raises(ValueError, match="func2"):
        load_pairs(spark, str(array))


def test_stream(spark, tmp_path):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in UNIT_SCHEMA)
    corpus = spark.createDataFrame([(1, "x", "c.py", 1, 2, None, "a b c d"), (2, "y", "c.py", 3, 4, None, "q r")], schema)
    arriving, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    new = lambda i, body: spark.createDataFrame([(i, f"n{i}", "n.py", 1, 2, None, body)], schema)

    def run():
        arrivals = spark.readStream.schema(UNIT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(arriving)
        stream_check(arrivals, corpus, out, state, thresholds=ThresholdConfig(0.5)).awaitTermination()
        return sorted((r["new_id"], r["old_id"]) for r in read_stream_matches(spark, out).collect())

    new(1, "a b c").coalesce(1).write.parquet(arriving)
    assert run() == [(1, 1)]
    new(2, "q r s").coalesce(1).write.mode("append").parquet(arriving)
    assert run() == [(1, 1), (2, 2)]


DATA = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: repr(round(x, 9)) if isinstance(x, float) else repr(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_named_query(spark, name):
    df = entry_point.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    with duckdb.connect() as con:
        for f in os.listdir(DATA):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        twin = con.sql(sql)
        assert plain(rows, df.columns) == plain(twin.fetchall(), twin.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_pair_arrays_stay_small_under_skew(spark, tmp_path):
    """One conversation with nearly all pairs: its pairs are dealt to many arrays."""
    turns = [(1, i, "user", f'say "{i}"\nto all') for i in range(180)] + [(c, i, "user", f"short {c} {i}") for c in (2, 3) for i in range(3)]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    folders = lambda: set(Path(scratch_root(spark).removeprefix("file://")).glob("pair-arrays-*"))
    before = folders()
    back = pairing.q_load_pairs_arrays(spark, str(tmp_path))
    assert back.groupBy("source_module1").count().orderBy("source_module1").collect() == [(1, 180 * 179 // 2), (2, 3), (3, 3)]
    (folder,) = folders() - before
    sizes = [len(json.loads(p.read_text())) for p in folder.rglob("part-*") if p.stat().st_size]
    assert sum(sizes) == 180 * 179 // 2 + 6 and max(sizes) <= 1.5 * pairing.ARRAY_PAIRS


def test_report_in_passes_holds_texts_once(spark, tmp_path, monkeypatch):
    """Several passes write every match once, each text only in the report itself, with the totals of all."""
    monkeypatch.setattr("twinseek.sources.sinks.PASS_MATCHES", 2)
    rows = [(i, f"n{i}", f"f/{i}.py", 1, 2, "s", f"one two three four five six {'x' * (i % 2)}") for i in range(4)]
    units = spark.createDataFrame(rows, UNIT_SCHEMA)
    matches = materialize(match_units(units, thresholds=ThresholdConfig(0.5)), "matches")
    labels = []
    monkeypatch.setattr("twinseek.session.scratch_path", lambda s, label: labels.append(label) or str(tmp_path / f"{label}-{len(labels)}"))
    joined = with_texts(matches, units)
    labels.clear()
    write_report(joined, str(tmp_path / "r"))
    assert labels == []
    back = spark.read.json(str(tmp_path / "r" / "matches"))
    got = sorted((r.a, r.b, r.t) for r in back.selectExpr("new_function.name a", "existing_function.name b", "existing_function.body_content t").collect())
    assert got == sorted((f"n{a}", f"n{b}", rows[b][6]) for a in range(4) for b in range(4) if a != b)
    assert spark.read.json(str(tmp_path / "r" / "summary")).first().total_matches == 12


def test_files_of_a_folder_hold_few_documents(spark, tmp_path, monkeypatch):
    """One task that writes 900 documents makes several files, none of more than FILE_DOCUMENTS; all lines are counted."""
    docs = [(i, f"text {i % 7}\nsecond", "en", "big") for i in range(900)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr("twinseek.catalog.extraction.scratch_path", lambda s, label: made.append(str(tmp_path / label)) or made[-1])
    for found, total in ((q_scan_folder(spark, str(tmp_path)), 1800), (q_scan_files(spark, str(tmp_path)), 1800)):
        assert found.agg({"n": "sum"}).first()[0] == total
        files = [p for p in Path(made[-1]).rglob("*.txt")]
        assert files and max(p.read_text().count("\n") for p in files) <= 2 * 200
