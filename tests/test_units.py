"""Text functions, thresholds, extraction, filters and changed lines."""

from __future__ import annotations

import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from twinseek.functions import text as tx
from twinseek.functions.measures import register_measures
from twinseek.operators.changes import hunk_lines, touched_units
from twinseek.operators.extract import extract_functions, number_units, parse_responses, split_units
from twinseek.operators.filters import filter_units, name_family, pair_quality, pattern_filter
from twinseek.operators.thresholds import ThresholdConfig, folder_threshold, folder_threshold_table, should_report
from twinseek.operators.variants import make_variants
from twinseek.schema import validate_units

TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|==|!=|<=|>=|[\(\)\[\]\{\}\.,:;\+\-\*/%<>]")


def random_texts(n: int = 300) -> list[str]:
    rng = random.Random(11)
    letters = list("ab_Z09 \t\n\r#\"'=!<>()[]{}.,:;+-*/%@é") + ["\x1c", "\x85", " ", "\xa0", "٣", "😀", "ß", "\x0b", "\\"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_text_functions_agree_with_python(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, s STRING")
    got = df.select("i", tx.tokenize("s").alias("t"), tx.normalize_lines("s").alias("l"), tx.normalize_literals("s").alias("n"))

    def lines(s):
        out = [re.sub(r"\s+", " ", re.sub(r"#.*$", "", x).strip()) for x in s.split("\n")]
        return "\n".join(x for x in out if x)

    def literals(s):
        for pattern, by in ((r"(?m)#.*$", ""), (r'"[^"]*"', '"STR"'), (r"'[^']*'", "'STR'"), (r"\b\d+\b", "0"), (r"\s+", " ")):
            s = re.sub(pattern, by, s)
        return s.strip()

    for r in got.collect():
        s = texts[r["i"]]
        assert r["t"] == TOKEN.findall(s)
        assert r["l"] == lines(s)
        assert r["n"] == literals(s)


def test_paths_and_names(spark):
    cases = {
        "test_a.py": True, "a/TEST_b.py": True, "a_test.py": True, "tests/a.py": True, "x/Test/y/a.py": True,
        "test_samples/x.py": False, "a/contest.py": False, "a/test.py": False, "latest/x.py": False,
    }
    df = spark.createDataFrame(list(cases.items()), "p STRING, e BOOLEAN")
    assert df.filter(tx.is_test_file("p") != F.col("e")).count() == 0
    names = spark.createDataFrame([("_a",), ("__init__",), ("a_",)], "n STRING")
    assert [r[0] for r in names.select(tx.is_private("n")).collect()] == [True, True, False]


def test_thresholds(spark):
    config = ThresholdConfig(0.55, {"lib/core": 0.35, "lib/plugins/web": 0.45})
    cases = [("setup.py", 0.55), ("lib/core/io/read.py", 0.35), ("/lib/plugins/web/q/z.py", 0.45), ("lib/plugins/w.py", 0.55)]
    df = spark.createDataFrame(cases, "p STRING, e DOUBLE")
    assert df.filter(folder_threshold("p", config) != F.col("e")).count() == 0
    quirky = ThresholdConfig(0.7, {"src1": 0.5, "/": 0.1, "a": 0.2, "a/": 0.9, "src1/en/": 0.6})
    cases = [("src1/x", 0.5), ("src10/x", 0.5), ("src2/x", 0.7), ("a/x", 0.2), ("ab", 0.2), ("src1/en/y", 0.6), ("", 0.7)]
    df = spark.createDataFrame(cases, "file_path STRING, e DOUBLE")
    assert df.filter(folder_threshold("file_path", quirky) != F.col("e")).count() == 0
    rules = spark.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(quirky.folder_thresholds.items())], "folder STRING, threshold DOUBLE, pos INT"
    )
    looked_up = folder_threshold_table(df, rules, 0.7)
    assert looked_up.count() == len(cases)
    assert looked_up.filter("threshold <> e").count() == 0


def test_report_decisions(spark):
    config = ThresholdConfig(folder_thresholds={"lib/core": 0.25, "bench": 0.85})
    cases = [
        (score, path, score >= least)
        for path, least in (("lib/core/a.py", 0.25), ("bench/b.py", 0.85), ("app.py", 0.7))
        for score in (0.0, 0.2, 0.25, 0.69, 0.7, 0.84, 0.85, 1.0)
    ]
    df = spark.createDataFrame(cases, "similarity DOUBLE, file_path STRING, e BOOLEAN")
    assert sorted(map(tuple, should_report(df, config).collect())) == sorted(c for c in cases if c[2])


def test_threshold_settings():
    assert ThresholdConfig().global_threshold == 0.7
    config = ThresholdConfig.from_strings("0.65", '{"lib/core": 0.15, "bench": 1}')
    assert (config.global_threshold, config.folder_thresholds) == (0.65, {"lib/core": 0.15, "bench": 1})
    assert ThresholdConfig.from_strings(None, "{}").folder_thresholds == {}
    for bad in (("x", None), (None, "nope"), (None, "[1]"), (None, '{"a": "b"}'), ("1.5", None), (None, '{"a": -1}')):
        with pytest.raises(ValueError):
            ThresholdConfig.from_strings(*bad)


SOURCE = '''import os

def outer(a, b: int = 2, /, c=3, *args: str, d, **kw) -> "list[int]":
    """Doc # not a comment"""
    def inner():
        return 1
    return inner()

class K:
    @staticmethod
    @property
    async def m(self, x: dict[str, int] = {}):
        s = """
text"""
        return s
    def one(self): pass
'''


def test_extract_functions(spark):
    files = spark.createDataFrame(
        [("a.py", SOURCE), ("bad.py", "def f(:\n"), ("empty.py", ""), ("nul.py", "x = 1\0"), ("none.py", "x = 1\n")],
        "file_path STRING, content STRING",
    )
    got = {r["name"]: r for r in extract_functions(files).collect()}
    assert set(got) == {"outer", "m", "one", "inner"}
    assert {n: (r["line_start"], r["line_end"]) for n, r in got.items()} == {
        "outer": (3, 7), "inner": (5, 6), "m": (12, 15), "one": (16, 16),
    }
    assert got["outer"]["signature"] == "def outer(c, *args: str, **kw) -> 'list[int]'"
    assert got["m"]["signature"] == "async def m(self, x: dict[str, int])"
    assert got["inner"]["body"] == "    def inner():\n        return 1"
    order = [n.name for n in ast.walk(ast.parse(SOURCE)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    assert [n for n, r in sorted(got.items(), key=lambda kv: kv[1]["pos"])] == order
    exact = {r["name"]: r["body"] for r in extract_functions(files, "segment").collect()}
    assert exact["inner"] == "def inner():\n        return 1"
    assert exact["one"] == "def one(self): pass"
    with pytest.raises(ValueError):
        extract_functions(files, "words")
    numbered = number_units(extract_functions(files))
    assert numbered.select("unit_id").distinct().count() == 4


def test_split_units(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n \t\nc\n"), (2, ""), (3, "x")], "id INT, text STRING")
    got = sorted(map(tuple, split_units(df, "id").collect()))
    assert got == [(1, 0, 1, 2, "a\nb"), (1, 1, 5, 5, "c"), (3, 0, 1, 1, "x")]
    blocks = sorted(map(tuple, split_units(df, "id", block_lines=4).collect()))
    assert blocks == [(1, 0, 1, 4, "a\nb\n\n \t"), (1, 1, 5, 6, "c\n"), (2, 0, 1, 1, ""), (3, 0, 1, 1, "x")]


def test_parse_responses(spark):
    rows = [
        (1, "```python\ndef a():\n    return 1\n\nasync def skip():\n    pass\n\ndef b():\n    return 2\n```"),
        (2, "Sure!\ndef a():\n    x = 1\n\n    return x\nThat was it\ndef b(y:\n    return\n"),
        (3, "def c():\n    pass"),
        (4, "no code here"),
        (5, "```"),
        (6, "  \n```\ndef d(): pass"),
    ]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    good, bad = parse_responses(df, "id")
    assert sorted(map(tuple, good.collect())) == [
        (1, 1, "def a():\n    return 1"), (1, 2, "def b():\n    return 2"), (2, 1, "def a():\n    x = 1\n\n    return x"),
        (3, 1, "def c():\n    pass"), (6, 1, "def d(): pass"),
    ]
    assert [(r["id"], r["variant_no"], r["body"]) for r in bad.collect()] == [(2, 2, "def b(y:\n    return")]


def test_hunk_lines(spark):
    rows = [
        ("a", "@@ -1,2 +3,2 @@ def f\n+x\n@@ -9 +10 @@\n@@ -1 +4,3 @@"), ("b", "@@ -1 +5,0 @@"), ("c", "@@ -1"),
        ("d", "@@ -1 +x @@\n@@ -1 +1 @@"), ("e", " @@ -1 +1 @@"), ("f", ""),
    ]
    got = hunk_lines(spark.createDataFrame(rows, "file_path STRING, diff STRING"))
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("a", 4), ("a", 5), ("a", 6), ("a", 10)]


def test_touched_units(spark):
    rng = random.Random(2)
    units = [(i, f"f{i % 3}", s := rng.randint(1, 900), s + rng.randint(0, 600)) for i in range(60)]
    lines = [(f"f{rng.randint(0, 3)}", rng.randint(1, 1600)) for _ in range(12)]
    got = touched_units(
        spark.createDataFrame(units, "unit_id BIGINT, file_path STRING, line_start INT, line_end INT"),
        spark.createDataFrame(lines, "file_path STRING, line INT"),
    )
    want = {u[0] for u in units if any(p == u[1] and u[2] <= n <= u[3] for p, n in lines)}
    assert sorted(r["unit_id"] for r in got.collect()) == sorted(want)


def test_filters(spark):
    rows = [("f", "src/a.py", 1, 5), ("g", "src/a.py", 1, 4), ("_h", "src/a.py", 1, 9), ("k", "tests/a.py", 1, 9)]
    units = spark.createDataFrame(rows, "name STRING, file_path STRING, line_start INT, line_end INT")
    assert [r["name"] for r in filter_units(units).collect()] == ["f", "_h"]
    assert [r["name"] for r in filter_units(units, exclude_private=True).collect()] == ["f"]
    assert [r["name"] for r in filter_units(units, min_lines=9, exclude_test_files=False).collect()] == ["_h", "k"]
    paths = [
        ("a", "src/x/y.py"), ("b", "src/y.py"), ("c", "lib/y.py"), ("d", "src/conftest.py"), ("e", "conftest.py"),
        ("mock_x", "src/y.py"), ("f", "src/generated/z.py"), ("g", "generated/z.py"),
    ]
    found = pattern_filter(spark.createDataFrame(paths, "name STRING, file_path STRING"), include=("src/**/*.py",))
    assert [r["name"] for r in found.collect()] == ["a", "b", "f"]
    names = spark.createDataFrame([("check_x",), ("parse_y",), ("get_",), ("sum",), ("total_2",)], "n STRING")
    got = [r[0] for r in names.select(name_family("n")).collect()]
    assert got == ["validation", "data_processing", "crud_operations", None, "calculations"]


def test_validate_units(spark):
    rows = [("f", "a", 1, 1), ("", "a", 1, 1), ("f", "", 1, 1), ("f", "a", 0, 1), ("f", "a", 3, 2), (None, "a", 1, 1)]
    good, bad = validate_units(spark.createDataFrame(rows, "name STRING, file_path STRING, line_start INT, line_end INT"))
    assert good.count() == 1
    assert bad.count() == 5


def test_conflicting_labels_and_tabs(spark):
    long = "def f(x):\n    y = x + 1\n    return y"
    rows = [(long, long + "1", True, "a"), (long, long + "1", False, "a"), (long, long + "2", True, "z"), (long, long + "2", True, "b")]
    pairs = spark.createDataFrame(rows, "func1 STRING, func2 STRING, clone BOOLEAN, source_module1 STRING")
    assert [r.source_module1 for r in pair_quality(pairs).collect()] == ["b"]
    tabs = spark.createDataFrame([("def f():\tpass\n", "def g():\n\tpass", True)], "func1 STRING, func2 STRING, clone BOOLEAN")
    assert pair_quality(tabs).count() == 0
    assert pair_quality(tabs, exclude_trivial=False).count() == 1


def test_pair_quality(spark):
    long = "def f(x):\n    y = x + 1\n    return y"
    rows = [(long, long + "#", True), (long, long + "#", True), (long, "def f(): pass", True), (long, "def f(x):\n    return x", False),
            ("x", long, False), (long + "a", long + "b", False)]
    pairs = spark.createDataFrame(rows, "func1 STRING, func2 STRING, clone BOOLEAN")
    assert pair_quality(pairs, min_length=10).count() == 2
    assert pair_quality(pairs).count() == 3
    assert pair_quality(pairs, min_length=10, max_pairs=1).count() == 1


def test_make_variants(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h\ni j k l m n o p"), (2, "")], "unit_id INT, body STRING")
    rows = make_variants(df, n=4, strength=0.5).collect()
    assert len(rows) == 10
    by = {(r["module"], r["variant_no"]): r["body"] for r in rows}
    assert by[1, 0] == "a b c d e f g h\ni j k l m n o p"
    assert by[1, 4].lower() == by[1, 0] and by[1, 4] != by[1, 0]
    assert {r["body"] for r in make_variants(df, n=4, strength=0.5).collect()} == {r["body"] for r in rows}


def test_measures_in_sql(spark):
    register_measures(spark)
    row = spark.sql(
        "SELECT jaccard_tokens('a b == c', 'a == d'), levenshtein_norm('kitten', 'sitting'), sequence_matcher('abcd', 'bcde'), "
        "jaccard_tokens('', '!'), levenshtein_norm('', ''), levenshtein_norm('', 'a')"
    ).first()
    assert [round(x, 6) for x in row] == [0.4, 0.571429, 0.75, 1.0, 1.0, 0.0]


def test_small_source_table_is_parsed_by_all_cores(spark):
    files = spark.createDataFrame([(f"f{i}.py", f"def f{i}():\n    return {i}\n") for i in range(40)], "file_path string, content string").coalesce(1)
    found = extract_functions(files)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.name for r in found.collect()) == sorted(f"f{i}" for i in range(40))
