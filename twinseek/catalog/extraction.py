from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.catalog.registry import DOCUMENTS_SQL, PARTS_SQL, SPACE, TOKENS, documents, parts, query, table
from twinseek.functions.text import is_private, is_test_file, normalize_lines, normalize_literals, tokenize
from twinseek.operators.changes import hunk_lines, touched_units
from twinseek.operators.extract import extract_functions, number_units, parse_responses, split_units
from twinseek.operators.filters import (
    DOMAIN_WORDS, EXCLUDED_PATHS, IGNORED_NAMES, NAME_FAMILIES, filter_units, is_domain_name, name_family, pattern_filter,
)
from twinseek.operators.variants import make_variants
from twinseek.schema import unit_metrics, validate_units
from twinseek.session import scratch_path
from twinseek.sources.files import changed_cap, changed_set, scan_files, scan_folder


# --- files ---------------------------------------------------------------------------------------------------------


# A file that is read back is one row, so a file holds a bounded number of documents, however many a task writes.
FILE_DOCUMENTS = 200


def _line_counts(files: DataFrame, *keys: str) -> DataFrame:
    # Each file ends with a line break, so the last piece of its text is not a line.
    lines = F.split("content", "\n", -1)
    listed = files.select(*keys, F.explode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("text"))
    return listed.groupBy(*keys, F.md5("text").alias("line")).agg(F.count("*").alias("n"))


_ALL_LINES = """SELECT source, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS x FROM documents"""


@query("scan_files", f"SELECT source, md5(x) AS line, count(*) AS n FROM ({_ALL_LINES}) GROUP BY ALL")
def q_scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files in one folder per source, read back as files, counted by line."""
    root = scratch_path(spark, "files")
    table(spark, sf, "documents").select("text", "source").write.option("maxRecordsPerFile", FILE_DOCUMENTS).partitionBy("source").text(root)
    files = scan_files(spark, root, suffix=".txt")
    return _line_counts(files.withColumn("source", F.regexp_extract("file_path", "^source=([^/]*)/", 1)), "source")


@query("scan_folder", f"SELECT md5(x) AS line, count(*) AS n FROM ({_ALL_LINES}) GROUP BY ALL")
def q_scan_folder(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "folder")
    table(spark, sf, "documents").select("text").write.option("maxRecordsPerFile", FILE_DOCUMENTS).text(root)
    return _line_counts(scan_folder(spark, root, suffix=".txt"))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    lists = docs.select(F.concat(F.lit("  "), "file_path", F.lit(" \n\n"), "file_path", F.lit(".bak\n")).alias("value"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"))
    return changed_set(lists, docs.join(labels, "unit_id", "left_semi"), suffix=".txt")


_LISTED_SQL = f"WITH {DOCUMENTS_SQL} SELECT DISTINCT file_path FROM docs WHERE unit_id IN (SELECT doc_id FROM labels)"


@query("changed_set", _LISTED_SQL)
def q_changed_set(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf)


@query("changed_cap", f"{_LISTED_SQL} ORDER BY file_path LIMIT 50")
def q_changed_cap(spark: SparkSession, sf: str) -> DataFrame:
    return changed_cap(_listed(spark, sf), 50)


# --- functions out of source text ------------------------------------------------------------------------------------
# One source file per part. Small parts get a file with a syntax error, which gives no functions.


def _source_text() -> Column:
    text = F.concat(
        F.lit("import math\n\n\nclass C:\n    @property\n    def m_"), F.col("p_partkey"),
        F.lit("(self, a: int, *rest, **opts) -> str:\n        total = a + "), F.col("p_size"),
        F.lit("\n        def inner(x: 'T'=1):\n            return x\n        return '"), F.col("p_name"),
        F.lit("'\n\n\nasync def f_"), F.col("p_partkey"), F.lit("(a, /, b=1, *, c):\n    # "), F.col("p_brand"),
        F.lit("\n    return a\n"),
    )
    return F.when(F.col("p_type") == "SMALL", F.concat(text, F.lit("def broken(:\n"))).otherwise(text)


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(F.concat(F.lit("lib/p"), "p_partkey", F.lit(".py")).alias("file_path"), _source_text().alias("content"))


_HEAD_M = "'def m_' || p_partkey || '(self, a: int, *rest, **opts) -> str'"
_BODY_M = """'def m_' || p_partkey || '(self, a: int, *rest, **opts) -> str:' || chr(10) || '        total = a + ' || p_size || chr(10)
  || '        def inner(x: ''T''=1):' || chr(10) || '            return x' || chr(10) || '        return ''' || p_name || ''''"""
_BODY_F = """'async def f_' || p_partkey || '(a, /, b=1, *, c):' || chr(10) || '    # ' || p_brand || chr(10) || '    return a'"""
_BODY_I = """'def inner(x: ''T''=1):' || chr(10) || '            return x'"""


def _functions_sql(exact: bool) -> str:
    pad = lambda n: "" if exact else f"'{' ' * n}' || "
    return f"""src AS (SELECT *, 'lib/p' || p_partkey || '.py' AS file_path FROM part WHERE p_type <> 'SMALL'),
    fns AS (SELECT file_path, 1 AS pos, 'm_' || p_partkey AS name, 6 AS line_start, 10 AS line_end, {_HEAD_M} AS signature,
        {pad(4)}{_BODY_M} AS body FROM src
      UNION ALL SELECT file_path, 0, 'f_' || p_partkey, 13, 15, 'async def f_' || p_partkey || '(b)', {_BODY_F} FROM src
      UNION ALL SELECT file_path, 2, 'inner', 8, 9, 'def inner(x: ''T'')', {pad(8)}{_BODY_I} FROM src)"""


@query("extract_functions", f"WITH {_functions_sql(False)} SELECT file_path, pos, name, line_start, line_end, body FROM fns")
def q_extract_functions(spark: SparkSession, sf: str) -> DataFrame:
    return extract_functions(source_files(spark, sf)).drop("signature")


@query("signature_text", f"WITH {_functions_sql(False)} SELECT file_path, name, signature FROM fns")
def q_signature_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_functions(source_files(spark, sf)).select("file_path", "name", "signature")


@query("segment_functions", f"WITH {_functions_sql(True)} SELECT file_path, pos, name, line_start, line_end, body FROM fns")
def q_segment_functions(spark: SparkSession, sf: str) -> DataFrame:
    return extract_functions(source_files(spark, sf), body_mode="segment").drop("signature")


_RESPONSE_SQL = """WITH r AS (SELECT p_partkey, 'def a_' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_size AS a,
    'def b(y):' || chr(10) || '    return ''' || p_name || '''' AS b, p_type FROM part)
  SELECT p_partkey, 1 AS variant_no, a AS body FROM r UNION ALL SELECT p_partkey, 2, b FROM r"""


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with two functions; promo parts add an unfinished third one, which only a line scan survives."""
    part = table(spark, sf, "part")
    text = F.concat(
        F.lit("```python\ndef a_"), F.col("p_partkey"), F.lit("(x):\n    return x + "), F.col("p_size"),
        F.lit("\n\n\ndef b(y):\n    return '"), F.col("p_name"), F.lit("'\n"),
        F.when(F.col("p_type") == "PROMO", F.lit("\ndef c(z:\n    return\n")).otherwise(F.lit("x = 1\n")), F.lit("```"),
    )
    return part.select("p_partkey", text.alias("text"))


@query("parse_responses", _RESPONSE_SQL)
def q_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    return parse_responses(_responses(spark, sf), "p_partkey")[0]


@query("parse_responses_rejected", "SELECT p_partkey, 3 AS variant_no, 'def c(z:' || chr(10) || '    return' AS body, TRUE AS has_error FROM part WHERE p_type = 'PROMO'")
def q_parse_responses_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces put aside, with the reason."""
    bad = parse_responses(_responses(spark, sf), "p_partkey")[1]
    return bad.select("p_partkey", "variant_no", "body", (F.length("error") > 0).alias("has_error"))


# --- columns of units --------------------------------------------------------------------------------------------------


@query(
    "split_units",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    b AS (SELECT *, (i - 1) // 5 AS part FROM l)
    SELECT doc_id, part::INT AS part, min(i)::INT AS line_start, max(i)::INT AS line_end, string_agg(x, chr(10) ORDER BY i) AS body FROM b GROUP BY doc_id, part""",
)
def q_split_units(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of five lines."""
    return split_units(table(spark, sf, "documents"), "doc_id", block_lines=5)


@query(
    "split_units_paragraphs",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    b AS (SELECT *, regexp_full_match(x, '{SPACE}*') AS blank FROM l),
    g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM b),
    p AS (SELECT doc_id, min(i)::INT AS line_start, max(i)::INT AS line_end, string_agg(x, chr(10) ORDER BY i) AS body FROM g WHERE NOT blank GROUP BY doc_id, gap)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1)::INT AS part, line_start, line_end, body FROM p""",
)
def q_split_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return split_units(table(spark, sf, "documents"), "doc_id")


@query(
    "unit_metrics",
    f"WITH {DOCUMENTS_SQL} SELECT unit_id, line_end - line_start + 1 AS line_count, line_end - line_start + 1 < 5 AS is_small FROM docs",
)
def q_unit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return unit_metrics(documents(spark, sf)).select("unit_id", "line_count", "is_small")


_BROKEN_SQL = """WITH u AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS name,
    CASE WHEN l_linestatus = 'F' AND l_discount = 0 THEN NULL ELSE l_linestatus END AS file_path,
    l_linenumber - 1 AS line_start, l_quantity::INT - 3 AS line_end FROM lineitem),
  e AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'name is empty' WHEN coalesce(file_path, '') = '' THEN 'file path is empty'
    WHEN line_start <= 0 THEN 'line start is not positive' WHEN line_end < line_start THEN 'line end precedes line start' END AS error FROM u)
  SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM e GROUP BY 1"""


@query("validate_units", _BROKEN_SQL)
def q_validate_units(spark: SparkSession, sf: str) -> DataFrame:
    """Rows made from order lines, many of them broken: valid ones and quarantine, counted by rule."""
    units = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("name"),
        F.when(~((F.col("l_linestatus") == "F") & (F.col("l_discount") == 0)), F.col("l_linestatus")).alias("file_path"),
        (F.col("l_linenumber") - 1).alias("line_start"),
        (F.col("l_quantity").cast("int") - 3).alias("line_end"),
    )
    good, bad = validate_units(units)
    both = good.select(F.lit("valid").alias("error")).unionByName(bad.select("error"))
    return both.groupBy("error").agg(F.count("*").alias("n"))


@query(
    "normalize_lines",
    f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x:
      regexp_replace(regexp_replace(regexp_replace(x, '#[^\\n]*$', ''), '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+', ' ', 'g')) AS ls FROM documents)
    SELECT doc_id, array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)) AS body FROM l""",
)
def q_normalize_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalize_lines("text").alias("body"))


def literals_sql(text: str) -> str:
    out = f"regexp_replace({text}, '(?m)#[^\\n]*$', '', 'g')"
    out = f"""regexp_replace({out}, '"[^"]*"', '"STR"', 'g')"""
    out = f"regexp_replace({out}, '''[^'']*''', '''STR''', 'g')"
    # Whole numbers between word boundaries: a digit run without a word character on either side.
    out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_])(\\p{{Nd}}+)($|[^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1) || '\\3', 'g')"
    out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_])(\\p{{Nd}}+)($|[^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1) || '\\3', 'g')"
    out = f"replace({out}, chr(1), '0')"
    return f"regexp_replace(regexp_replace({out}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


@query("normalize_literals", f"SELECT doc_id, {literals_sql('text')} AS body FROM documents")
def q_normalize_literals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalize_literals("text").alias("body"))


@query(
    "tokenize",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{TOKENS}')) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '{TOKENS}'), ' ')) AS tokens,
      len(list_distinct(regexp_extract_all(text, '{TOKENS}'))) AS n_distinct FROM documents""",
)
def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    toks = table(spark, sf, "documents").select("doc_id", tokenize("text").alias("t"))
    return toks.select(
        "doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
    )


# --- filters ------------------------------------------------------------------------------------------------------------
# Paths and names with test folders, test files and private names among them, one unit per order line.

_VERBS = ("validate_", "_check_", "process_", "get_", "calculate_", "test_", "parse_user_")
_FOLDERS = ("src/core", "tests/unit", "src/Test/deep", "vendor/lib", "src/test_samples")
_FILES = ("main", "test_main", "main_test", "conftest")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(pick(_VERBS, "l_suppkey"), "l_partkey").alias("name"),
        F.concat_ws("/", pick(_FOLDERS, "l_partkey"), F.concat(pick(_FILES, "l_orderkey"), F.lit(".py"))).alias("file_path"),
        "l_linenumber", F.lit(1).alias("line_start"), F.col("l_quantity").cast("int").alias("line_end"),
    ).drop("x")


def _pick_sql(values: tuple[str, ...], c: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({c} % {len(values)} + 1)::INT]"


_UNITS_SQL = f"""u AS (SELECT l_orderkey, l_linenumber, {_pick_sql(_VERBS, 'l_suppkey')} || l_partkey AS name,
  {_pick_sql(_FOLDERS, 'l_partkey')} || '/' || {_pick_sql(_FILES, 'l_orderkey')} || '.py' AS file_path,
  1 AS line_start, l_quantity::INT AS line_end FROM lineitem)"""
_IS_TEST = """(starts_with(lower(string_split(file_path, '/')[-1]), 'test_') OR ends_with(lower(string_split(file_path, '/')[-1]), '_test.py')
  OR len(list_intersect(list_transform(string_split(file_path, '/')[:-2], lambda x: lower(x)), ['test', 'tests'])) > 0)"""
_KEY = ("l_orderkey", "l_linenumber")


@query("filter_units", f"WITH {_UNITS_SQL} SELECT l_orderkey, l_linenumber FROM u WHERE line_end - line_start + 1 >= 5 AND NOT {_IS_TEST} AND NOT starts_with(name, '_')")
def q_filter_units(spark: SparkSession, sf: str) -> DataFrame:
    return filter_units(_units(spark, sf), exclude_private=True).select(*_KEY)


@query("is_test_file", f"WITH {_UNITS_SQL} SELECT file_path, {_IS_TEST} AS is_test, count(*) AS n FROM u GROUP BY ALL")
def q_is_test_file(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).groupBy("file_path", is_test_file("file_path").alias("is_test")).agg(F.count("*").alias("n"))


@query("is_private", f"WITH {_UNITS_SQL} SELECT name, starts_with(name, '_') AS is_private, count(*) AS n FROM u GROUP BY ALL")
def q_is_private(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).groupBy("name", is_private("name").alias("is_private")).agg(F.count("*").alias("n"))


def _glob_sql(pattern: str) -> str:
    """Anchored regular expression of a path or name glob: `**/` any folders, `**` anything, `*` anything but a slash."""
    parts = re.split(r"(\*\*/|\*\*|\*)", pattern)
    return "^" + "".join({"**/": "(.*/)?", "**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in parts) + "$"


_EXCLUDED = "|".join(map(_glob_sql, EXCLUDED_PATHS))
_FAMILIES = " ".join(f"WHEN regexp_matches(name, '{'|'.join(map(_glob_sql, globs))}') THEN '{family}'" for family, globs in NAME_FAMILIES.items())


@query(
    "pattern_filter",
    f"""WITH {_UNITS_SQL} SELECT l_orderkey, l_linenumber FROM u WHERE regexp_matches(file_path, '{_glob_sql("src/**/*.py")}')
      AND NOT regexp_matches(file_path, '{_EXCLUDED}') AND NOT regexp_matches(name, '{"|".join(IGNORED_NAMES)}')""",
)
def q_pattern_filter(spark: SparkSession, sf: str) -> DataFrame:
    return pattern_filter(_units(spark, sf), include=("src/**/*.py",)).select(*_KEY)


@query(
    "name_family",
    f"""WITH {_UNITS_SQL} SELECT name, CASE {_FAMILIES} END AS family, regexp_matches(lower(name), '{"|".join(DOMAIN_WORDS)}') AS is_domain,
      count(*) AS n FROM u GROUP BY ALL""",
)
def q_name_family(spark: SparkSession, sf: str) -> DataFrame:
    named = _units(spark, sf).select("name", name_family("name").alias("family"), is_domain_name("name").alias("is_domain"))
    return named.groupBy("name", "family", "is_domain").agg(F.count("*").alias("n"))


# --- changed lines ------------------------------------------------------------------------------------------------------


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("diff --git a b\n@@ -1,2 +"), k % 700 + 1, F.lit(","), k % 4, F.lit(" @@ def f():\n-x\n+y\n@@ -9 +"), k % 50 + 1,
        F.lit(" @@\n+z\n@@ -"), k % 9, F.lit(",1 +"), k % 700 + 2, F.lit(",2 @@\n"),
    )
    return table(spark, sf, "orders").select(F.concat(F.lit("f"), k, F.lit(".py")).alias("file_path"), text.alias("diff"))


@query(
    "hunk_lines",
    """WITH o AS (SELECT 'f' || o_orderkey || '.py' AS file_path, o_orderkey AS k FROM orders)
    SELECT DISTINCT file_path, line::INT AS line FROM (SELECT file_path, unnest(range(k % 700 + 1, k % 700 + 1 + k % 4)) AS line FROM o
      UNION ALL SELECT file_path, k % 50 + 1 FROM o UNION ALL SELECT file_path, unnest(range(k % 700 + 2, k % 700 + 4)) FROM o)""",
)
def q_hunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return hunk_lines(_diffs(spark, sf))


@query(
    "touched_units",
    """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
    u AS (SELECT doc_id, s AS line_start, least(s + 4, n) AS line_end FROM (SELECT doc_id, n, unnest(range(1, n + 1, 5)) AS s FROM l)),
    c AS (SELECT doc_id, 1 + (doc_id * 7) % 12 AS line FROM labels UNION ALL SELECT doc_id, 3 + quality * 20 FROM labels)
    SELECT doc_id::VARCHAR AS file_path, line_start::INT AS line_start, line_end::INT AS line_end FROM u WHERE EXISTS (
      SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND line BETWEEN line_start AND line_end)""",
)
def q_touched_units(spark: SparkSession, sf: str) -> DataFrame:
    """Five-line blocks of documents that hold a changed line."""
    blocks = split_units(table(spark, sf, "documents"), "doc_id", block_lines=5)
    units = number_units(
        blocks.select(F.col("doc_id").cast("string").alias("file_path"), "line_start", "line_end"), ("file_path", "line_start")
    )
    labels = table(spark, sf, "labels")
    path = F.col("doc_id").cast("string").alias("file_path")
    lines = labels.select(path, (1 + F.col("doc_id") * 7 % 12).cast("int").alias("line")).unionByName(
        labels.select(path, (3 + F.col("quality") * 20).cast("int").alias("line"))
    )
    return touched_units(units, lines).select("file_path", "line_start", "line_end")


# --- variants -----------------------------------------------------------------------------------------------------------

_CHANCE = "('0x' || substr(md5('42:' || module || ':' || variant_no || ':' || (i - 1)), 1, 8))::BIGINT % 100 < 20"
VARIANTS_SQL = f"""v AS (SELECT item_id AS module, text, unnest(range(0, 4))::INT AS variant_no FROM benchmark),
  variants AS (SELECT module, variant_no, CASE WHEN variant_no = 0 THEN text
    WHEN variant_no % 4 = 1 THEN array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN {_CHANCE} THEN w || '_' || variant_no ELSE w END), ' ')
    WHEN variant_no % 4 = 2 THEN array_to_string(list_filter(string_split(text, ' '), lambda w, i: NOT ({_CHANCE})), ' ')
    ELSE array_to_string(list_transform(list_sort(list_transform(string_split(text, chr(10)), lambda x, i:
      {{'h': md5('42:' || module || ':' || variant_no || ':' || (i - 1)), 'x': x}})), lambda o: o.x), chr(10)) END AS body FROM v)"""


def benchmark_variants(spark: SparkSession, sf: str) -> DataFrame:
    return make_variants(table(spark, sf, "benchmark"), "item_id", "text", n=3)


@query("make_variants", f"WITH {VARIANTS_SQL} SELECT * FROM variants")
def q_make_variants(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_variants(spark, sf)
