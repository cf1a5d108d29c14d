"""Budgets against a plain water-filling, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import classes, slow_fingerprint
from twinseek.llm import source_mixing
from twinseek.llm.queries import ORACLES, QUERIES
from twinseek.session import materialize

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, epoch int"


def fill(budget, children):
    """children: name -> (supply, weight); gives what is short its supply, again and again."""
    given, left = {}, dict(children)
    while left:
        weight = sum(w for _, w in left.values())
        short = [n for n, (supply, w) in left.items() if w and supply * weight <= budget * w]
        if not short:
            return given | {n: budget * w // weight if weight else 0 for n, (_, w) in left.items()}
        first = min(short, key=lambda n: (left[n][0] / left[n][1], n))
        given[first] = left.pop(first)[0]
        budget -= given[first]
    return given


def rows():
    rng = random.Random(8)
    out = []
    for i in range(400):
        source = rng.choice(["a"] * 6 + ["b", "c", "d", None])
        out.append((i, "w " * rng.randint(0, 60), rng.choice(["en", "en", "de", None]), source))
    return [*out, (7, None, "en", "a"), (None, "x y z", "fr", "a"), (5, out[5][1], out[5][2], out[5][3])]


@pytest.mark.parametrize(("tokens", "epochs"), [(3000, 1), (9000, 2), (50_000, 3), (0, 1)])
def test_mix(spark, tokens, epochs):
    data = rows()
    frame = spark.createDataFrame([(r[0], r[1], r[2], r[3], 1, "x", 5) for r in data], DOCS).repartition(4)
    levels = [("lang", F.coalesce("lang", F.lit("")), F.when(F.col("lang") == "en", 3).otherwise(1)), ("source", F.coalesce("source", F.lit("")), F.lit(2))]
    got = source_mixing.mix(frame, levels, tokens=tokens, max_epochs=epochs).collect()
    leaves = defaultdict(list)
    for r in data:
        leaves[r[2] or "", r[3] or ""].append((r[0], len((r[1] or "").split())))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    langs = fill(tokens, {x: (epochs * sum(n for (a, _), n in size.items() if a == x), 3 if x == "en" else 1) for x in {a for a, _ in leaves}})
    want = Counter()
    for x, budget in langs.items():
        for s, part in fill(budget, {s: (epochs * n, 2) for (a, s), n in size.items() if a == x}).items():
            docs, total = leaves[x, s], size[x, s]
            full = part // total if total else 0
            if not total:
                continue
            docs = sorted(docs, key=lambda d: (hashlib.md5(f"17:{full + 1}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[1]))
            running = 0
            for doc, n in docs:
                running += n
                copies = full + (running <= part - full * total) if part else 0
                for e in range(copies):
                    want[doc, x, s, n, e + 1] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, r.epoch) for r in got) == want
    carried = source_mixing.mix(frame, levels, tokens=tokens, max_epochs=epochs, carry=True)
    assert carried.columns == frame.columns
    assert Counter(r.doc_id for r in carried.collect()) == Counter(r.doc_id for r in got)


def test_mix_by_nullable_columns(spark):
    """Levels that are plain columns: documents without a name are a leaf of their own, called ''."""
    frame = spark.createDataFrame([(i, "a b", [None, "en", "de"][i % 3], [None, "s"][i % 2], 1, "x", 5) for i in range(60)], DOCS)
    levels = [("lang", F.col("lang"), F.lit(1)), ("source", F.col("source"), F.lit(1))]
    got = source_mixing.mix(frame, levels, tokens=120, max_epochs=1).collect()
    assert Counter((r.lang, r.source) for r in got) == {(x, y): 10 for x in ("", "en", "de") for y in ("", "s")}
    carried = source_mixing.mix(frame, levels, tokens=120, max_epochs=1, carry=True)
    assert Counter(carried.collect()) == Counter(frame.collect())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert source_mixing.mix(empty).count() == 0 and source_mixing.mix(empty, carry=True).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    lines = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert lines(got) == lines(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    """Each stage keeps the columns, works on what it gets, and takes effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None), (9002, ""), (9003, "12 34"), (9004, docs.first().text), (None, docs.first().text + " x"), (9005, "the " * 40_000)]
    more = spark.createDataFrame([(i, t, "en", None, None) for i, t in extra], docs.schema)
    docs = docs.unionByName(more).withColumn("id", F.lit("x")).withColumn("run", F.lit(1)).withColumn("fp", F.lit(2))
    names = docs.columns
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(materialize(stage(spark, kept[-1], SF), "test-stage"))
        if i < 4:
            assert kept[-1].columns == names
    language, exact, near, mixed = (k.collect() for k in kept[1:5])
    assert {r.doc_id for r in language}.isdisjoint({9001, 9002, 9003}) and len(language) >= docs.count() - 6
    texts = Counter(r.text for r in exact)
    assert set(texts.values()) == {1} and set(texts) == {r.text for r in language}
    label = classes({slow_fingerprint(r.text) for r in exact})
    assert Counter(label[slow_fingerprint(r.text)] for r in near) == Counter(set(label.values()))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and len(mixed) < len(near)
    last = kept[5].collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(r.doc_id) for r in mixed)
    whole = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mixed}
    assert all(r.decoded_sha256 == whole[r.doc_id] and r.n_tokens == len(r.ids) for r in last)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


def test_pipeline_query(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
