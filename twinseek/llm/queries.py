"""The queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm import byte_bpe, decontamination, importance_resampling, language_id, source_mixing, spelling_variants, sql
from twinseek.llm.chat_format import chat_examples
from twinseek.llm.common import held_out
from twinseek.llm.embedding_dedup import embedding_groups
from twinseek.llm.exact_dedup import exact_groups
from twinseek.llm.html_extraction import main_texts
from twinseek.llm.quality_classifier import quality_scores
from twinseek.llm.simhash_dedup import simhash_groups
from twinseek.llm.substring_dedup import repeat_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query(
    "op1_embedding_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
      reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
      low AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
      vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
    FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
)
def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_groups(table(spark, sf, "embeddings"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeat_digests(table(spark, sf, "documents"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op4_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(table(spark, sf, "documents"), keep="max")


@query(
    "op5_chat_format",
    """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
      h AS (SELECT conv_id, pos, n, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS h FROM t),
      whole AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS copies FROM h WHERE pos = n GROUP BY n, h),
      kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos < h.n AND h.pos = w.n AND h.h = w.h))
    SELECT k.conv_id, k.n AS n_turns, k.copies, string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
    FROM kept k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL""",
)
def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    return chat_examples(table(spark, sf, "conversations"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return main_texts(table(spark, sf, "pages"))


def _fill_sql(level: str, parents: list[str], nodes: str) -> str:
    """One level of budgets: the same integer arithmetic as the operator's."""
    family = f"PARTITION BY {', '.join(parents)}" if parents else ""
    path = ", ".join([*parents, level])
    return f"""{level}_a AS (SELECT *, CASE WHEN w > 0 THEN supply::DOUBLE / w::DOUBLE END AS ratio FROM ({nodes})),
      {level}_b AS (SELECT *, sum(supply::HUGEINT) OVER o - supply AS before, sum(w::HUGEINT) OVER f - sum(w::HUGEINT) OVER o + w AS w_left,
        budget - (sum(supply::HUGEINT) OVER o - supply) AS lft, row_number() OVER o AS rnk
        FROM {level}_a WINDOW f AS ({family}), o AS ({family} ORDER BY ratio ASC NULLS LAST, {level} ROWS UNBOUNDED PRECEDING)),
      {level}_c AS (SELECT *, min(CASE WHEN NOT (w > 0 AND supply::HUGEINT * w_left <= lft * w) THEN rnk END) OVER ({family}) AS fst FROM {level}_b),
      {level}_d AS (SELECT *, max(CASE WHEN rnk = fst THEN lft END) OVER ({family}) AS rest, max(CASE WHEN rnk = fst THEN w_left END) OVER ({family}) AS w_rest
        FROM {level}_c),
      {level}_e AS (SELECT {path}, greatest(0, CASE WHEN fst IS NULL OR rnk < fst THEN supply
        WHEN w_rest > 0 THEN least(rest * w // w_rest, supply) ELSE 0 END)::BIGINT AS budget FROM {level}_d)"""


MIX_SQL = f"""WITH counted AS (SELECT doc_id, 'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 6))::BIGINT % 4) AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens FROM documents),
      leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM counted GROUP BY ALL),
      {_fill_sql("domain", [], "SELECT domain, sum(tokens) * 4 AS supply, 1 AS w, (SELECT sum(tokens) * 4 // 5 FROM leaves) AS budget FROM leaves GROUP BY domain")},
      {_fill_sql("lang", ["domain"], "SELECT domain, lang, sum(tokens) * 4 AS supply, CASE lang WHEN 'en' THEN 2 ELSE 1 END AS w, any_value(budget) AS budget FROM leaves JOIN domain_e USING (domain) GROUP BY ALL")},
      {_fill_sql("source", ["domain", "lang"], "SELECT domain, lang, source, sum(tokens) * 4 AS supply, 1 AS w, any_value(budget) AS budget FROM leaves JOIN lang_e USING (domain, lang) GROUP BY ALL")},
      plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs FROM leaves JOIN source_e USING (domain, lang, source)),
      running AS (SELECT c.*, full_epochs, budget - full_epochs * tokens AS part, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('17:' || (full_epochs + 1) || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM counted c JOIN plan USING (domain, lang, source)),
      picked AS (SELECT *, full_epochs + CASE WHEN upto <= part THEN 1 ELSE 0 END AS copies FROM running WHERE full_epochs > 0 OR part > 0)
    SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, (copies + 1)::BIGINT)) AS epoch FROM picked"""


@query("op8_source_mixing", MIX_SQL)
def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf, "documents"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_simhash_dedup")
def op9_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(table(spark, sf, "documents"))


@query("op11_importance_resampling", sql.RESAMPLING)
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_benchmark_decontamination", sql.DECONTAMINATION)
def op12_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("spans")


@query("op13_spelling_variants", sql.VARIANTS)
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf, "documents"), slips=199)
