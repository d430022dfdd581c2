"""The numbered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, found, mixing, ngram_join, personal_data, secret_scan
from .context_tree import context_tree_scores
from .decontaminate import benchmark_leaks
from .exact_dedup import content_sort_dedup
from .fitting import remainder
from .mixing import pareto_mixture
from .ngram_join import jaccard_groups
from .quality import fit_quality, quality_scores
from .stash import documents
from .token_counts import section_tokens
from .toxicity import fit_toxicity, toxicity_scores


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_groups(documents(spark, sf_dir))


def op2_context_tree_weighting(spark, sf_dir):
    return context_tree_scores(documents(spark, sf_dir), remainder("doc_id", 7) == 2)


def op3_toxicity_grammar(spark, sf_dir):
    docs = documents(spark, sf_dir)
    grammar = fit_toxicity(docs, _labels(spark, sf_dir), remainder("doc_id", 3) != 1)
    scores = toxicity_scores(docs, grammar, toxic=0.7)
    return scores.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))


def _digests(rows, kinds, base_kinds):
    columns = {f"n_{k}": found.count(F.col("base"), k) for k in base_kinds}
    columns["base_sha256"] = F.sha2(found.listing(F.col("base"), base_kinds), 256)
    columns["spans"] = found.listing(F.concat("base", "added"), kinds)
    return rows.select("doc_id", *(c.alias(name) for name, c in columns.items()))


def op4_benchmark_decontamination(spark, sf_dir):
    return benchmark_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = secret_scan.secret_spans(docs, secret_scan.corpus_identifiers(docs))
    return _digests(rows, secret_scan.KINDS, secret_scan.BASE_KINDS)


def op6_pareto_mixture(spark, sf_dir):
    return pareto_mixture(documents(spark, sf_dir), affinity=mixing.DIGITS)


def op7_section_tokens(spark, sf_dir):
    return section_tokens(documents(spark, sf_dir), rule="start")


def op8_pairwise_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, _labels(spark, sf_dir), remainder("doc_id", 5) != 0)
    scores = quality_scores(docs, model, accept=0.3)
    return scores.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))


def op9_content_sort_dedup(spark, sf_dir):
    return content_sort_dedup(documents(spark, sf_dir), keep="largest")


def op10_personal_data(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = personal_data.personal_spans(docs, personal_data.fit_judge(docs))
    return _digests(rows, personal_data.KINDS, personal_data.KINDS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_context_tree_weighting, op3_toxicity_grammar, op4_benchmark_decontamination, op5_secret_scan, op6_pareto_mixture,
        op7_section_tokens, op8_pairwise_quality, op9_content_sort_dedup, op10_personal_data,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_pareto_mixture": mixing.ORACLE,
    "op9_content_sort_dedup": exact_dedup.ORACLE,
}
