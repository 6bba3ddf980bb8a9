"""Evaluation: hits and reciprocal ranks, evidence, three-way scores, failure buckets, precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.figures import covers, declines, evaluated_numbers, evidence_numbers, near, precision, states_truth
from quillstone.functions.questions import document_name
from quillstone.operators.verify import check_text

CUTS = (1, 5, 10, 20)


def hits(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """n, hit@k and the mean reciprocal rank of the first relevant result.

    ranked: qid, rank, relevant. Items without a relevant result count as missed.
    """
    first = ranked.filter("relevant").groupBy("qid").agg(F.min("rank").alias("first"))
    each = items.select("qid").join(first, "qid", "left")
    at = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}") for k in CUTS]
    return each.agg(F.count("*").alias("n"), *at, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def three_way(answers: DataFrame) -> DataFrame:
    """Right, wrong and refused over answers whose truth has a number, and refusals over all.

    answers: answer, truth, calls.
    """
    refused = (F.trim("answer") == "") | declines(F.col("answer"))
    a = answers.withColumn("_v", states_truth(F.col("answer"), F.col("truth"))).withColumn("_r", refused)
    scorable = F.col("_v").isNotNull()
    right, wrong = scorable & ~F.col("_r") & F.col("_v"), scorable & ~F.col("_r") & ~F.col("_v")
    n = a.agg(
        F.count("*").alias("n"), F.count_if(scorable).alias("scorable"), F.count_if(right).alias("right_answers"), F.count_if(wrong).alias("wrong_answers"),
        F.count_if(scorable & F.col("_r")).alias("refused"), F.count_if("_r").alias("refused_all"), F.round(F.avg("calls"), 2).alias("avg_calls"),
    )
    return n.withColumn("right_when_answering", F.round(F.try_divide(F.col("right_answers").cast("double"), (F.col("right_answers") + F.col("wrong_answers")).cast("double")), 3))


def bucket(in_scope: Column, has_filing: Column, answer: Column, truth: Column, contexts: Column) -> Column:
    """The kind of success or failure of one answer. A refusal is never correct."""
    verdict, refused = states_truth(answer, truth), declines(answer)
    wanted, seen = evaluated_numbers(truth, 1.5), evaluated_numbers(contexts, 1.5)
    held = F.exists(wanted, lambda t: F.exists(seen, lambda s: near(s, t, 0.02)))
    return (
        F.when(~in_scope, "out_of_scope").when(~has_filing, "no_filing_in_corpus").when(verdict.isNull(), "no_numeric_truth").when(verdict & ~refused, "correct")
        .when(refused & held, "refused_data_in_ctx").when(refused, "refused_retrieval").when(held, "wrong_in_ctx").otherwise("wrong_retrieval")
    )


def filing_years(cover: DataFrame) -> DataFrame:
    """ticker, form, years: the years of filing of each form."""
    return cover.groupBy("ticker", "form").agg(F.sort_array(F.collect_set(F.substring("filed", 1, 4).cast("int"))).alias("years"))


def has_filing(wanted: DataFrame, cover: DataFrame) -> DataFrame:
    """wanted (ticker, form, year) with has_filing: an annual report may be two years later, others one."""
    later = F.when(F.col("form") == "10-K", 2).otherwise(1)
    joined = wanted.join(filing_years(cover), ["ticker", "form"], "left")
    return joined.withColumn("has_filing", F.coalesce(F.exists("years", lambda y: y.between(F.col("year"), F.col("year") + later)), F.lit(False))).drop("years")


def numeric_precision(answers: DataFrame, by: list[str]) -> DataFrame:
    """The mean share of an answer's numbers that its contexts hold, split by refusal. answers: answer, contexts."""
    share = precision(evaluated_numbers(F.col("answer")), evaluated_numbers(F.col("contexts")))
    a = answers.withColumn("_p", share).withColumn("_r", declines(F.col("answer")))
    return a.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("_r").cast("double")), 6).alias("refusal_rate"), F.round(F.avg("_p"), 6).alias("precision_all"),
        F.round(F.avg(F.when(~F.col("_r"), F.col("_p"))), 6).alias("precision_answered"), F.round(F.avg(F.when(F.col("_r"), F.col("_p"))), 6).alias("precision_refused"),
    )


def metric_means(scores: DataFrame, names: list[str]) -> DataFrame:
    """Means that leave out missing and NaN scores, with the number scored."""
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return scores.agg(*(F.round(F.avg(value(c)), 6).alias(c) for c in names), *(F.count(value(c)).alias(f"{c}_scored") for c in names), F.count("*").alias("n"))


def summary(answers: DataFrame) -> DataFrame:
    """One row over answers (answer, truth, sources): refusals, true and wrong numbers, and how many state no figure that the sources lack."""
    verdict, refused = states_truth(F.col("answer"), F.col("truth")), declines(F.col("answer"))
    a = check_text(answers).withColumns({"_v": verdict, "_r": refused, "_missing": F.size("not_found")})
    return a.agg(
        F.count("*").alias("n"), F.count_if("_r").alias("refused"), F.count("_v").alias("scorable"), F.count_if("_v").alias("true_numbers"),
        F.round(F.coalesce(F.avg(F.col("_v").cast("double")), F.lit(0.0)), 6).alias("true_rate"),
        F.count_if(F.col("_v") & ~F.col("_r")).alias("true_in_answers"), F.count_if(~F.col("_v") & ~F.col("_r")).alias("wrong_in_answers"),
        F.count_if(F.col("_missing") == 0).alias("zero_not_found"), F.round(F.avg((F.col("_missing") == 0).cast("double")), 6).alias("share_zero_not_found"), F.sum("_missing").alias("total_not_found"),
    )


def scorable(questions: DataFrame, cover: DataFrame) -> DataFrame:
    """The questions (ticker, form, year, truth) about a filing that is held, with a number in their truth."""
    held = has_filing(questions, cover).filter("has_filing").drop("has_filing")
    return held.filter(F.size(evaluated_numbers(F.col("truth"), 1.5)) > 0)


def with_evidence(questions: DataFrame, documents: DataFrame, cover: DataFrame) -> DataFrame:
    """The questions about a filing that is held, with the evidence (array of texts) that the benchmark gives for them."""
    held = has_filing(questions, cover).filter("has_filing").drop("has_filing")
    return held.join(documents.select("question", "evidence").dropDuplicates(["question"]), "question").filter(F.size("evidence") > 0)


def evidence_hits(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """n and hit@k: whether one of the first k chunks (qid, rank, text) holds the numbers of an item's evidence (qid, evidence)."""
    wanted = evidence_numbers(F.flatten(F.transform("evidence", lambda e: evaluated_numbers(e))))
    each = ranked.join(items.select("qid", wanted.alias("_wanted")), "qid")
    relevant = each.select("qid", "rank", covers(evidence_numbers(evaluated_numbers(F.col("text"))), F.col("_wanted")).alias("relevant"))
    return hits(relevant, items).drop("mrr")


def by_ticker(names: DataFrame) -> DataFrame:
    """ticker and its wanted filings (year, quarter, form), of document names (name, ticker); other names are left out."""
    parsed = names.select("ticker", document_name(F.col("name")).alias("d")).filter("d.form IS NOT NULL")
    return parsed.groupBy("ticker").agg(F.sort_array(F.collect_set("d")).alias("wanted"))
