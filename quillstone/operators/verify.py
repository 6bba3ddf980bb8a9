"""Checking the figures of an answer against passages and exact facts."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.figures import FIGURE, figures, grounded, not_grounded, source_values, states_any
from quillstone.functions.reference import REDACTED


def check_text(answers: DataFrame) -> DataFrame:
    """answers (id, answer, sources: array of texts): the figures found in the sources and those not."""
    out = answers.withColumn("_f", figures(F.col("answer"))).withColumn("_v", source_values(F.array_join("sources", " ")))
    return out.withColumn("grounded", grounded(F.col("_f"), F.col("_v"))).withColumn("not_found", not_grounded(F.col("_f"), F.col("_v"))).drop("_f", "_v")


def check_values(answers: DataFrame) -> DataFrame:
    """answers (id, answer, values: array of doubles): the figures that state a value and those that do not."""
    out = answers.withColumn("_f", figures(F.col("answer")))
    hit = F.filter("_f", lambda f: states_any(f, F.col("values")))
    miss = F.filter("_f", lambda f: ~states_any(f, F.col("values")))
    return out.withColumn("grounded", hit).withColumn("not_found", miss).drop("_f")


def combined(answers: DataFrame, passages: DataFrame, facts: DataFrame) -> DataFrame:
    """answers (id, answer, ids) against the passages (key, text) and facts (key, val) that it cites.

    A figure is good if a cited passage holds its magnitude or a cited fact states it; the verdict is by the
    figure's text. Unknown ids are listed.
    """
    cited = answers.select("id", F.explode_outer("ids").alias("key"))
    cited = cited.join(passages.select("key", "text"), "key", "left").join(facts.select("key", "val"), "key", "left")
    held = cited.groupBy("id").agg(
        F.array_join(F.collect_list("text"), " ").alias("_text"), F.collect_list("val").alias("_vals"),
        F.sort_array(F.collect_set(F.when(F.col("text").isNull() & F.col("val").isNull(), F.col("key")))).alias("unknown_ids"),
        F.count(F.when(F.col("text").isNotNull() | F.col("val").isNotNull(), 1)).alias("checked_against"),
    )
    out = answers.join(held, "id").withColumn("_f", figures(F.col("answer"))).withColumn("_v", source_values(F.col("_text")))
    out = out.withColumn("_ok", F.array_union(grounded(F.col("_f"), F.col("_v")), F.filter("_f", lambda f: states_any(f, F.col("_vals")))))
    good = F.filter("_f", lambda f: F.array_contains("_ok", f))
    bad = F.filter("_f", lambda f: ~F.array_contains("_ok", f))
    return out.select("id", good.alias("grounded"), bad.alias("not_found"), "unknown_ids", "checked_against")




def redacted(answers: DataFrame) -> DataFrame:
    """Replace every figure that the sources lack, each at its own place.

    A figure's text may be part of another's, so the text is split at figures and put together again.
    """
    pattern = FIGURE
    out = answers.withColumn("_f", figures(F.col("answer"))).withColumn("_v", source_values(F.array_join("sources", " ")))
    out = out.withColumn("_gaps", F.split("answer", pattern, -1))
    kept = F.transform("_f", lambda f: F.when(F.size(grounded(F.array(f), F.col("_v"))) > 0, f).otherwise(F.lit(REDACTED)))
    text = F.array_join(F.zip_with("_gaps", kept, lambda g, f: F.concat(g, F.coalesce(f, F.lit("")))), "")
    return out.withColumn("redacted", text).drop("_f", "_v", "_gaps")
