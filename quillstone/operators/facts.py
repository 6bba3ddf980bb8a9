"""Exact figures: picks, derived quarters, priority over concepts, differences, suggestions, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.figures import shown
from quillstone.functions.questions import metric_name, normalized_metric
from quillstone.functions.reference import ANNUAL_FORMS, DERIVED_METRICS, FACT_ID, FALLBACK_METRICS, FILING_URL, METRIC_CONCEPTS, NAMESPACES, QUARTER_FORMS, UNITS
from quillstone.session import saved


def metric_table(spark: SparkSession) -> DataFrame:
    """metric, concept, prio. Metrics whose name is a concept's are taken as given by the caller."""
    rows = [(m, c, i) for m, concepts in METRIC_CONCEPTS.items() for i, c in enumerate(concepts)]
    return spark.createDataFrame(rows, "metric string, concept string, prio int")


def _place(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), c).cast("int"), F.lit(0))


def preferred_units(facts: DataFrame) -> DataFrame:
    """The rows of each concept's first namespace, and there of its preferred unit, else of its first."""
    known = F.when(_place(F.col("unit"), UNITS) > 0, _place(F.col("unit"), UNITS)).otherwise(len(UNITS) + 1 + F.col("unit_at"))
    ranked = facts.filter(F.col("namespace").isin(*NAMESPACES)).withColumn("_choice", F.struct(_place(F.col("namespace"), NAMESPACES).alias("ns"), known.alias("unit")))
    best = F.min("_choice").over(W.partitionBy("cik", "concept"))
    return ranked.withColumn("_best", best).filter("_choice = _best").drop("_choice", "_best")


def _days() -> Column:
    return F.when(F.col("start").isNull(), 0).otherwise(F.datediff(F.to_date("end"), F.to_date("start")))


def values(facts: DataFrame) -> DataFrame:
    """One row for each cik, concept, fy and fp (FY, Q1 to Q4) that has a value.

    Annual: 350 to 380 days, or instant, in an annual form. Quarter: 80 to 100 days, or instant, in a
    quarterly form; else the year to date of 100 to 290 days, with a note. Fourth quarter: an instant is the
    year's end; else a fact of 80 to 100 days that ends with the year; else the year less nine months.
    Of several facts the latest end counts, then one that is no amendment, then the one filed first, then the
    first in the source. All picks of a year are made in one grouping, by the key that the units were chosen by.
    """
    rows = preferred_units(facts).withColumn("days", _days()).withColumn("base", F.split("form", "/")[0])
    rows = rows.withColumn("instant", F.every(F.col("start").isNull()).over(W.partitionBy("cik", "concept")))
    order = F.struct((-F.unix_date(F.to_date("end"))).alias("late"), F.contains("form", F.lit("/")).alias("amended"), "filed", "at")
    entry = F.struct("namespace", "label", "unit", "start", "end", "val", "form", "filed", "accn", "days", "instant")
    instant, days = F.col("instant"), F.col("days")
    annual = (F.col("fp") == "FY") & F.col("base").isin(*ANNUAL_FORMS) & (instant | days.between(350, 380))
    interim = F.col("base").isin(*QUARTER_FORMS)
    pick = lambda cond, name: F.min_by(entry, F.when(cond, order)).alias(name)
    quarters = [pick((F.col("fp") == q) & interim & (instant | days.between(80, 100)), f"quarter_{q}") for q in ("Q1", "Q2", "Q3")]
    to_date = [pick((F.col("fp") == q) & interim & ~instant & days.between(100, 290), f"to_date_{q}") for q in ("Q1", "Q2", "Q3")]
    nine = pick((F.col("fp") == "Q3") & interim & days.between(250, 290), "nine")
    # facts of a quarter's length that are tagged for the year: at most a few, of which those that end with it count
    tagged = F.collect_list(F.when((F.col("fp") == "FY") & days.between(80, 100), F.struct(order.alias("order"), entry.alias("entry")))).alias("tagged")
    years = rows.groupBy("cik", "concept", "fy").agg(pick(annual, "year"), *quarters, *to_date, nine, tagged)
    last = F.get(F.array_sort(F.filter("tagged", lambda x: x["entry"]["end"] == F.col("year.end"))), F.lit(0))["entry"]
    made = F.col("year").withField("val", F.col("year.val") - F.col("nine.val")).withField("start", F.col("nine.end"))
    one = lambda fp, kind, x: F.when(x.isNotNull(), F.struct(F.lit(fp).alias("fp"), F.lit(kind).alias("kind"), x.alias("x")))
    whole = F.col("year.instant")
    found = [one("FY", "annual", F.col("year"))]
    found += [F.coalesce(one(q, "quarter", F.col(f"quarter_{q}")), one(q, "to_date", F.col(f"to_date_{q}"))) for q in ("Q1", "Q2", "Q3")]
    found += [F.coalesce(one("Q4", "year_end", F.when(whole, F.col("year"))), one("Q4", "tagged", F.when(~whole, last)), one("Q4", "derived", F.when(~whole & F.col("nine").isNotNull(), made)))]
    out = years.select("cik", "concept", "fy", F.explode(F.array_compact(F.array(*found))).alias("f")).select("cik", "concept", "fy", "f.fp", "f.kind", "f.x.*")
    note = F.when(F.col("kind") == "to_date", F.concat(F.bround(F.col("days") / F.lit(30.4)).cast("int").cast("string"), F.lit(" months")))
    return out.select("cik", "concept", "fy", "fp", "namespace", "label", "unit", "start", "end", "val", "form", "filed", "accn", "kind", note.alias("note"))


def latest_years(found: DataFrame) -> DataFrame:
    """cik, concept, fy: the latest fiscal year that has an annual row."""
    return found.filter("fp = 'FY'").groupBy("cik", "concept").agg(F.max("fy").alias("fy"))


def fact_id(ticker: Column, namespace: Column, concept: Column, fp: Column, fy: Column) -> Column:
    return F.concat(F.lit("xbrl:"), ticker, F.lit(":"), namespace, F.lit(":"), concept, F.lit(":"), fp, fy.cast("string"))


def parsed_id(c: Column) -> Column:
    rx = f"^{FACT_ID}$"
    part = lambda i: F.regexp_extract(c, rx, i)
    concept = F.split(part(2), ":")
    return F.when(c.rlike(rx), F.struct(part(1).alias("ticker"), concept[0].alias("namespace"), concept[1].alias("concept"), part(3).alias("fp"), part(4).cast("int").alias("fy")))


# Fixed value: what the id of a difference of two figures looks like.
DERIVED_ID = r"^derived:(\d{1,18}):(.+):(FY|Q[1-4])(\d{4})$"


def values_of(cited: DataFrame, found: DataFrame, companies: DataFrame, metrics: DataFrame, recipes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """key, val of the cited ids (key) that name a figure: one that was reported, or a difference as `answers` gives it.

    companies: ticker, cik. The namespace of an id is read and, as published, not used. Ids that name nothing are absent.
    """
    recipes = recipes or DERIVED_METRICS | FALLBACK_METRICS
    found = saved(found)  # it is read five times below
    own = cited.select("key", parsed_id(F.col("key")).alias("x")).filter("x IS NOT NULL").select("key", "x.*")
    own = own.join(companies, "ticker").drop("namespace").join(found.select("cik", "concept", "fy", "fp", "val"), ["cik", "concept", "fy", "fp"])
    part = lambda i: F.regexp_extract("key", DERIVED_ID, i)
    derived = cited.filter(F.col("key").rlike(DERIVED_ID)).select("key", part(1).cast("long").alias("cik"), part(2).alias("metric"), part(3).alias("fp"), part(4).cast("int").alias("fy"))
    inputs = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for item in recipes.items() for x in item))
    asked = derived.select("cik", "fy", "fp", F.explode(inputs[F.col("metric")]).alias("metric")).distinct()
    asked = asked.withColumn("rid", F.concat_ws("|", "cik", "metric", "fp", "fy"))
    made = differences(saved(lookup(asked, found, metrics).filter("error IS NULL")), recipes).select(F.col("id").alias("key"), "val")
    return own.select("key", "val").unionByName(derived.select("key").distinct().join(made, "key"))


def lookup(requests: DataFrame, found: DataFrame, metrics: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Answer requests (rid, cik, metric, fy, fp; a null fy is the latest): the first concept with a value.

    found: the rows of `values`. Requests without a value come back with error set, as rows. For the latest
    year all candidate concepts count.
    """
    asked = requests.join(F.broadcast(metrics), "metric", "left").withColumn("concept", F.coalesce("concept", "metric")).withColumn("prio", F.coalesce("prio", F.lit(0)))
    newest = asked.join(latest_years(found).withColumnRenamed("fy", "_fy"), ["cik", "concept"]).groupBy("rid").agg(F.max("_fy").alias("_newest"))
    asked = asked.join(newest, "rid", "left").withColumn("fy", F.coalesce("fy", "_newest")).drop("_newest")
    hits = asked.join(found, ["cik", "concept", "fy", "fp"])
    first = F.row_number().over(W.partitionBy("rid").orderBy("prio"))
    best = hits.withColumn("_n", first).filter("_n = 1").drop("_n", "prio")
    missing = requests.join(best.select("rid"), "rid", "left_anti")
    years = found.filter("fp = 'FY'").groupBy("cik").agg(F.slice(F.sort_array(F.collect_set("fy"), asc=False), 1, 8).alias("_years"))
    missing = missing.join(years, "cik", "left")
    error = F.concat(F.lit("No value for "), F.col("metric"), F.lit(" in "), F.col("fp"), F.coalesce(F.col("fy").cast("string"), F.lit(" latest")), F.lit("; years with annual values: "), F.coalesce(F.array_join(F.col("_years").cast("array<string>"), ", "), F.lit("none")))
    out = best.withColumn("display", shown(F.col("val"), F.col("unit"))).withColumn("error", F.lit(None).cast("string"))
    return out.unionByName(missing.withColumn("error", error).drop("_years"), allowMissingColumns=True)


def differences(answers: DataFrame, recipes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """cik, fy, fp, metric, value, formula: the first metric less the size of the second, with its id."""
    recipes = recipes or DERIVED_METRICS | FALLBACK_METRICS
    good = answers.filter("error IS NULL")
    made = None
    for name, (first, second) in recipes.items():
        a = good.filter(F.col("metric") == first).select("cik", "fy", "fp", F.col("val").alias("a"), "unit")
        b = good.filter(F.col("metric") == second).select("cik", "fy", "fp", F.col("val").alias("b"))
        d = a.join(b, ["cik", "fy", "fp"]).withColumn("val", F.col("a") - F.abs("b"))
        formula = F.concat(F.lit(f"{first} "), shown(F.col("a"), F.col("unit")), F.lit(f" minus {second} "), shown(F.col("b"), F.col("unit")))
        d = d.select("cik", "fy", "fp", F.lit(name).alias("metric"), "val", "unit", formula.alias("formula"), F.concat(F.lit("derived:"), F.col("cik").cast("string"), F.lit(f":{name}:"), F.col("fp"), F.col("fy").cast("string")).alias("id"))
        made = d if made is None else made.unionByName(d)
    return made


def suggestions(requests: DataFrame, found: DataFrame, most: int = 8) -> DataFrame:
    """For each request the concepts whose name or label has its words, of those with a value for its period.

    Most words first, then the shortest name, then the name. A request without a year is offered all concepts
    of its company, without values.
    """
    words = F.filter(F.split(normalized_metric(F.col("metric")), " "), lambda w: F.length(w) > 2)
    asked = requests.select("rid", "cik", "fy", "fp", F.array_distinct(words).alias("words"))
    text = F.lower(F.concat_ws(" ", F.regexp_replace("concept", "([a-z])([A-Z])", "$1 $2"), F.col("label")))
    dated = asked.filter("fy IS NOT NULL").join(found, ["cik", "fy", "fp"]).select("rid", "words", "namespace", "concept", "label", shown(F.col("val"), F.col("unit")).alias("value"))
    ever = asked.filter("fy IS NULL").join(found.select("cik", "namespace", "concept", "label").dropDuplicates(["cik", "namespace", "concept"]), "cik")
    every = dated.unionByName(ever.select("rid", "words", "namespace", "concept", "label", F.lit(None).cast("string").alias("value")))
    pairs = every.withColumn("hits", F.size(F.filter("words", lambda w: F.contains(text, w)))).filter("hits > 0")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("hits"), F.length("concept"), "concept"))
    out = pairs.withColumn("rank", rank).filter(F.col("rank") <= most)
    return out.select("rid", "rank", F.concat_ws(":", "namespace", "concept").alias("concept"), F.coalesce("label", "concept").alias("label"), "value")


#: What an answer to one request consists of.
ANSWER = "concept string, label string, unit string, start string, end string, val double, form string, filed string, accn string, display string, note string, error string"


def answers(requests: DataFrame, found: DataFrame, metrics: DataFrame) -> DataFrame:
    """Figures for requests (rid, ticker, cik, metric, fy, fp; a null fy is the latest), one row each.

    A derived metric is its first input less the size of its second; so is a metric with a fallback that is
    not tagged itself. Both inputs come with it, with the formula. A figure has an id, a citation and its
    source; an error has suggestions.
    """
    recipes = DERIVED_METRICS | FALLBACK_METRICS
    recipe = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("first"), F.lit(x[1]).alias("second")) for item in recipes.items() for x in item))
    own = F.when(~F.col("metric").isin(*DERIVED_METRICS), F.struct(F.lit("own").alias("role"), F.col("metric").alias("metric")))
    inputs = [F.when(recipe[F.col("metric")].isNotNull(), F.struct(F.lit(r).alias("role"), recipe[F.col("metric")][r].alias("metric"))) for r in ("first", "second")]
    asked = requests.select(F.col("rid").alias("of"), "ticker", "cik", "fy", "fp", F.explode(F.array_compact(F.array(own, *inputs))).alias("x"))
    asked = asked.select(F.concat_ws("|", "of", "x.role").alias("rid"), "of", "x.role", "ticker", "cik", "x.metric", "fy", "fp")
    got = lookup(asked, found, metrics)
    filled = F.when(F.col("error").isNull(), fact_id(F.col("ticker"), F.col("namespace"), F.col("concept"), F.col("fp"), F.col("fy")))
    entry = F.struct("metric", "fy", "fp", *(c.split()[0] for c in ANSWER.split(", ")), filled.alias("id"))
    part = lambda r: F.first(F.when(F.col("role") == r, entry), ignorenulls=True).alias(r)
    out = requests.join(got.groupBy(F.col("of").alias("rid")).agg(part("own"), part("first"), part("second")), "rid", "left")
    tagged = F.col("own.val").isNotNull()
    made = ~tagged & F.col("first.val").isNotNull() & F.col("second.val").isNotNull()
    value = F.when(tagged, F.col("own.val")).when(made, F.col("first.val") - F.abs(F.col("second.val")))
    pick = lambda c: F.when(tagged, F.col(f"own.{c}")).when(made, F.col(f"first.{c}"))
    form, filed, accn, unit = (pick(c) for c in ("form", "filed", "accn", "unit"))
    formula = F.concat_ws(" ", "first.metric", "first.display", F.lit("minus"), "second.metric", "second.display")
    derived_id = F.concat(F.lit("derived:"), F.col("cik").cast("string"), F.lit(":"), F.col("metric"), F.lit(":"), F.col("fp"), F.col("first.fy").cast("string"))
    error = F.coalesce(F.col("own.error"), F.concat_ws("; ", "first.error", "second.error"))
    out = out.select(
        "rid", "ticker", "cik", "metric", F.coalesce(pick("fy"), F.col("fy")).alias("fy"), "fp",
        *(F.when(tagged, F.col(f"own.{c}")).alias(c) for c in ("concept", "label")), unit.alias("unit"), value.alias("val"), shown(value, unit).alias("display"),
        pick("start").alias("start"), pick("end").alias("end"), form.alias("form"), filed.alias("filed"), accn.alias("accn"),
        F.format_string(FILING_URL, F.col("cik").cast("string"), F.regexp_replace(accn, "-", "")).alias("url"),
        F.when(tagged | made, F.format_string("[%s %s %s]", "ticker", form, filed)).alias("citation"),
        F.when(tagged, F.col("own.id")).when(made, derived_id).alias("id"), pick("note").alias("note"),
        F.when(made, formula).alias("formula"), F.when(made, F.array("first", "second")).alias("inputs"), F.when(~(tagged | made), error).alias("error"),
    )
    out = out.withColumn("url", F.when(F.col("accn").isNotNull(), F.col("url")))
    offered = suggestions(out.filter("error IS NOT NULL"), found)
    offered = offered.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "concept", "label", "value"))), lambda x: x.dropFields("rank")).alias("suggestions"))
    return out.join(offered, "rid", "left")


def compared(answers: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each company and period, a column for each metric; a missing value is null."""
    return answers.groupBy("cik", "fy", "fp").pivot("metric", metrics).agg(F.first("val"))


def resolved(requests: DataFrame, strict: bool = False) -> DataFrame:
    return requests.withColumn("metric", metric_name(F.col("metric"), strict))
