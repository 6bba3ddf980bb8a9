"""Sources: listings, filings, company facts, and the stand-ins that the driver's tables offer for them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One page of a company's submissions: parallel arrays.
SUBMISSIONS = T.StructType(
    [T.StructField("cik", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("form", "reportDate", "filingDate", "accessionNumber", "primaryDocument")]
)
FACT = "struct<start:string,end:string,val:double,fy:int,fp:string,form:string,filed:string,accn:string>"
#: A company's facts: namespace -> concept -> label and units -> rows. The keys are data, so maps and no inference.
COMPANY_FACTS = f"cik long, facts map<string,map<string,struct<label:string,units:map<string,array<{FACT}>>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPANY_FACTS).json(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).json(path)


def flat_facts(companies: DataFrame) -> DataFrame:
    """One row for each fact, with the place of its unit in the source as the order for ties."""
    spaces = companies.select("cik", F.explode(F.map_entries("facts")).alias("s"))
    concepts = spaces.select("cik", F.col("s.key").alias("namespace"), F.explode(F.map_entries("s.value")).alias("c"))
    units = concepts.select("cik", "namespace", F.col("c.key").alias("concept"), F.col("c.value.label").alias("label"), F.posexplode(F.map_entries("c.value.units")).alias("unit_at", "u"))
    rows = units.select("cik", "namespace", "concept", "label", "unit_at", F.col("u.key").alias("unit"), F.posexplode("u.value").alias("at", "f"))
    return rows.select("cik", "namespace", "concept", "label", "unit", "unit_at", "at", "f.*")


def listing(pages: DataFrame) -> DataFrame:
    """Rows of submissions pages, in the order of the pages' `page` column and of their arrays."""
    fields = ["form", "reportDate", "filingDate", "accessionNumber", "primaryDocument"]
    rows = pages.select("cik", "page", F.posexplode(F.arrays_zip(*fields)).alias("at", "r"))
    return rows.select("cik", "page", "at", F.col("r.form").alias("form"), F.col("r.reportDate").alias("report_date"), F.col("r.filingDate").alias("filed"), F.col("r.accessionNumber").alias("accession"), F.col("r.primaryDocument").alias("document"))


def first_per_form(rows: DataFrame, limits: dict[str, int], by: str = "cik", order: tuple[str, ...] = ("page", "at")) -> DataFrame:
    """The first rows of each form, as many as its limit; forms without a limit go."""
    from pyspark.sql import Window as W

    bound = F.create_map(*(F.lit(x) for item in limits.items() for x in item))
    rank = F.row_number().over(W.partitionBy(by, "form").orderBy(*order))
    return rows.filter(F.col("form").isin(*limits)).withColumn("nth", rank).filter(F.col("nth") <= bound[F.col("form")])


def company_numbers(wanted: DataFrame, live: DataFrame, overrides: DataFrame) -> DataFrame:
    """ticker -> cik, case aside: the live map first, then the overrides; null if neither has it."""
    key = F.upper("ticker")
    live = live.groupBy(key.alias("k")).agg(F.first("cik").alias("live"))
    fixed = overrides.groupBy(key.alias("k")).agg(F.first("cik").alias("fixed"))
    out = wanted.withColumn("k", key).join(live, "k", "left").join(fixed, "k", "left")
    return out.select(*wanted.columns, F.coalesce("live", "fixed").alias("cik"))


#: A company's first page of submissions: the recent filings, and the names of the pages with older ones.
FIRST_PAGE = T.StructType([T.StructField("cik", T.LongType()), T.StructField("filings", T.StructType([T.StructField("recent", T.StructType(SUBMISSIONS.fields[1:])), T.StructField("files", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))]))])


def full_history(spark: SparkSession, first: str, older: str) -> DataFrame:
    """Pages of submissions with their order: each company's recent filings, then its older pages as they are listed.

    first, older: paths of JSON files; an older page is found by its file's name.
    """
    firsts = spark.read.schema(FIRST_PAGE).json(first)
    recent = firsts.select("cik", F.lit(0).alias("page"), "filings.recent.*")
    listed = firsts.select("cik", F.posexplode("filings.files").alias("page", "f")).select("cik", (F.col("page") + 1).alias("page"), F.col("f.name").alias("name"))
    pages = spark.read.schema(T.StructType(SUBMISSIONS.fields[1:])).json(older).withColumn("name", F.substring_index(F.input_file_name(), "/", -1))
    return recent.unionByName(listed.join(pages, "name").drop("name"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, html of every file below a folder, read as it is."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("html"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Raw documents in folders of ticker, form and date; those of a folder that is written again are replaced."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker", "form", "filed").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A company's chunks replace those it had; other companies' stay. Written only once all of it has been made."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The six columns that an index is made of."""
    return spark.read.parquet(path).select("chunk_id", "text", "ticker", "form", "filed", "chunk_type")


def seeded(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """The wanted companies (ticker) without those that a broken-off seed has already written."""
    try:
        held = spark.read.parquet(path).select("ticker").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return wanted
    return wanted.join(held, "ticker", "left_anti")


def read_benchmark(spark: SparkSession, path: str, most: int = 150) -> DataFrame:
    """The first questions of a benchmark file (one JSON object a line) with their truth, company, form and period."""
    rows = spark.read.schema("question string, answer string, company string, doc_type string, doc_period string").json(path)
    named = [F.col("question"), F.col("answer").alias("ground_truth"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("company", "ticker"), ("doc_type", "filing_type"), ("doc_period", "period")))]
    return rows.select(*named).limit(most)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """question, doc_name, company, evidence (the texts) and ground_truth of every row of a benchmark file."""
    rows = spark.read.schema("question string, doc_name string, company string, evidence array<struct<evidence_text:string>>, answer string").json(path)
    texts = F.coalesce(F.transform("evidence", lambda e: F.coalesce(e["evidence_text"], F.lit(""))), F.array().cast("array<string>"))
    return rows.filter("question IS NOT NULL").select("question", "doc_name", "company", texts.alias("evidence"), F.col("answer").alias("ground_truth"))


# Stand-ins on the driver's tables.


def filed_on(doc_id: Column) -> Column:
    return F.date_add(F.lit("2015-01-01").cast("date"), (doc_id % 3650).cast("int")).cast("string")


def form_of(lang: Column) -> Column:
    return F.when(lang == "en", "10-K").when(lang == "de", "10-Q").otherwise("8-K")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as filings: doc_id, ticker, form, filed, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("ticker"), form_of(F.col("lang")).alias("form"), filed_on(F.col("doc_id")).alias("filed"), "text")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tagged facts: one fact for each order."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    month = F.month("o_orderdate")
    fp = F.when(month <= 3, "Q1").when(month <= 6, "Q2").when(month <= 9, "Q3").otherwise("FY")
    days = F.when(F.col("o_orderkey") % 7 == 0, None).when(fp == "FY", 364).when((fp == "Q3") & (F.col("o_orderkey") % 3 == 0), 272).when(F.col("o_orderkey") % 5 == 0, 200).otherwise(91)
    base = F.when(fp == "FY", "10-K").otherwise("10-Q")
    return o.select(
        F.col("o_custkey").alias("cik"),
        F.lit("us-gaap").alias("namespace"),
        F.substring("o_orderpriority", 3, 20).alias("concept"),
        F.concat(F.lit("Total of "), F.lower(F.substring("o_orderpriority", 3, 20))).alias("label"),
        F.lit("USD").alias("unit"),
        F.lit(0).alias("unit_at"),
        F.col("o_orderkey").alias("at"),
        F.date_sub(day, days).cast("string").alias("start"),
        day.cast("string").alias("end"),
        F.col("o_totalprice").alias("val"),
        F.year("o_orderdate").alias("fy"),
        fp.alias("fp"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(base, F.lit("/A"))).otherwise(base).alias("form"),
        F.date_add(day, (F.col("o_orderkey") % 120).cast("int")).cast("string").alias("filed"),
        F.col("o_orderkey").cast("string").alias("accn"),
    )
