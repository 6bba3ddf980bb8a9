"""Documents of companies as a Python data source: a partition for each company, bounded retries, errors as rows.

    register(spark)
    spark.read.format("company_documents").option("path", folder).option("tickers", "MMM,AAPL").load()
    spark.readStream.format("company_listings").option("path", folder).load()

Folders may be on any file system that pyarrow reads and that all executors see. There is no network here: a
folder of `ticker.json` files stands for a service that is asked for one company at a time.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

TRIES, FIRST_WAIT, LONGEST_WAIT = 5, 2.0, 60.0


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def fetched(read, tries: int = TRIES, wait: float = FIRST_WAIT, sleep=time.sleep) -> tuple[bytes | None, int, str | None]:
    """What read gives, after how many tries, and why not.

    A missing document is final; other failures of the source are tried again, with twice the wait each time.
    """
    for n in range(1, tries + 1):
        try:
            return read(), n, None
        except FileNotFoundError:
            return None, n, "not found"
        except OSError as error:
            if n == tries:
                return None, n, f"{type(error).__name__}: {error}"
            sleep(min(wait * 2 ** (n - 1), LONGEST_WAIT))
    return None, 0, "not asked"


class Company(InputPartition):
    def __init__(self, ticker: str):
        self.ticker = ticker


class _Documents(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tries, self.wait = options["path"], int(options.get("tries", TRIES)), float(options.get("wait", FIRST_WAIT))
        self.tickers = list(dict.fromkeys(t.strip().upper() for t in options["tickers"].split(",") if t.strip()))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the ticker choose partitions, so that no other company is asked for."""
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) and f.attribute == ("ticker",) else list(f.value) if isinstance(f, In) and f.attribute == ("ticker",) else None
            if wanted is None:
                yield f
            else:
                self.tickers = [t for t in self.tickers if t in wanted]

    def partitions(self) -> list[InputPartition]:
        return [Company(t) for t in self.tickers] or [Company("")]

    def read(self, partition: Company) -> Iterator[tuple]:
        if not partition.ticker:
            return
        files, path = _opened(self.path)

        def document() -> bytes:
            with files.open_input_stream(f"{path}/{partition.ticker}.json") as stream:
                return stream.readall()

        body, tries, error = fetched(document, self.tries, self.wait)
        yield partition.ticker, body.decode("utf-8", "replace") if body is not None else None, tries, error


class CompanyDocuments(DataSource):
    """ticker, body, tries, error: one row for each company asked for, whether it has a document or not."""

    @classmethod
    def name(cls) -> str:
        return "company_documents"

    def schema(self) -> str:
        return "ticker string, body string, tries int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options)


class _Listings(SimpleDataSourceStreamReader):
    """The files of a folder in the order of their names, which grow; the offset is the last name that was read."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"after": ""}

    def _rows(self, after: str, until: str | None) -> list[tuple[str, str]]:
        from pyarrow import fs

        files, path = _opened(self.path)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.is_file and i.base_name.endswith(".json"))
        out = []
        for name in names:
            if name > after and (until is None or name <= until):
                with files.open_input_stream(f"{path}/{name}") as stream:
                    out.append((name, stream.readall().decode("utf-8", "replace")))
        return out

    def read(self, start: dict):
        rows = self._rows(start["after"], None)
        return iter(rows), {"after": rows[-1][0] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start["after"], end["after"]))


class CompanyListings(DataSource):
    """name, body of new files as they appear."""

    @classmethod
    def name(cls) -> str:
        return "company_listings"

    def schema(self) -> str:
        return "name string, body string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Listings(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanyDocuments)
    spark.dataSource.register(CompanyListings)


def documents(spark: SparkSession, path: str, tickers: list[str], **options) -> DataFrame:
    """ticker, body, tries, error of the companies, each asked for in a task of its own."""
    register(spark)
    return spark.read.format("company_documents").options(path=path, tickers=",".join(tickers), **options).load()


def company_facts(documents: DataFrame, ciks: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """From documents and companies (ticker, cik): the parsed documents (ticker, cik, doc), and an error row (ticker, error)
    for each company that is unknown, has no document, or has one that is not JSON of the schema."""
    doc = F.from_json("body", schema)
    read = documents.join(ciks, "ticker", "left").select("ticker", "cik", "body", "error", doc.alias("doc"))
    known = F.when(F.col("cik").isNull(), F.lit("unknown company")).otherwise(F.coalesce("error", F.when(F.to_json("doc").isNull() | (F.to_json("doc") == "{}"), F.lit("not a document of facts"))))
    read = read.withColumn("why", known)
    return read.filter("why IS NULL").select("ticker", "cik", "doc"), read.filter("why IS NOT NULL").select("ticker", F.col("why").alias("error"))
