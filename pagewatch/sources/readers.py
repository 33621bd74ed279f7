"""Readers for the bulk file, JSON documents and raw filing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagewatch.functions.politics import norm_district, norm_party, office_of
from pagewatch.functions.text import blank_to_null, strip

CALENDAR_SCHEMA = (
    "state string, primary_date string, runoff_date string, filing_deadline string, source string, "
    "overrides array<struct<office:string,districts:array<string>,primary_date:string,"
    "filing_deadline:string,runoff_date:string>>"
)
RATING_SCHEMA = (
    "office string, state string, district string, rating string, party_favored string, source string"
)
FEED_SCHEMA = (
    "type string, province string, district string, election_type string, election_date string, "
    "candidates array<struct<name:string,party:string,winner:boolean>>"
)
SCHEDULE_E_SCHEMA = (
    "candidate_id string, committee_id string, committee struct<name:string>, committee_name string, "
    "payee_name string, support_oppose_indicator string, expenditure_amount string, "
    "expenditure_date string, dissemination_date string, sub_id string, transaction_id string"
)
# Results-feed race types and their office codes.
FEED_OFFICES = {
    "House of Representatives": "H",
    "U.S. House": "H",
    "U.S. Senate": "S",
    "Senate": "S",
    "President": "P",
}


def parse_candidate_summary(lines: DataFrame) -> DataFrame:
    """Pipe-separated candidate lines (column ``value``) -> typed candidate rows."""
    part = F.split("value", r"\|", -1)
    rows = lines.withColumn("_p", part).filter((F.size("_p") >= 20) & (F.element_at("_p", 1) != ""))
    field = lambda i: strip(F.col("_p")[i])
    return rows.select(
        field(0).alias("candidate_id"),
        field(1).alias("name"),
        office_of(field(0)).alias("office"),
        field(4).alias("party"),
        F.upper(field(18)).alias("state"),
        F.coalesce(blank_to_null(field(19)), F.lit("00")).alias("district"),
        F.coalesce(field(5).try_cast("double").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias(
            "receipts"
        ),
        field(2).alias("incumbent_challenge"),
    )


def read_candidate_summary(spark: SparkSession, path: str) -> DataFrame:
    """The bulk candidate file: Latin-1, quotes are literal characters."""
    raw = (
        spark.read.schema("value string")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escape", "")
        .option("encoding", "ISO-8859-1")
        .option("comment", "")
        .csv(path)
    )
    return parse_candidate_summary(raw)


def calendar_rows(documents: DataFrame, cycle: int) -> DataFrame:
    """Calendar documents -> one statewide row plus one row per moved race."""
    moved = documents.select("*", F.explode("overrides").alias("o")).withColumn("d", F.explode_outer("o.districts"))
    statewide = documents.select(
        "state", F.lit("").alias("office"), "primary_date", "filing_deadline", "source", "runoff_date"
    )
    races = moved.select(
        "state",
        F.concat_ws(":", "o.office", blank_to_null(F.col("d"))).alias("office"),
        F.col("o.primary_date").alias("primary_date"),
        F.coalesce(blank_to_null(F.col("o.filing_deadline")), "filing_deadline").alias("filing_deadline"),
        "source",
        F.col("o.runoff_date").alias("runoff_date"),
    )
    day = lambda c: F.col(c).try_cast("date").alias(c)
    return statewide.unionByName(races).select(
        "state",
        F.lit(cycle).alias("cycle"),
        "office",
        day("primary_date"),
        day("filing_deadline"),
        "source",
        day("runoff_date"),
    )


def read_calendar(spark: SparkSession, path: str, cycle: int) -> DataFrame:
    return calendar_rows(spark.read.schema(CALENDAR_SCHEMA).json(path, multiLine=True), cycle)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rating rows; a missing file is an empty table."""
    try:
        return spark.read.schema(RATING_SCHEMA).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RATING_SCHEMA)


def keyed_rows(documents: DataFrame, fields: str) -> DataFrame:
    """JSON objects (column ``value``) keyed by id -> (key, fields...); '_' keys are comments."""
    entries = F.from_json("value", f"map<string,string>")
    return (
        documents.select(F.explode(entries).alias("key", "entry"))
        .filter(~F.col("key").startswith("_"))
        .select("key", F.from_json("entry", fields).alias("e"))
        .select("key", "e.*")
    )


def read_keyed_overrides(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return keyed_rows(spark.read.text(path, wholetext=True), fields)


def normalize_ie(raw: DataFrame, cycle: int) -> DataFrame:
    """Schedule E records -> typed filings. Blank text and zero count as missing."""
    text = lambda c: blank_to_null(F.col(c))
    kept = (
        "support_oppose_indicator", "expenditure_amount", "expenditure_date", "dissemination_date",
        "payee_name", "committee_id", "sub_id",
    )
    amount = F.coalesce(F.col("expenditure_amount").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return raw.select(
        "candidate_id",
        "committee_id",
        F.coalesce(text("committee.name"), F.col("committee_name")).alias("committee_name"),
        "payee_name",
        "support_oppose_indicator",
        amount.alias("expenditure_amount"),
        F.substring("expenditure_date", 1, 10).try_cast("date").alias("expenditure_date"),
        F.substring("dissemination_date", 1, 10).try_cast("date").alias("dissemination_date"),
        F.lit(cycle).alias("cycle"),
        F.coalesce(text("sub_id"), F.col("transaction_id")).alias("transaction_id"),
        F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("raw"),
    )


def race_office(race_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FEED_OFFICES.items() for x in pair])
    return F.try_element_at(table, race_type)


def called_winners(races: DataFrame, cycle: int | None = None, source: str = "feed") -> DataFrame:
    """Race documents -> called primary winners of federal offices.

    Input order within a bucket is kept in ``seq`` when the input has it.
    """
    date = F.coalesce("election_date", F.lit(""))
    winner = F.try_element_at(F.filter("candidates", lambda c: F.coalesce(c["winner"], F.lit(False))), F.lit(1))
    year = F.substring(date, 1, 4)
    in_cycle = F.lit(True) if cycle is None else (year == "") | (year == str(cycle))
    rows = (
        races.withColumn("_office", race_office(F.coalesce("type", F.lit(""))))
        .withColumn("_winner", winner)
        .filter(F.col("_office").isNotNull() & (F.col("election_type") == "Primary") & in_cycle)
        .filter(F.col("_winner").isNotNull())
    )
    extra = ["seq"] if "seq" in races.columns else []
    return rows.select(
        *extra,
        F.upper("province").alias("state"),
        F.col("_office").alias("office"),
        norm_district(F.col("_office"), F.col("district")).alias("district"),
        norm_party(F.col("_winner.party")).alias("party"),
        F.coalesce("_winner.name", F.lit("")).alias("winner_name"),
        F.lit(source).alias("source"),
        blank_to_null(F.substring(date, 1, 10)).alias("election_date"),
    )


def read_results_feed(spark: SparkSession, path: str, cycle: int | None = None, source: str = "feed") -> DataFrame:
    return called_winners(spark.read.schema(FEED_SCHEMA).json(path), cycle, source)
