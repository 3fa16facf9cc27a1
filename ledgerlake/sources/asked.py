"""Questions about the filers of the sales tables: one set per customer, cut from fixed wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.tables import table

# {n} is the filer, {y} a fiscal year and {z} the year two later.
WORDINGS = [
    "What was the gross margin of {n} in FY{y}?",
    "How much total revenue did {n} report in fiscal {y}?",
    "What is the working capital ratio of {n} for fiscal year {y}? It is calculated as total current assets divided by total current liabilities.",
    "Compute the fixed asset turnover of {n} for FY{y}. It is defined as: revenue / average PP&E between the two years.",
    "What was the change in net income of {n} from FY{y} to FY{z}?",
    "What is the CAGR of revenue of {n} between FY{y} and FY{z}?",
    "Did the operating margin of {n} increase from FY{y} to FY{z}?",
    "What is the 3 year average capex as a % of revenue of {n} for FY{y} - FY{z}?",
    "Which segment of {n} had the highest revenue in FY{y}?",
    "Which region of {n} had the lowest cost of sales in FY{y}?",
    "Among operations, investing, and financing activities, which brought in the most (or lost the least) cash flow for {n} in FY{y}?",
    "What is the DPO of {n} for FY{y}? It is defined as: 365 * average accounts payable / (COGS + change in inventory).",
    "Which debt securities are registered to trade on a national securities exchange under the name of {n}?",
    "What drove the gross margin change of {n} as of FY{y}?",
    "Who are the primary customers of {n}?",
    "What is net income divided by total assets of {n} in FY{y}?",
    "Is {n} a capital-intensive business based on FY{y} data?",
    "What was the two-year average net income of {n}?",
    "Has {n} reported any increase in SG&A versus the year before?",
    "quick ratio of {n} FY{y}?",
    "What is the EBITDA % margin of {n} for FY{y} excluding restructuring charges?",
    "How much were the dividends paid by {n} in FY{y}, relying on the cash flow statement?",
    "Describe the legal proceedings of {n}.",
    "What is the cash conversion cycle of {n} for FY{y}?",
    "What is the return on equity of {n} in FY{y}? ROE is defined as: net income / total assets.",
    "what was the effective tax rate for {n} FY98?",
]
PER_FILER = 4
TASKS_PER_CORE = 2


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """questions(question_id, filing_id, question): four per customer, wordings and years taken in turn."""
    wordings = F.array(*[F.lit(w) for w in WORDINGS])
    # A folder's customers may lie in one row group, which one task would read and do all the work on questions for.
    spread = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
    filers = table(spark, folder, "customer").select("c_custkey", "c_name").repartition(spread, "c_custkey")
    rows = filers.select("c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.lit(PER_FILER - 1))).alias("k"))
    w = F.get(wordings, F.pmod(F.col("c_custkey") * PER_FILER + F.col("k"), F.lit(len(WORDINGS))).cast("int"))
    year = F.lit(1995) + F.pmod(F.col("c_custkey") + F.col("k"), F.lit(6))
    text = F.replace(w, F.lit("{n}"), F.col("c_name"))
    text = F.replace(text, F.lit("{y}"), year.cast("string"))
    text = F.replace(text, F.lit("{z}"), (year + 2).cast("string"))
    return rows.select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("question_id"),
        F.col("c_custkey").cast("string").alias("filing_id"), text.alias("question"),
    )
