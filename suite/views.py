"""The engine's inputs as views over the given tables.

Every view covers its whole table and every text is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.display import pdf_link
from folioscope.functions.responses import strip_fence
from folioscope.plans.analysis import score_baseline
from suite.params import CONFIG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_papers(documents: DataFrame) -> DataFrame:
    """Documents as paper metadata: the first line is the title, the text the summary."""
    minutes = F.make_dt_interval(mins=(F.col("doc_id") * 7919 % 43200).cast("int"))
    id_ = F.col("doc_id").cast("string")
    return documents.select(
        id_.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        pdf_link(id_).alias("pdf_url"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("published"),
        F.array("source").alias("authors"),
        F.array("source", "lang").alias("categories"),
        "lang",
        "source",
        "n_chars",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_papers(table(spark, sf_dir, "documents"))


def with_response(papers_: DataFrame) -> DataFrame:
    """Add `response`, a stand-in for a model's rating of each paper.

    The scores follow the text length with different periods. Some languages and
    sources answer in other shapes: fenced, bare fence, a key missing, cut short, or
    with words after the object.
    """
    n = F.col("n_chars")
    start = F.format_string(
        '{"innovation": %d, "rigor": %d', 1 + n % 7, 1 + n % 9
    )
    impact = F.when(F.col("lang") != "es", F.format_string(', "impact": %d', 1 + n % 10))
    body = F.concat(start, F.coalesce(impact, F.lit("")), F.lit(', "total_score": 9.5}'))
    source = F.col("source")
    shaped = (
        F.when(source == "src17", F.substring(body, F.lit(1), F.length(body) - 5))
        .when(source == "src13", F.concat(body, F.lit(" Hope this helps.")))
        .otherwise(body)
    )
    fenced = (
        F.when(F.col("lang") == "de", F.concat(F.lit("```json\n"), shaped, F.lit("\n```\n")))
        .when(source == "src11", F.concat(F.lit("```\n"), shaped, F.lit("\n```")))
        .otherwise(F.concat(F.lit("  "), shaped))
    )
    return papers_.withColumn("response", fenced)


def score(papers_: DataFrame) -> DataFrame:
    answered = with_response(papers_).withColumn(
        "response", strip_fence(F.col("response"))
    )
    return score_baseline(answered, "response", CONFIG)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper with its scores."""
    return score(papers(spark, sf_dir))


def evaluation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evaluations: the labelled documents."""
    labels = table(spark, sf_dir, "labels")
    innovation = (3 + 4 * F.col("quality")).cast("double")
    impact = (8 - 3 * F.col("toxic")).cast("double")
    return labels.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        innovation.alias("innovation"),
        F.lit(5.0).alias("rigor"),
        impact.alias("impact"),
        F.round((innovation + 5.0 + impact) / 3, 2).alias("total_score"),
        F.lit("").alias("raw_response"),
        F.when(F.col("quality") == 1, F.lit("done")).alias("translation"),
    )


def _customer(number) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0"))


def authored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with an author array, the shape the catalogue delivers: one per event.

    The user is the first author and the whole part of the value names the last, which
    makes a few names very frequent. Some events have an unknown or blank author too.
    """
    kind = F.col("event_type")
    odd = F.when(kind == "error", "Unknown").when(kind == "signup", "")
    names = F.array(
        _customer(F.col("user_id")),
        F.coalesce(odd, _customer(F.col("user_id") + 1)),
        _customer(F.floor("value")),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), names.alias("authors")
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey)


def flat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the first author service; poorer customers are not known to it."""
    balance = F.col("c_acctbal")
    hit = F.struct(
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") >= 3, F.col("c_nationkey") + 1).alias("hIndex"),
        F.floor(balance / 10).cast("int").alias("paperCount"),
        F.floor(balance).cast("int").alias("citationCount"),
        F.array(
            F.struct(F.lit("").alias("name")), F.struct(F.col("n_name").alias("name"))
        ).alias("affiliations"),
    )
    found = F.to_json(F.struct(F.array(hit, hit).alias("data")))
    payload = F.when(balance >= 3000, found).otherwise(F.lit('{"data": []}'))
    return _customers(spark, sf_dir).select(
        F.col("c_name").alias("name"), payload.alias("payload")
    )


def nested_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the second service, which covers three of the five regions."""
    institution = F.struct(F.col("n_name").alias("display_name"))
    hit = F.struct(
        F.col("c_name").alias("display_name"),
        (F.col("c_custkey") + 7).cast("int").alias("works_count"),
        (F.col("c_custkey") * 3).cast("int").alias("cited_by_count"),
        F.struct((F.col("n_regionkey") * 10 + 5).alias("h_index")).alias("summary_stats"),
        F.array(F.struct(institution.alias("institution"))).alias("affiliations"),
    )
    found = F.to_json(F.struct(F.array(hit).alias("results")))
    payload = F.when(F.col("n_regionkey").between(1, 3), found).otherwise(
        F.lit('{"results": []}')
    )
    return _customers(spark, sf_dir).select(
        F.col("c_name").alias("name"), payload.alias("payload")
    )
