"""Rules for documents, and verdicts on the hosts whose documents fail them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import broadcast_if_small, settle
from folioscope.llm.ordering import SPACE, WORD

#: Words of a window.
WINDOW = 5


def _bound(value: Column, body) -> Column:
    """`body` of a value computed once; Catalyst would copy it into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice.

    Windows are compared by two 64-bit hashes. Only texts with a repeated window sort
    theirs; the covered words are those of the union of the repeated windows.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        def at(i: Column) -> Column:
            part = [F.element_at(h, (i + k).cast("int")) for k in range(WINDOW)]
            return F.xxhash64(*part)

        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), at)

    def covered(w: Column) -> Column:
        order = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(o: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                # get() is null beyond either end
                before = F.get(o, k - 1)["h"] == x["h"]
                after = F.get(o, k + 1)["h"] == x["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.array_sort(F.transform(F.filter(o, twin), lambda x: x["i"]))

        def union(p: Column) -> Column:
            gaps = F.transform(
                p,
                lambda x, k: F.least(
                    F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)
                ),
            )
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _bound(_bound(order, again), union)

    def counted(w: Column) -> Column:
        repeated = F.size(F.array_distinct(w)) < F.size(w)
        return F.when(repeated, covered(w)).otherwise(F.lit(0).cast("long"))

    return F.when(
        F.size(words) > WINDOW,
        _bound(hashes, lambda h: _bound(windows(h), counted)),
    ).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """Add `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.withColumn("_words", F.regexp_extract_all(text, F.lit(f"({WORD})")))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"))
        .withColumn(
            "n_symbols",
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        )
        .withColumn(
            "n_dup_lines",
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        )
        .withColumn("n_repeat_words", _repeat_words(F.col("_words")))
        .drop("_words", "_lines")
    )


def host_verdicts(
    judged: DataFrame, host: str = "source", failed: str = "base_failed", most: float = 0.5
) -> DataFrame:
    """`host`, `n_docs`, `n_failed`, `fail_rate` and `host_kept`: one row for each host.

    Rates are shrunk to an empirical beta prior, whose mean and strength come from the
    moments of the hosts' rates: with overall rate p and the between-host variance v
    left after sampling noise, strength = p (1 - p) / v - 1, or infinite (all hosts get p)
    when the hosts differ by no more than noise. A host is kept while its shrunk rate is
    at most `most`. A null host is one host.
    """
    counted = settle(
        judged.groupBy(host).agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(F.col(failed).cast("long")).alias("n_failed"),
        )
    )
    sums = counted.agg(
        F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_failed"), F.sum(F.lit(1.0) / F.col("n_docs"))
    ).first()
    hosts, docs, fails, inverse = (x or 0 for x in sums)
    mean = fails / docs if docs else 0.0
    spread = counted.agg(F.sum((F.col("n_failed") / F.col("n_docs") - F.lit(mean)) ** 2)).first()[0]
    noise = mean * (1 - mean) * inverse
    # spread = sum of v + (mean (1 - mean) - v) / n over the hosts
    between = ((spread or 0.0) - noise) / (hosts - inverse) if hosts > inverse else 0.0
    if between > 0:
        strength = max(mean * (1 - mean) / between - 1, 0.0)
        shrunk = (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))
    else:
        shrunk = F.lit(mean)
    return counted.withColumn("fail_rate", shrunk).withColumn(
        "host_kept", F.col("fail_rate") <= F.lit(most)
    )


def judge(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """`doc_id`, the measures, `base_failed`, `kept`, `fail_rate` of every row.

    A document fails by fewer than 10 words, or when more than 20 % of its words lie in
    repeated windows; a null or empty text has no words and fails. It is kept if it does
    not fail and its host is kept. Repeated rows are judged each; an empty table gives
    no rows; other columns are left out.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = settle(
        measure(docs.select("doc_id", "text", F.col(host).alias("_host")))
        .drop("text")
        .withColumn("base_failed", failed)
    )
    verdicts = host_verdicts(measured, "_host", "base_failed", most).select(
        F.col("_host").alias("_known"), "fail_rate", "host_kept"
    )
    return measured.join(
        broadcast_if_small(verdicts), F.col("_host").eqNullSafe(F.col("_known"))
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
        "fail_rate",
    )
