"""Mix sources to target weights: packed token blocks, drawn slots, permuted indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.cluster import broadcast_if_small, settle
from folioscope.llm.ordering import WORD, running_total

#: Words of a block.
BLOCK = 256
#: Tasks that open slots, at most.
_OPENERS = 8_192
#: Rounds of the index permutation.
_ROUNDS = 16
_SEED = 7_001


def _targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Add `target`: `share` of all sizes by weight, at most `most` times a source's size.

    `target = min(level * weight, most * size)`; each pass raises the level to what is
    left over the weights still below their cap. Only sums come to the driver.
    """
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    full = F.lit(most) * F.col("source_size")
    level, previous = 0.0, None
    capped = F.lit(False)
    while level != previous:
        row = sources.agg(
            F.sum(F.when(capped, full).otherwise(F.lit(0.0))),
            F.sum(F.when(capped, F.lit(0)).otherwise(F.col("weight"))),
        ).first()
        previous = level
        level = (total - (row[0] or 0.0)) / row[1] if row[1] else level
        level = max(level, previous)
        capped = F.lit(level) * F.col("weight") > full
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), full))


def _permuted(index: Column, length: Column, *key: Column) -> Column:
    """A permutation of 0..length-1 keyed by `key`: swap-or-not rounds.

    Each round pairs x with (k - x) mod length and a keyed hash of the larger of the two
    says whether the pair is swapped, so it is a bijection for any length.
    """

    def swap(x: Column, turn: Column) -> Column:
        # abs of a hash reduced first, so that the difference can't overflow
        shift = F.pmod(F.xxhash64(F.lit(_SEED), turn, *key), length)
        other = F.pmod(shift - x, length)
        coin = F.xxhash64(F.lit(_SEED), turn, F.greatest(x, other), *key)
        return F.when(coin < 0, other).otherwise(x)

    turns = F.sequence(F.lit(1), F.lit(_ROUNDS))
    return F.aggregate(turns, index.cast("long"), swap)


def _clamp(value: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, most))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
    shards: int = 64,
    once: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their place in the source's stream, source targets, and slots.

    A source's documents, ordered by a keyed hash, form one stream of words that is cut
    into blocks of `block` words. `slots`: one row for each block taken, with the
    `source_rank`, `pass_no`, `block_no`, the output `shard` and `words`. A source's slots
    fill passes over its stream; a slot's index goes through a permutation of the
    source's full blocks, the short last block comes last, and the last slot is cut so
    that the words taken are the rounded target. Each slot draws its output shard, so
    the source counts of a shard are multinomial given the sources' totals. With `once`,
    rows that agree in id and text are one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        "source",
        F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))).cast("long").alias("size"),
        F.xxhash64(F.lit(_SEED), "doc_id", text).alias("mixed"),
        F.xxhash64(text).alias("text_key"),
    )
    if once:
        sized = sized.groupBy("doc_id", "text_key").agg(
            *(F.min(c).alias(c) for c in ("source", "size", "mixed"))
        )
    order = [F.asc_nulls_last("source"), F.col("mixed"), F.col("doc_id")]
    placed = settle(running_total(sized, order, "before", F.col("size")))
    named = placed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("before").alias("source_start")
    )
    ranked = running_total(named, [F.asc_nulls_last("source")], "source_rank", F.lit(1))
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int")
    )
    sources = settle(_targets(settle(ranked.withColumn("weight", weight)), weights, share, most))

    full = F.floor(F.col("source_size") / block)
    passes = sources.where("source_size > 0").select(
        "source_rank",
        full.alias("full"),
        "source_size",
        F.round("target").cast("long").alias("wanted"),
        F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass_no"),
    )
    passes = passes.withColumn(
        "pass_words",
        _clamp(F.col("wanted") - F.col("pass_no") * F.col("source_size"), F.col("source_size")),
    ).where("pass_words > 0")
    # A pass is opened in runs of indices, so that a large source spreads over tasks.
    run = 4_096
    last = F.ceil(F.col("pass_words") / block) - 1
    runs = passes.withColumn("last", last).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / run)))
    )
    first = F.col("run") * run
    # A stated number of partitions is not merged at run time: a few small rows open into
    # very many. Each opens some runs, whatever the size of the mix.
    each = F.floor((F.ceil(F.col("pass_words") / block) - 1) / run) + 1
    tasks = min(max(1, passes.agg(F.sum(each)).first()[0] or 0), _OPENERS)
    slots = runs.repartition(tasks, "source_rank", "pass_no", "run").withColumn(
        "index", F.explode(F.sequence(first, F.least(first + run - 1, F.col("last"))))
    )
    key = [F.col("source_rank"), F.col("pass_no")]
    number = F.when(
        F.col("index") < F.col("full"), _permuted(F.col("index"), F.col("full"), *key)
    ).otherwise(F.col("full"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("index") * block)
    drawn = F.pmod(F.xxhash64(F.lit(_SEED), *key, F.col("index")), F.lit(shards))
    slots = slots.select(
        "source_rank",
        "pass_no",
        number.alias("block_no"),
        _clamp(F.col("pass_words") - F.col("index") * block, length).alias("words"),
        drawn.cast("int").alias("shard"),
    )
    # One row for each source, and no bound on those: the join decides by size.
    known = sources.select("source", "source_rank", "source_size", "source_start", "target")
    streamed = placed.join(
        known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    )
    at = F.col("before") - F.col("source_start")
    return streamed.withColumn("at", at).drop("_source", "mixed"), sources, slots


def _pieces(streamed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """The stretches of documents that slots take: word numbers `start` to `end` - 1."""
    opened = streamed.where("size > 0").select(
        "doc_id",
        "text_key",
        "before",
        "source_rank",
        "at",
        "size",
        F.explode(
            F.sequence(
                F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
            )
        ).alias("block_no"),
    )
    # Slots are opened from a small table, so the planner takes them for few; they grow
    # with the words.
    joined = opened.join(slots.hint("merge"), ["source_rank", "block_no"])
    head = F.col("block_no") * block
    start = F.greatest(head, F.col("at")) - F.col("at")
    end = F.least(head + F.col("words"), F.col("at") + F.col("size")) - F.col("at")
    return joined.select(
        "doc_id", "text_key", "before", "at", "source_rank", "pass_no", "block_no", "shard",
        start.alias("start"), end.alias("end"),
    ).where("end > start")


def mix_counts(docs: DataFrame, block: int = BLOCK, **plan: object) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target`, `taken` of every row of `docs`.

    `taken` counts the words of the document that the mix holds, repeats counted; it is
    at most twice the size. A null or empty text has size 0 and is never taken; a null
    source is one source, the last. Repeated rows are documents of their own. An empty
    table gives no rows. Other columns are left out.
    """
    streamed, _, slots = plan_mix(docs, block=block, **plan)
    # `before` tells documents with words apart: each starts at its own word.
    taken = _pieces(streamed, slots, block).groupBy("before").agg(
        F.sum(F.col("end") - F.col("start")).alias("_taken")
    )
    own = F.when(F.col("size") > 0, F.col("before"))
    return (
        streamed.withColumn("_key", own)
        .join(taken.withColumnRenamed("before", "_key").hint("merge"), "_key", "left")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mix_texts(docs: DataFrame, block: int = BLOCK, **plan: object) -> DataFrame:
    """The mix itself: a row of `docs` for each pass that takes words of it.

    A document taken whole keeps its text; of one taken in part, the words taken are
    joined by single spaces. `n_chars`, if there, is that of the new text. Rows that
    agree in id and text are one document here, and each of them gets its words. A text
    without words is in no mix. Columns stay those of `docs`, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # The caller's columns travel as one, so that none can be mistaken for the plan's.
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64(text).alias("_text_key")
    )
    # Ids and sizes alone decide; texts meet the plan at the end, in one join.
    streamed, _, slots = plan_mix(docs, block=block, once=True, **plan)
    pieces = _pieces(streamed, slots, block).groupBy("before", "pass_no").agg(
        F.first("doc_id").alias("_id"),
        F.first("text_key").alias("_key"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_pieces"),
        F.sum(F.col("end") - F.col("start")).alias("_taken"),
    )
    cut = F.flatten(F.transform("_pieces", lambda p: _cut(F.col("_words"), p["start"], p["end"])))
    mixed = keyed.join(
        pieces.hint("merge"),
        F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")),
    ).withColumn("_words", _words_of(F.col("_row")["text"]))
    new = F.when(F.col("_taken") == F.size("_words"), F.col("_row")["text"]).otherwise(
        F.array_join(cut, " ")
    )
    out = mixed.withColumn("_new", new)
    values = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return out.select(*(values[c].alias(c) for c in docs.columns))


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def _cut(words: Column, start: Column, end: Column) -> Column:
    return F.slice(words, (start + 1).cast("int"), (end - start).cast("int"))


def mix_shards(docs: DataFrame, block: int = BLOCK, **plan: object) -> DataFrame:
    """The mix as packed blocks: `shard`, `place`, `source`, `pass_no`, `block_no`, `n_words`, `text`.

    One row for each slot: the words that its block takes, joined by single spaces, `block`
    of them but for the last ones of a source. How many slots of each source a shard holds
    is multinomial; `place` orders the slots of a shard by a keyed hash. Write it
    partitioned by shard. Rows that agree in id and text are one document; texts without
    words, nulls and an empty table give nothing. Reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = (
        docs.select(F.col("doc_id").alias("_own"), text.alias("text"), F.xxhash64(text).alias("_text_key"))
        .groupBy("_own", "_text_key")
        .agg(F.min("text").alias("text"))
    )
    streamed, sources, slots = plan_mix(docs, block=block, once=True, **plan)
    pieces = _pieces(streamed, slots, block)
    met = pieces.join(
        texts,
        F.col("doc_id").eqNullSafe(F.col("_own")) & (F.col("text_key") == F.col("_text_key")),
    )
    piece = F.array_join(_cut(_words_of(F.col("text")), F.col("start"), F.col("end")), " ")
    entry = F.struct((F.col("at") + F.col("start")).alias("word"), piece.alias("piece"))
    key = ["source_rank", "pass_no", "block_no", "shard"]
    packed = met.groupBy(*key).agg(  # a block's words at most
        F.sum(F.col("end") - F.col("start")).alias("n_words"),
        F.array_join(F.sort_array(F.collect_list(entry))["piece"], " ").alias("text"),
    )
    names = broadcast_if_small(sources.select("source_rank", "source"))
    place = F.xxhash64(F.lit(_SEED), F.lit(1), "source_rank", "pass_no", "block_no")
    return packed.join(names, "source_rank").select(
        "shard", place.alias("place"), "source", "pass_no", "block_no", "n_words", "text"
    )
