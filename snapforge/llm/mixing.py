"""Mixing sources to target weights with Sainte-Lague apportionment.

Blocks of equal numbers of words are given to sources, and then to the shards of each source, one
by one to the highest quotient weight / (2 * blocks + 1). All blocks are given at once: rounding
weight / divisor for a common divisor gives the same quotas but for a few blocks, and these few go
by the highest (or are taken by the lowest) quotients. The texts of a shard, one behind the other in
a seeded order, are cut into numbered blocks of equal numbers of words, and the quota is filled with
blocks in a seeded order of their numbers, so no place in a text is favoured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import WORD, others, quoted
from snapforge.session import keep

BLOCK_WORDS = 16
SHARD_DOCS = 2_000
SEED = 20
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``n_docs``, ``target`` from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; targets share the sum of all sizes
    by weight, but stop at ``cap`` times the source's size, and the excess is shared again until no
    target is above. Sorted by cap / weight, the sources that stop are the first ones: the common
    level is found from running sums over the sources, one row each.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("_w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    every = Window.partitionBy(F.lit(0))
    below = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stepped = (
        weighed.withColumn("_cap", cap * F.col("source_size").cast("double"))
        .withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_weights", F.sum("_w").over(every))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
        .withColumn("_open", F.col("_weights") - F.coalesce(F.sum("_w").over(below), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        # The level counts from the first source that does not reach its cap.
        .withColumn("_stops", F.col("_level") * F.col("_w") >= F.col("_cap"))
    )
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(every).getField("_level")
    shared = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return stepped.withColumn("target", shared).select("source", "source_size", "n_docs", "target")


def apportion(shares: DataFrame, keys: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """``shares`` and ``quota``: Sainte-Lague seats for the rows of each group of ``keys``.

    ``seats`` holds the group's number of seats. Ties of quotients go by ``order``. A group without
    weight gets no seats. Candidates for the last seats are bounded by the rows and not by the seats.
    """
    every = Window.partitionBy(*keys)
    w = F.col(weight).cast("double")
    base = (
        shares.withColumn("_sum", F.sum(w).over(every)).withColumn("_n", F.count("*").over(every))
        .withColumn("_q", F.when(F.col("_sum") > 0, w * F.col(seats) / F.col("_sum")).otherwise(0.0))
        .withColumn("_r", F.floor(F.col("_q") + 0.5).cast("long"))
        .withColumn("_gap", F.when(F.col("_sum") > 0, F.col(seats) - F.sum("_r").over(every)).otherwise(0).cast("long"))
    )
    # The gap is at most half a seat a row; a row can win or lose its part of that and one more.
    reach = F.least(F.abs("_gap"), F.ceil(F.col("_q") * F.col("_n") / F.greatest(F.col(seats), F.lit(1))).cast("long") + 2)
    wins = F.transform(F.sequence(F.lit(1), reach), lambda i: F.col("_r") + i)
    loses = F.transform(F.sequence(F.lit(0), F.least(reach, F.col("_r")) - 1), lambda i: F.col("_r") - i)
    seat = F.when(F.col("_gap") > 0, wins).when((F.col("_gap") < 0) & (F.col("_r") > 0), loses)
    # The k-th seat of a row has the quotient weight / (2k - 1).
    offers = base.filter("_gap <> 0 and _q > 0").withColumn("_k", F.explode(seat))
    offers = offers.withColumn("_quotient", w / (2 * F.col("_k") - 1))
    offers = offers.withColumn("_up", F.col("_gap") > 0)
    # Of equal quotients the first in order wins a seat, so the last one loses it.
    win = Window.partitionBy(*keys, "_up").orderBy(F.col("_quotient").desc(), *(F.col(c).asc_nulls_last() for c in order), "_k")
    lose = Window.partitionBy(*keys, "_up").orderBy("_quotient", *(F.col(c).desc_nulls_first() for c in order), "_k")
    rank = F.when(F.col("_up"), F.row_number().over(win)).otherwise(F.row_number().over(lose))
    taken = (
        offers.withColumn("_rank", rank).filter(F.col("_rank") <= F.abs("_gap"))
        .groupBy(*(F.col(c).alias(f"_k_{c}") for c in dict.fromkeys([*keys, *order]))).agg(F.sum(F.signum("_gap")).cast("long").alias("_more"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in dict.fromkeys([*keys, *order])]
    joined = base.join(taken, same, "left")
    return joined.withColumn("quota", F.col("_r") + F.coalesce("_more", F.lit(0))).select(*shares.columns, "quota")


def _draw(key: Column, seed: int, purpose: str) -> Column:
    """Seeded number from a text, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(purpose), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def mix(
    docs: DataFrame, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, cap: int = CAP
) -> DataFrame:
    """``docs`` and ``size``, ``source_size``, ``target``, ``taken`` of each row.

    size is the number of words (null text: 0), taken how many of them the mix holds, repeats counted.
    Each source's taken words come within a block of its target, which is coarse for a table of a few
    blocks; a document is taken at most ``cap`` times. A source is cut into shards of about
    ``shard_docs`` documents by a seeded hash, so a source that holds a third of all rows is many tasks.
    Rows with one id are rows of their own; those without an id go by their text. Of the last block that
    a shard takes, so many words are taken that the quota is met. Without any word all targets are 0.
    Columns named as the new ones are replaced.
    """
    rest = others(docs, ["size", "source_size", "target", "taken"])
    return mix_sizes(docs.select(*map(quoted, rest), word_count(F.col("text")).alias("size")), block, shard_docs, seed, cap)


def mix_sizes(
    sized: DataFrame, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, cap: int = CAP
) -> DataFrame:
    """``mix`` of rows that have their ``size`` (not null) already, with or without texts."""
    given = [F.col("_given").getField(c).alias(c) for c in sized.columns if c != "size"]
    return _chosen(sized, block, shard_docs, seed, cap).select(*given, "size", "source_size", "target", "taken")


def _chosen(sized: DataFrame, block: int, shard_docs: int, seed: int, cap: int) -> DataFrame:
    """``_given`` (the row), ``size``, ``source_size``, ``target``, ``taken``, and what blocks were picked of it.

    ``_skip`` is the number of words of the row's first block that stand in the document before, ``_takes`` the number
    of words taken of each of its blocks, beside the whole times; null if there is nothing beside them.
    """
    tie = F.xxhash64("text") if "text" in sized.columns else F.lit(0).cast("long")
    rows = keep(
        sized.select(
            F.struct(*map(quoted, sized.columns)).alias("_given"), "source", "size", F.col("doc_id").alias("_id"), tie.alias("_tie"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sizes",
    )
    targets = keep(source_targets(rows.select("source", "size"), cap), "targets")
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    quotas = apportion(
        targets.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(total / block).cast("long")), ["_all"], "target", "_seats", ["source"]
    ).select("source", "source_size", "target", F.col("quota").alias("_blocks"), F.ceil(F.col("n_docs") / shard_docs).cast("long").alias("_shards"))
    quotas = keep(quotas, "quotas").withColumnRenamed("source", "_source")
    joined = rows.drop("_given").join(quotas, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null"), F.col("_tie")))
    joined = joined.withColumn("_shard", _draw(key, seed, "shard") % F.col("_shards"))
    shards = joined.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("_blocks").alias("_blocks"))
    shares = keep(apportion(shards, ["source"], "_shard_size", "_blocks", ["_shard"]), "shares").select(
        F.col("source").alias("_source"), F.col("_shard").alias("_of"), "_shard_size",
        F.least(F.col("quota") * block, cap * F.col("_shard_size")).alias("_words"),
    )
    dealt = joined.join(shares, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_of")), "left")
    shard = Window.partitionBy("source", "_shard")
    placed = shard.orderBy(_draw(key, seed, "pick"), "_id", "size", "_tie", "_row")
    times = F.when(F.col("_shard_size") > 0, F.floor(F.col("_words") / F.col("_shard_size"))).otherwise(0).cast("long")
    dealt = (
        dealt.withColumn("_start", F.sum("size").over(placed.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_end", F.col("_start") + F.col("size"))
        .withColumn("_times", times).withColumn("_rest", F.col("_words") - F.col("_times") * F.col("_shard_size"))
    )
    # Rows with no word, and shards taken in whole times only, have no pieces and go on as one row.
    blocks = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))
    pieces = dealt.withColumn("_block", F.explode_outer(F.when((F.col("size") > 0) & (F.col("_rest") > 0), blocks)))
    words = F.least(F.col("_end"), (F.col("_block") + 1) * block) - F.greatest(F.col("_start"), F.col("_block") * block)
    seeded = shard.orderBy(F.xxhash64(F.lit(seed).cast("long"), "_shard", "_block"), "_block", "_start")
    before = F.coalesce(F.sum("_n").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("_n", F.coalesce(words, F.lit(0)))
    pieces = pieces.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_rest") - before)))
    # The same partitions serve both windows and this.
    picked = pieces.groupBy("source", "_shard", "_row").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_times").alias("_times"),
        (F.first("_start") % block).cast("int").alias("_skip"), F.sum("_take").alias("_more"),
        F.sort_array(F.collect_list(F.when(F.col("_block").isNotNull(), F.struct("_block", F.col("_take").cast("int").alias("take"))))).alias("_takes"),
    )
    taken = (F.col("_times") * F.col("size") + F.col("_more")).cast("long").alias("taken")
    return rows.select("_row", "_given", "size").join(picked.drop("source", "_shard"), "_row").select(
        "_given", "size", "source_size", "target", taken, "_skip", F.when(F.col("_more") > 0, F.col("_takes")["take"]).alias("_takes")
    )


def mixed_documents(
    docs: DataFrame, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, cap: int = CAP
) -> DataFrame:
    """The mix as rows of ``docs``: a row for each whole time a document is taken, and one with the words of its picked blocks for the rest.

    Words of picked blocks are joined by one space. A document of which nothing is taken goes, also
    one without words. Columns are those of ``docs``, and may have any names.
    """
    # The caller's columns travel as one, so none of their names is in the way.
    packed = docs.select(
        F.struct(*map(quoted, docs.columns)).alias("_docs"), "doc_id", "source", "text", word_count(F.col("text")).alias("size")
    )
    mixed = _chosen(packed, block, shard_docs, seed, cap)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    copies = mixed.withColumn("_times", times).withColumn("_rest", rest).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times"))))
    last = F.col("_copy") == F.col("_times")

    def is_picked(_: Column, i: Column) -> Column:
        place = F.col("_skip") + i
        return place % block - F.when(place < block, F.col("_skip")).otherwise(0) < F.get("_takes", F.floor(place / block).cast("int"))

    text = F.col("_given").getField("text")
    cut = F.concat_ws(" ", F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), is_picked))
    copies = copies.filter(~last | (F.col("_rest") > 0)).select(
        F.col("_given").getField("_docs").alias("_docs"), F.when(last, cut).otherwise(text).alias("_text")
    )
    return copies.select(*[(F.col("_text") if c == "text" else F.col("_docs").getField(c)).alias(c) for c in docs.columns])
