"""Operator 4, mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words.

Built from DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, fresh, stored, with_row_key

SEED = 20_240_602


def word_count(text: Column) -> Column:
    """Words of a text, null: 0, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_repeats: int) -> DataFrame:
    """Targets of sources: weights (in turn, sources by code point, null last) of share of all words.

    No target is above max_repeats times its source's size.  The excess goes to the others by weight until none
    is above: with sources ordered by the level (cap / weight) at which each fills up, the first i are full where
    the level of what is left stays under the next one's.  sizes: none, source, source_size.
    """
    in_order = Window.partitionBy("one").orderBy("none", F.col("source").cast("binary"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    w = Window.partitionBy("one")
    filling = w.orderBy("fills_at", "turn")
    return (
        sizes.withColumn("one", F.lit(1))
        .withColumn("turn", F.row_number().over(in_order) - 1)
        .withColumn("weight", F.element_at(wheel, (F.col("turn") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(max_repeats))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("goal", F.sum("source_size").over(w) * float(share))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("weight_left"))
        # The first source in filling order that stays under its cap fixes the level for itself and all after it.
        .withColumn("open_level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "turn", "level"))).over(w)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))))
        .select("none", "source", "source_size", "target")
    )


def sainte_lague(claims: DataFrame, keys: list[str], within: list[str], claim: str, seats: str, out: str) -> DataFrame:
    """Integer seats for each row of claims by highest quotients claim / (2 j + 1), ties by keys.

    Each group of within has its own seats (the same on all its rows).  With m rows in a group, a divisor that
    seats them all lies between those of seats - m/2 and seats + m/2; so a row's seats are known but for
    a few, and just those quotients are made and ranked: about 4 for each row, however many seats there are.
    """
    w = Window.partitionBy(*within)
    part = F.col(claim) / F.col("claims")
    bounded = (
        claims.withColumn("claims", F.sum(claim).over(w))
        .withColumn("half", F.sum(F.when(F.col(claim) > 0, 0.5).otherwise(0.0)).over(w))
        .withColumn("low", F.when(F.col("claims") > 0, F.greatest(F.lit(0), F.floor((F.col(seats) - F.col("half")) * part - 0.5) - 1)).otherwise(0).cast("long"))
        .withColumn("high", F.when(F.col("claims") > 0, F.when(F.col(claim) > 0, F.ceil((F.col(seats) + F.col("half")) * part + 0.5) + 1).otherwise(0)).otherwise(0).cast("long"))
        .withColumn("open", F.col(seats) - F.sum("low").over(w))
    )
    ranked = (
        bounded.where("high > low")
        .withColumn("j", F.explode(F.sequence("low", F.col("high") - 1)))
        .withColumn("quotient", F.col(claim) / (2 * F.col("j") + 1))
        .withColumn("place", F.row_number().over(w.orderBy(F.desc("quotient"), *keys, "j")))
        .where("place <= open")
        .groupBy(*within, *keys)
        .agg(F.count(F.lit(1)).alias("won"))
    )
    joined = bounded.join(ranked, [*within, *keys], "left")
    return joined.withColumn(out, F.col("low") + F.coalesce("won", F.lit(0))).select(*claims.columns, out)


def _taken(docs: DataFrame, row: Column, weights: list[float], share: float, max_repeats: int, block_words: int, words_per_shard: int, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, row (what names a row among those of the same id and size), size, source_size, target and taken of every row of docs."""
    slim = stored(
        docs.select(
            F.col(id_col).alias("id"),
            row.alias("row"),
            F.col(source_col).isNull().alias("none"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "mix-rows",
    )
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, round(total / words_per_shard))
    spread = F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(shards)).cast("int")
    slim = slim.withColumn("shard", spread).withColumn("h", F.xxhash64(F.lit(seed + 1), "id", "size"))
    cells = slim.groupBy("none", "source", "shard").agg(F.sum("size").alias("cell_size"))
    sizes = cells.groupBy("none", "source").agg(F.sum("cell_size").alias("source_size"))
    blocks = F.round(F.sum("target").over(Window.partitionBy("one")) / block_words).cast("long")
    targets = source_targets(sizes, weights, share, max_repeats).withColumn("one", F.lit(1)).withColumn("blocks", blocks)
    quotas = sainte_lague(targets, ["none", "source"], ["one"], "target", "blocks", "source_blocks")
    quotas = quotas.select("none", "source", "source_size", "target", "source_blocks")
    dealt = sainte_lague(cells.join(quotas, ["none", "source"]), ["shard"], ["none", "source"], "cell_size", "source_blocks", "cell_blocks")
    dealt = dealt.select(
        "none", "source", "shard", "source_size", "target", "cell_size",
        F.least(F.col("cell_blocks") * block_words, F.col("cell_size") * max_repeats).alias("quota"),
    )
    inside = Window.partitionBy("none", "source", "shard").orderBy("h", "id", "size", "row")
    first_block = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.expr(f"cell_size div {block_words}"), F.lit(1)))
    # The last pass takes [begin, begin + rest) of the cell's words, and what runs over its end from 0 on.
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(F.col("end") - F.col("size"), lo))
    stop = F.col("begin") + F.col("rest")
    return (
        slim.join(dealt, ["none", "source", "shard"])
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("passes", F.expr("case when cell_size > 0 then quota div cell_size else 0 end"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("cell_size"))
        .withColumn("begin", first_block * block_words)
        .withColumn("last", overlap(F.col("begin"), stop) + overlap(F.lit(0), stop - F.col("cell_size")))
        .select("id", "row", "size", "source_size", "target", (F.col("size") * F.col("passes") + F.col("last")).cast("long").alias("taken"))
    )


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.0, max_repeats: int = 3, block_words: int = 8, words_per_shard: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """How many words of each document a mixture takes: id, size, source_size, target, taken.

    The mixture's blocks of block_words words are dealt to sources, and each source's to hash shards of the
    documents, by Sainte-Lague.  In a shard a source's documents stand in seeded order; the quota takes whole
    passes over them, then a run of blocks from a seeded block on, round the end.  taken never exceeds
    max_repeats times the document's size; a source's sum misses its target by a few blocks at most.  Null
    text: size 0, takes 0; a null source is one of its own, last in order; repeated rows count each, and rows of one id and size stand
    in any order; a very long text takes its share of the run; an empty table gives an empty result; other columns are not read, whatever
    their names.  A hot source is split over as many shards as its words need.
    """
    taken = _taken(docs, F.monotonically_increasing_id(), weights, share, max_repeats, block_words, words_per_shard, id_col, text_col, source_col, seed)
    return taken.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: list[float], share: float = 1.0, max_repeats: int = 3, block_words: int = 8, words_per_shard: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, plain_table: bool = False) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with all their columns.

    A document comes whole: taken words over its size, rounded half up.  Only documents at the ends of a run of
    blocks are taken in part, so the rounding moves a cell by two documents at most.  Documents without words (null and empty
    texts too) do not come; repeated rows are taken each; an empty table gives an empty result; no column's name can clash.  plain_table: docs is
    read from files as it is, which saves a copy of it.
    """
    keyed, key = with_row_key(docs, plain_table)
    taken = _taken(keyed, F.struct(*key), weights, share, max_repeats, block_words, words_per_shard, id_col, text_col, source_col, seed)
    copies, copy = fresh(keyed, "mx_copies", "mx_copy")
    often = taken.where("size > 0").select(*[F.col(f"row.{c}").alias(c) for c in key], F.expr("(2 * taken + size) div (2 * size)").alias(copies)).where(F.col(copies) > 0)
    numbered = keyed.join(often, key)
    return numbered.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[f"`{c}`" for c in docs.columns])
