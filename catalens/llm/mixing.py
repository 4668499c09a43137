"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents lie in a seeded order on a line of tokens, cut into blocks of
`block` tokens, the last of which holds the rest. Blocks are given to the sources by the
highest quotients target / 1, target / 3, target / 5 ..., which makes whole quotas; each is
the target in blocks, rounded up or down, however many small sources there are. A source
gives the tokens of its quota and what its target lacks or has too much beyond it, a block
at most: a part of one more block, or cut off a block of the quota. So sources smaller than
a block reach their targets, too.

A source gives all its tokens as often as they fit into its number. Its blocks are dealt to
SHARDS shards in turn; the blocks that are left to give are split over these as evenly as
whole ones allow (`shard_quotas`), and each shard gives its number by a seeded choice among
its own. The part of one more comes from the next block of the next shard's choice; where
the quota has a block too much, the first block of that shard's choice is the one that is
cut (the last, short block comes after all others).

Targets: weights share all tokens; a target stops at `most` times its source's size
and the excess is shared again by weight until no target is above.

All of it is sums over the table of sources, which no single task or the driver holds.
The size of a document is its number of words (null: 0); empty documents take nothing.
A null source is a source, the last in order. Equal rows are rows of their own. Sources
without weight get nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.store import materialise, running_total

BLOCK = 64
SHARDS = 16
MOST = 3
SEED = 20240607
_WAYS = 32
#: Multipliers for the seeded choice of blocks; one that shares no factor is taken.
_PRIMES = (1_000_003, 998_244_353, 2_147_483_647)


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def repeating_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds `weight`: 1, 2, ... cycle, again and again over the sources by code point, null last."""
    ranked = running_total(sources, ["source"], F.lit(1), "_rank")
    return ranked.withColumn("weight", (F.col("_rank") % cycle + 1).cast("double")).drop("_rank")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `target` to source, source_size, weight."""
    rows = sources.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None  # tokens per unit of weight
    while True:
        full = F.lit(False) if level is None else F.col("_cap") < F.col("weight") * level
        taken, weight = rows.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not weight:
            break
        new = max(0.0, total - taken) / weight
        if level is not None and new <= level:
            break
        level = new
    share = F.col("weight") * (level or 0.0)
    return rows.withColumn("target", F.least(F.col("_cap"), share)).drop("_cap")


def apportion(sources: DataFrame, seats: int, votes: str, limit: str, least: str | None = None) -> DataFrame:
    """Adds `quota`: the whole numbers of Sainte-Laguë for `seats` seats, none above the column
    `limit` or under `least`.

    A source has a seat per quotient votes / (2 k - 1) above a level, so the level is
    narrowed until it parts the seats; quotients on the level go by source order.
    """
    def won(level: float) -> Column:
        seats = F.least(F.col(limit), F.floor(F.col(votes) / (2 * level) + 0.5))
        return (seats if least is None else F.greatest(F.col(least), seats)).cast("long")

    most_votes, places = sources.agg(F.max(votes), F.sum(limit)).first()
    if not seats or not most_votes:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    seats = min(seats, int(places))
    low, high = most_votes / (4e6 * seats), most_votes * 2.0  # enough seats at low, none at high
    for _ in range(16):
        levels = [low * (high / low) ** (k / _WAYS) for k in range(1, _WAYS)]
        counts = list(sources.agg(*[F.sum(won(x)) for x in levels]).first())
        above = [x for x, n in zip(levels, counts) if n >= seats]
        below = [x for x, n in zip(levels, counts) if n < seats]
        low, high = max([low, *above]), min([high, *below])
        if high / low < 1 + 1e-14 or seats in counts and counts[len(above) - 1] == seats:
            break
    rows = sources.withColumn("quota", won(high)).withColumn("_more", won(low) - F.col("quota"))
    missing = seats - (rows.agg(F.sum("quota")).first()[0] or 0)
    if rows.agg(F.sum("_more")).first()[0] == missing:  # all quotients between the two levels win
        return rows.withColumn("quota", F.col("quota") + F.col("_more")).drop("_more")
    ranked = running_total(rows, ["source"], F.col("_more"), "_before")
    own = F.greatest(F.lit(0), F.least(F.col("_more"), F.lit(missing) - F.col("_before")))
    return ranked.withColumn("quota", (F.col("quota") + own).cast("long")).drop("_more", "_before")


_GIVEN = ("blocks", "rounds", "chosen", "rest", "cut")


def _step(blocks: Column) -> Column:
    first, second, third = (F.when(blocks % p != 0, F.lit(p)) for p in _PRIMES)
    return F.coalesce(first, second, third).cast("long")


def plan(sizes: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target, blocks, quota, words, rounds, chosen, rest, cut per source.

    `blocks` counts its whole blocks. `quota` is the number it is to give, `words` all it
    gives, within a block of these: its whole size `rounds` times, `chosen` blocks more, and
    `rest` words of another, which is one of the quota's if that is `cut`.

    `sizes`: source, source_size. `weights`: source, weight; by default 1, 2, 3, repeating.
    """
    if weights is None:
        weighted = repeating_weights(sizes)
    else:
        other = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(other, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        weighted = weighted.fillna({"weight": 0.0})
    aimed = materialise(targets(materialise(weighted), most))
    aimed = aimed.withColumns({
        "blocks": F.floor(F.col("source_size") / block).cast("long"),
        "_low": F.floor(F.col("target") / block).cast("long"), "_high": F.ceil(F.col("target") / block).cast("long"),
    })
    total = aimed.agg(F.sum("target")).first()[0] or 0.0
    given = apportion(aimed, round(total / block), "target", "_high", "_low")
    # What the quota's words lack, in whole words, up or down so that the running sum of all is rounded.
    held = F.col("quota") * block
    fine = F.rint((F.col("target") - held) * 1024).cast("long")
    given = running_total(given, ["source"], fine, "_before")
    lacking = F.shiftright(F.col("_before") + fine + 512, 10) - F.shiftright(F.col("_before") + 512, 10)
    words = held + F.greatest(F.lit(-block), F.least(F.lit(block), lacking))
    whole = F.greatest(F.col("source_size"), F.lit(1))
    left = F.col("words") % whole
    exact = given.withColumn("words", F.greatest(F.lit(0), words).cast("long")).withColumns({
        "rounds": F.floor(F.col("words") / whole), "chosen": F.floor(left / block), "rest": left % block, "cut": F.col("words") < held,
    })
    return materialise(exact.select("source", "source_size", "weight", "target", "quota", "words", *_GIVEN))


def _of_shard(blocks: Column, shard: Column, shards: int) -> Column:
    """How many of the first `blocks` numbers go to a shard when they are dealt in turn."""
    return F.floor((blocks - shard + shards - 1) / shards).cast("long")


def shard_quotas(planned: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, shard, blocks: how many whole blocks each shard gives. Where a source gives its
    whole size several times, so does every shard; what is left differs by one block at most."""
    rows = planned.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    own, more = (_of_shard(F.col(c), F.col("shard"), shards) for c in ("blocks", "chosen"))
    return rows.select("source", "shard", (F.col("rounds") * own + more).alias("blocks"))


def mix(
    documents: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, most: int = MOST, seed: int = SEED, shards: int = SHARDS
) -> tuple[DataFrame, DataFrame]:
    """Per row: its columns, source_size, target, taken; and the plan per source.

    `documents`: doc_id, source, size and any narrow columns that should stay.
    """
    keyed = documents.withColumn("_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    keyed = materialise(keyed)  # the range partitioning reads it twice
    placed = materialise(running_total(keyed, ["source", "_key", "doc_id", "size"], F.col("size"), "_at"))
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_at").alias("_from"))
    sums = materialise(sums)
    planned = plan(sums.drop("_from"), weights, block, most)
    table = planned.join(
        sums.select(F.col("source").alias("_s"), "_from"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(F.col("source").alias("_s"), "source_size", "target", *_GIVEN, "_from")
    rows = placed.join(table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    begin = F.col("_at") - F.col("_from")
    end = begin + F.col("size")
    full, rounds, chosen, rest, cut = map(F.col, _GIVEN)

    def own(total: Column, i: Column) -> Column:
        """The words of block i, of [begin, end), that its shard gives."""
        shard = i % shards
        turns = F.greatest(_of_shard(full, shard, shards), F.lit(1).cast("long"))
        turn = F.pmod(F.floor(i / shards) * _step(turns) + F.pmod(F.lit(seed), turns), turns)
        quota = _of_shard(chosen, shard, shards)
        next_shard = shard == chosen % shards
        # Of the blocks up to the next one, the first and not the last is cut.
        turn = F.when(cut & next_shard & (turn <= quota), F.pmod(turn - 1, quota + 1)).otherwise(turn)
        next_one = next_shard & (turn == quota)
        given = F.when(turn < quota, F.lit(block).cast("long")).when(next_one, rest).otherwise(0)
        given = F.when(i < full, given).otherwise(F.when(chosen >= full, rest).otherwise(0))
        return total + F.greatest(F.lit(0), F.least(i * block + given, end) - F.greatest(i * block, begin))

    touched = F.sequence(F.floor(begin / block), F.floor((end - 1) / block))
    more = F.aggregate(touched, F.lit(0).cast("long"), own)
    taken = F.when(F.col("size") > 0, rounds * F.col("size") + more).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("taken", taken).drop("_key", "_at", "_from", *_GIVEN), planned


def mix_documents(documents: DataFrame, weights: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Whole rows of `documents`, each as often as the mix takes its words: the whole part of
    taken / size, and once more with the chance of the rest, by a seeded hash.

    Documents without words can't be weighed and stay once.
    """
    columns = documents.columns
    own = [F.col(f"`{c}`") for c in columns]
    keyed = documents.withColumn("__mix_key", F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b")))
    narrow = keyed.select("doc_id", "source", word_count(F.col("text")).alias("size"), "__mix_key")
    mixed, _ = mix(narrow, weights, seed=seed)
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__mix_key")), F.lit(1 << 20)) / (1 << 20)
    ratio = F.col("taken") / F.col("size")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(ratio) + (chance < ratio - F.floor(ratio)).cast("long"))
    decided = mixed.select("__mix_key", copies.alias("__mix_copies")).groupBy("__mix_key").agg(F.sum("__mix_copies").alias("__mix_copies"))
    decided = decided.where("__mix_copies > 0")
    one_each = keyed.groupBy("__mix_key").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in columns])
    rows = one_each.join(decided, "__mix_key").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
