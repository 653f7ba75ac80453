"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Targets: all sources share ``share`` times the words there are by weight; no source's target passes
``repeat`` times its own words, and what it leaves is shared again by weight (water filling). The level is
found in a few aggregations over the sources, each of which tells who is full at the level so far.

Quotas: words are dealt in equal blocks of ``block_words``. The blocks of the whole mix go to sources, each
source's blocks to its parts and each part's to its shards, by highest quotients ``weight / (2 k + 1)``. At
the divisor ``total / seats`` all but a few seats per row are certain, so only the marginal quotients are
ranked. Sources are ranked range by range, so no task holds them all.

Shards: a source is cut into shards of about ``shard_words`` words by a seeded hash of the document, however
many that takes, and they are grouped into about as many parts as a part has shards; so a source of any
size is worked on by many tasks and no apportionment has more rows than the root of its shards. Within
a shard documents stand in seeded order and their words form one run cut into blocks. A quota of q of
n blocks takes every block q div n times and q mod n of them once more: those that a seeded
permutation ``(a b + c) mod n`` puts first. A document takes what it has of each block, so none
exceeds ``repeat`` times its size.

Defined results: null texts have size 0; a null source is a source of its own, after all others; documents
of size 0 take 0; rows with one id, source and text are told apart by a running number, so a repeated or
null id gathers in no shard; an empty table gives an empty result; other columns are not read (with
``texts`` they are kept). Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize

WEIGHTS = (3, 1, 2)
SEED = 20240607
_WORD = r"[^\x20\x09-\x0D]+"
#: Primes below 2**31, each prime to any number of blocks in a shard.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD)).cast("long")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``name``, the row's number from 1 in ``order``: ranges are counted, then rows within a range."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, number.cast("long")).drop("__part", "__before")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which ``weight`` times it, at most ``cap``, sums to ``total``; infinite if the caps do not.

    From below: those full at the level so far leave the rest to the others, which raises it. All sums
    are of whole numbers, so reruns agree.
    """
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not got["weight"]:
            return float("inf")
        higher = (total - (got["cap"] or 0)) / got["weight"]
        if not higher > level:
            return level
        level = higher


def _margin(rows: DataFrame, weight: str, seats: Column, whole: Column, count: Column, near_sum) -> DataFrame:
    """Adds __sure and __reach: a row's seats lie between __sure and __sure + 2 __reach + 1 of them."""
    near = F.when(whole > 0, F.floor(F.col(weight) * seats / whole + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("__near", near)
    off = F.abs(near_sum(rows) - seats)
    return rows.withColumn("__reach", F.when(F.col(weight) > 0, F.ceil(F.col(weight) / whole * (count + off)) + 1).otherwise(F.lit(0)).cast("long")).withColumn(
        "__sure", F.greatest(F.lit(0).cast("long"), F.col("__near") - F.col("__reach"))
    )


def _quotients(counted: DataFrame, keep: list[str], weight: str) -> DataFrame:
    tried = F.explode(F.sequence(F.col("__sure"), F.col("__near") + F.col("__reach"))).alias("__k")
    return counted.where(F.col(weight) > 0).select(*keep, weight, tried).withColumn("__quotient", F.col(weight) / (2 * F.col("__k") + 1))


def _dealt(counted: DataFrame, won: DataFrame, on: list[str]) -> DataFrame:
    won = won.groupBy(*on).agg(F.count(F.lit(1)).alias("__won"))
    quota = F.col("__sure") + F.coalesce(F.col("__won"), F.lit(0))
    return counted.join(won, on, "left").withColumn("quota", quota).drop("__near", "__reach", "__sure", "__left", "__won")


def sainte_lague(rows: DataFrame, group: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: each group's ``seats`` (one number per group) dealt to its rows by highest quotients.

    Rows of weight 0 get none. ``group`` plus ``order`` must identify a row; ties go by ``order``. A group's
    rows meet in one task, so groups must be bounded.
    """
    per = Window.partitionBy(*group)
    counted = _margin(rows, weight, F.col(seats), F.sum(weight).over(per).cast("double"), F.count(F.lit(1)).over(per), lambda r: F.sum("__near").over(per))
    counted = counted.withColumn("__left", F.col(seats) - F.sum("__sure").over(per))
    ranked = _quotients(counted, [*group, *order, "__left"], weight)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__quotient").desc(), *order, "__k"))
    return _dealt(counted, ranked.withColumn("__rank", place).where(F.col("__rank") <= F.col("__left")), [*group, *order])


def sainte_lague_all(rows: DataFrame, order: str, weight: str, seats: int, whole: float) -> DataFrame:
    """As ``sainte_lague`` with all of ``rows`` as one group of any size; ``whole`` is the sum of weights."""
    count = rows.count()
    near_sum = lambda r: F.lit(r.agg(F.sum("__near")).first()[0] or 0)
    counted, path = materialize(_margin(rows, weight, F.lit(seats), F.lit(whole), F.lit(count), near_sum), "seats")
    left = seats - (counted.agg(F.sum("__sure")).first()[0] or 0)
    ranked = numbered(_quotients(counted, [order], weight), "__rank", F.col("__quotient").desc(), order, "__k")
    dealt, _ = materialize(_dealt(counted, ranked.where(F.col("__rank") <= left), [order]), "sources")
    discard(rows.sparkSession, path)
    return dealt


def mix_sources(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, repeat: int = 2,
    block_words: int = 64, shard_words: int = 262_144, max_broadcast: int = 1_000_000, seed: int = SEED, texts: bool = False,
) -> DataFrame:
    """``key``, size, source_size, target and taken of every document; with ``texts`` all columns of ``df`` and
    those four, its text being the words that the mix takes of it, as often as it does, between blanks."""
    from_source = F.col(f"`{source}`").cast("string")
    sk = F.when(from_source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), from_source))
    told = [F.col(f"`{c}`") for c in df.columns] if texts else [F.col(f"`{text}`")]
    same = F.xxhash64(*told)
    sized, _ = materialize(df.select(F.col(f"`{key}`").alias("id"), sk.alias("sk"), same.alias("h"), word_count(F.col(f"`{text}`")).alias("size")), "mix-sizes")
    copies = sized.groupBy("id", "sk", "h", "size").agg(F.count(F.lit(1)).alias("m"))
    base, _ = materialize(copies.select("id", "sk", "h", "size", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("j")), "mix-rows")

    sources = numbered(base.groupBy("sk").agg(F.sum("size").alias("source_size")), "turn", "sk")
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod(F.col("turn") - 1, F.lit(len(weights))).cast("int")]
    sources, _ = materialize(sources.select("sk", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeat).alias("cap")), "mix-targets")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    total = min(float(words * repeat), words * share)
    level = water_level(sources, words * share)
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) if level < float("inf") else F.col("cap").cast("double"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    parts = F.ceil(F.sqrt(shards)).cast("long")
    sources = sainte_lague_all(sources, "sk", "target", round(total / block_words), total).select(
        "sk", "source_size", "target", F.col("quota").alias("seats"), parts.alias("parts"), F.ceil(shards / parts).cast("long").alias("each")
    )
    sources = F.broadcast(sources) if sources.count() <= max_broadcast else sources

    row = ["id", "h", "j"]
    placed = base.join(sources.select("sk", "parts", "each", "seats"), "sk")
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), *row), F.col("parts"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 3), *row), F.col("each")))
    sums = placed.groupBy("sk", "part", "shard").agg(F.sum("size").alias("shard_size"), F.max("seats").alias("seats"))
    shards, _ = materialize(sums.withColumn("blocks", F.ceil(F.col("shard_size") / block_words).cast("long")), "mix-shards")
    grouped = shards.groupBy("sk", "part").agg(F.sum("blocks").alias("part_blocks"), F.sum("shard_size").alias("part_size"), F.max("seats").alias("seats"))
    # a shard's last block is not full, so a seat is worth a little less than a block: as many more make up for it
    of_source = Window.partitionBy("sk")
    worth = F.try_divide(F.sum("part_size").over(of_source).cast("double"), F.sum("part_blocks").over(of_source))
    grouped = grouped.withColumn("seats", F.when(worth > 0, F.round(F.try_divide(F.col("seats") * block_words, worth))).otherwise(F.lit(0)).cast("long"))
    part_seats = sainte_lague(grouped, ["sk"], ["part"], "part_blocks", "seats").select("sk", "part", F.col("quota").alias("part_seats"))
    draw = F.xxhash64(F.lit(seed + 1), "sk", "part", "shard")
    shards = sainte_lague(shards.drop("seats").join(part_seats, ["sk", "part"]), ["sk", "part"], ["shard"], "blocks", "part_seats").select(
        "sk", "part", "shard",
        F.greatest(F.col("blocks"), F.lit(1)).alias("n"),
        F.least(F.col("quota"), repeat * F.col("blocks")).alias("quota"),
        F.array(*[F.lit(p) for p in _PRIMES])[F.pmod(draw, F.lit(len(_PRIMES))).cast("int")].cast("long").alias("a"),
        F.pmod(F.shiftright(draw, 8), F.greatest(F.col("blocks"), F.lit(1))).alias("c"),
    )
    shards, _ = materialize(shards, "mix-quotas")

    run = Window.partitionBy("sk", "part", "shard").orderBy(F.xxhash64(F.lit(seed + 2), *row), *row).rowsBetween(Window.unboundedPreceding, -1)
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    within = F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words))
    first = lambda b: F.pmod(F.pmod(F.col("a"), F.col("n")) * b + F.col("c"), F.col("n")) < F.pmod(F.col("quota"), F.col("n"))
    has = lambda b: F.least(end, (b + 1) * block_words) - F.greatest(begin, b * block_words)
    more = F.aggregate(within, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.when(first(b), has(b)).otherwise(F.lit(0).cast("long")))
    rounds = F.floor(F.col("quota") / F.col("n"))
    taken = (
        placed.drop("seats", "parts", "each")
        .withColumn("begin", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(shards, ["sk", "part", "shard"])
        .withColumn("taken", F.when(F.col("size") > 0, rounds * F.col("size") + more).otherwise(F.lit(0).cast("long")))
        .join(sources.select("sk", "source_size", "target"), "sk")
    )
    if not texts:
        return taken.select(F.col("id").alias(key), "size", "source_size", "target", "taken")
    # rows alike in all columns are one row of the texts and several of the mix
    rows = taken.select("id", "h", "begin", "size", "source_size", "target", "taken", "quota", "n", "a", "c")
    whole = df.select(*[F.col(f"`{c}`").alias(f"__c_{i}") for i, c in enumerate(df.columns)], same.alias("__h"), F.col(f"`{key}`").alias("__id")).dropDuplicates(["__id", "__h"])
    found = rows.join(whole, rows["id"].eqNullSafe(whole["__id"]) & (rows["h"] == whole["__h"]))
    words = F.regexp_extract_all(F.coalesce(F.col(f"__c_{df.columns.index(text)}").cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))
    part = lambda b: F.slice("__words", (F.greatest(begin, b * block_words) - begin + 1).cast("int"), has(b).cast("int"))
    mixed = F.concat(F.flatten(F.array_repeat(F.col("__words"), rounds.cast("int"))), F.flatten(F.transform(F.filter(within, first), part)))
    mixed = F.when(F.col("size") > 0, F.array_join(mixed, " ")).otherwise(F.lit(""))
    added = ["size", "source_size", "target", "taken"]  # these win over columns of their names
    columns = [(mixed if c == text else F.col(f"__c_{i}")).alias(c) for i, c in enumerate(df.columns) if c not in added]
    return found.withColumn("__words", words).select(*columns, *added)


def op4_mixing(spark, sf_dir) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
