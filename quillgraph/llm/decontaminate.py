"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

Tokens are lower-cased runs of letters and digits. A document and an item overlap when ``window`` tokens of
the item (the whole item, if shorter) stand in the document with at least ``percent`` % equal on one
diagonal. A mask of ones and zeros, laid at a token position, hashes the tokens under its ones and
ignores those under its zeros, so a substituted token under a zero leaves the hash as it was. Hashes of
the items are joined with those of the documents, and every window around a hit is compared token by
token.

The masks of each window length are complete: wherever the admitted substitutions fall, some mask fits
inside the window without touching one, so no overlap is missed, at the ends of texts neither.
``complete`` decides that by enumeration, and masks that fail it are refused.

Each item seed carries only what the windows around it can reach. The seeds are broadcast while they
take at most ``max_broadcast`` bytes, which is measured first; documents are then hashed, probed and
verified inside one stage and only verified overlaps are shuffled. More seeds are joined by shuffling
document seeds of 8 bytes and a position; their hits are then joined with the texts by id. Equal
surroundings of one item are one seed, so a repetitive text costs its length, not its square.

Defined results: null, empty and too short texts have no hits; equal documents have equal hits;
repeated rows of one id count once, as do repeated items; a null id is an id like any other; an empty
documents or benchmark table gives an empty result; items without tokens match nothing; of equal windows
the first in the document is reported; columns other than the ids and texts are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, without

WINDOW = 13
PERCENT = 80
#: Masks by window length, complete for the substitutions that 80 % admits.
MASKS = {
    13: ("11101011", "110100111"),
    12: ("11101011", "11010111", "1110010011"),
    11: ("1111011", "110001111", "1101100011"),
    10: ("111011", "1101011", "1110011"),
    9: ("1111011", "1101111"),
    8: ("111011", "110111"),
    7: ("11011",),
    6: ("11101", "10111"),
    5: ("1101", "111"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}


def complete(masks, length: int, misses: int) -> bool:
    """Whether, for any ``misses`` substituted places of ``length``, a mask fits inside without touching one."""
    laid = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(length - len(m) + 1)]
    return all(any(not ones & {*places} for ones in laid) for places in combinations(range(length), misses))


def admitted(length: int, percent: int = PERCENT) -> int:
    """How many tokens of a window may differ."""
    return length - -(-length * percent // 100)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; may begin or end with one empty token."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def _seed(mask: str) -> Column:
    """The hash under a mask laid at ``at``; null where the mask does not fit."""
    under = F.xxhash64(F.lit(int(mask, 2)), *[F.get("words", F.col("at") + i) for i, c in enumerate(mask) if c == "1"])
    return F.when(F.col("at") + len(mask) <= F.size("words"), under)


def _placed(df: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """``keep``, ``words`` and every position ``at`` where the shortest mask fits."""
    short = min(map(len, masks))
    # a condition here instead of a filter, which would be pushed down and split every text once more
    places = F.when(F.size("words") >= short, F.sequence(F.lit(0), F.size("words") - short))
    return df.select(*keep, "words", F.explode(places).alias("at"))


def _item_seeds(items: DataFrame, length: int, window: int, masks) -> DataFrame:
    """seed, item, and for the windows that hold it: where the first begins before the hit (``back``), how
    many follow it (``room``), their length (``wide``) and the item's tokens under them (``there``)."""
    chosen = items.where(F.size("words") >= length if length == window else F.size("words") == length)
    made = F.explode(F.array(*[F.struct(_seed(m).alias("seed"), F.lit(len(m)).alias("span")) for m in masks])).alias("m")
    placed = _placed(chosen, ["item"], list(masks)).select("item", "words", "at", made).where("m.seed IS NOT NULL")
    first = F.greatest(F.lit(0), F.col("at") + F.col("m.span") - length)
    last = F.least(F.col("at"), F.size("words") - length)
    return placed.select(
        F.col("m.seed").alias("seed"), "item", (F.col("at") - first).alias("back"), (last - first).alias("room"), F.lit(length).alias("wide"),
        F.slice("words", first + 1, last - first + length).alias("there"),
    ).distinct()


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    masks: dict = MASKS, window: int = WINDOW, percent: int = PERCENT, max_broadcast: int = 64 << 20,
) -> DataFrame:
    """One row per document and benchmark item with a verified overlap: ``key``, ``item_key``, the equal
    tokens of the best window, the window's length and the document's token position where it begins."""
    if window > 255:
        raise ValueError("windows hold at most 255 tokens")
    for n in range(1, window + 1):
        if not complete(masks[n], n, admitted(n, percent)):
            raise ValueError(f"the masks for windows of {n} tokens miss overlaps")
    items = benchmark.select(F.col(f"`{item_key}`").alias("item"), F.filter(tokens(F.col(f"`{item_text}`")), lambda w: w != "").alias("words")).distinct()
    lengths = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).where("n > 0").distinct().collect()]
    lengths = sorted(lengths) or [window]
    seeds = None
    for n in lengths:
        some = _item_seeds(items, n, window, masks[n])
        seeds = some if seeds is None else seeds.union(some)
    weight = F.sum(F.octet_length(F.concat_ws("  ", "there")) + 16 * F.size("there") + 96)
    few = (seeds.agg(weight.alias("w")).first()["w"] or 0) <= max_broadcast

    texts = docs.select(F.col(f"`{key}`").alias("doc"), tokens(F.col(f"`{text}`")).alias("words"))
    used = list(dict.fromkeys(m for n in lengths for m in masks[n]))
    laid = _placed(texts, ["doc"], used).select("doc", "words", "at", F.explode(F.array(*[_seed(m) for m in used])).alias("seed"))
    if few:
        hits = laid.join(F.broadcast(seeds), "seed")
    else:
        hits = laid.select("doc", "at", "seed").where("seed IS NOT NULL").join(seeds, "seed").join(texts.withColumnRenamed("doc", "of"), F.col("doc").eqNullSafe(F.col("of")))
    begin = F.col("at") - F.col("back") + F.col("r")
    # places before the document's first token and after its last are null, as are those after a short item
    spots = hits.select("doc", "item", "words", "at", "back", "wide", "there", F.explode(F.sequence(F.lit(0), F.col("room"))).alias("r"))
    same = [F.when((F.col("wide") > k) & (F.get("words", begin + k) == F.get("there", F.col("r") + k)), 1).otherwise(0) for k in range(window)]
    equal = sum(same[1:], same[0])
    verified = spots.select("doc", "item", "wide", begin.alias("begin"), equal.alias("equal")).where(100 * F.col("equal") >= percent * F.col("wide"))
    # one number, so that hash aggregation applies: more equal tokens first, then the earlier place
    late = F.lit((1 << 31) - 1) - F.col("begin").cast("long")
    rank = F.shiftleft(F.col("equal").cast("long"), 48) + F.shiftleft(late, 8) + F.col("wide")
    best = verified.groupBy("doc", "item").agg(F.max(rank).alias("best"))
    begin = F.lit((1 << 31) - 1) - F.shiftright("best", 8).bitwiseAND(F.lit((1 << 40) - 1))
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item_key), F.shiftright("best", 48).cast("int").alias("equal_tokens"),
        F.col("best").bitwiseAND(F.lit(255)).cast("int").alias("window_tokens"), begin.cast("int").alias("doc_token"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents without a verified overlap, all their columns."""
    return without(docs, key, find_overlaps(docs, benchmark, key=key, **options).select(F.col(f"`{key}`")).distinct())


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    return find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
