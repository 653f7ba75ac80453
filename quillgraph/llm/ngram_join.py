"""N-gram Jaccard self-join by grouped prefixes: exact links, connected into components.

A document's set holds its distinct five-word shingles (A-Z lower-cased; fewer words: the whole
sequence), as 64-bit hashes. Two documents link when ``100 |A n B| >= 80 |A u B|``.

1. Order. Shingles are ordered cold first by hash, then hot by rising count: a shingle is hot if it is
   among the least 40 % of at least four sets of one class of ``hot / 4`` by id and text, or in ``hot`` sets
   of a quarter of that class (which chooses an order, never a result). About ``max_hot`` hot ones are broadcast (16 bytes each). Any order gives right results; this one keeps shared passages out of prefixes.
2. Groups. Equal sets are one class (a 64-bit digest of the set, so two of n different sets are taken for
   one with probability n**2 / 2**65); classes with equal prefix, the first
   ``n - ceil(0.8 n) + 1`` shingles, and equal size are one group. Linked sets share a prefix shingle.
3. Candidates, first round: in each shingle's list of groups a group is paired with the one before it by
   size and with the most central one of each of two overlapping size bands: the one with the fewest cold
   shingles in its prefix, as an original has fewer rare shingles than its edited copies. Hot lists are
   salted and joined up by their most central members. So a list of m groups gives about 3 m pairs.
   Members of one group pair with its first.
4. Verification: pairs that pass the size filter and a parity-bitmap bound on the overlap (both exact)
   are intersected in full, and the links connected.
5. Candidates, second round: only lists whose members are not yet all in one component are expanded, to
   the pairs of members of different components whose sizes and bitmaps allow a link, both checked in
   the join itself, each in the first list the two share (as far as their ``_FIRST`` least lists tell; a
   pair that is found twice is verified once); these are verified and connected too. Every pair
   of linked documents is thus either tested or already in one component, so components are exact.

Defined results: documents without words or text (null or empty) have no shingles, link with nothing
and are components of their own; equal texts always share a component, repeated rows too; very long
texts are hashed in pieces; an empty table gives an empty result; other columns are not read. Ids are
integers; a row with a null id is returned with a null component and links nobody else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, documents, materialize, most_frequent, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
_BITS = 1024
_FIRST = 16
_SPREAD = 8


def _step(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A step's table, without the shuffle files that led to it: those of all steps together need more disk than any step."""
    return materialize(df, name, release=True)


def _digest(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(np.ascontiguousarray(flat)))


def hot_shingles(texts: DataFrame, hot: int, max_hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and their ranks by rising count, of shingles in the low part of many sets of one
    class of rows, or anywhere in many sets of a quarter of it: those may reach prefixes whose low part is hot.
    Only the order follows from them, so the other classes' shingles are not counted."""
    block, classes = 1 << 20, max(1, hot // 4)
    zeros = np.zeros

    def run(batches):
        low, high, size = [], [], 0

        def flush():
            (a, n), (b, m) = (np.unique(np.concatenate(x) if x else zeros(0, np.uint64), return_counts=True) for x in (low, high))
            n, m = np.concatenate([n, zeros(len(b), np.int64)]), np.concatenate([zeros(len(a), np.int64), m])
            return pa.RecordBatch.from_arrays([_signed(np.concatenate([a, b])), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["s", "n", "m"])

        for batch in batches:
            for t, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_hashes(word_hashes(t), SHINGLE)
                cut = len(s) * 2 // 5 + 1
                low.append(s[:cut])
                size += len(low[-1])
                if whole:
                    high.append(s[cut:])
                    size += len(high[-1])
                if size >= block:
                    yield flush()
                    low, high, size = [], [], 0
        if size:
            yield flush()

    of = lambda n: F.pmod(F.xxhash64("id", "t"), F.lit(n)) == 0
    chosen = texts.where(of(classes)).select("t", of(4 * classes).alias("whole"))
    counted = chosen.mapInArrow(run, "s long, n long, m long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    counted = counted.where((classes * F.col("n") >= hot) | (F.col("m") >= hot)).select("s", (F.col("n") + 4 * F.col("m")).alias("c"))
    counted, path = _step(counted, "hot")
    top = most_frequent(counted, "s", "c", max_hot).toArrow()
    discard(texts.sparkSession, path)
    values = top["s"].to_numpy().view(np.uint64)
    order = np.lexsort((values, top["c"].to_numpy()))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    by_value = np.argsort(values)
    return values[by_value], rank[by_value]


def _prefixes(texts: DataFrame, hot) -> DataFrame:
    """id, n, cls, gid, parity bitmap, the number of cold shingles in the prefix, and its cold and hot
    shingles (once per gid and task)."""

    def run(batches):
        values, ranks = hot.value
        seen: set[int] = set()
        for batch in batches:
            ns, classes, groups, bits, rares, colds, hots = [], [], [], [], [], [], []
            nothing = np.empty(0, np.uint64)
            for t in batch.column(1).to_pylist():
                s = shingle_hashes(word_hashes(t), SHINGLE)
                n = len(s)
                ns.append(n)
                if not n:
                    rares.append(0)
                    for out in (classes, groups):
                        out.append(None)
                    for out in (bits, colds, hots):
                        out.append(nothing)
                    continue
                classes.append(_digest(s.tobytes()))
                take = n + (-PERCENT * n // 100) + 1
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    is_hot = values[at] == s
                    cold = s[~is_hot][:take]
                    rest = s[is_hot][np.argsort(ranks[at[is_hot]])][: take - len(cold)]
                else:
                    cold, rest = s[:take], nothing
                group = _digest(n.to_bytes(8, "little"), cold.tobytes(), b"|", rest.tobytes())
                groups.append(group)
                parity = np.bincount((s % np.uint64(_BITS)).astype(np.int64), minlength=_BITS) & 1
                bits.append(np.packbits(parity.astype(bool), bitorder="little").view(np.uint64))
                rares.append(len(cold))
                if group in seen:
                    cold = rest = nothing
                elif len(seen) < 1_000_000:
                    seen.add(group)
                colds.append(cold)
                hots.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(groups, pa.int64()), _lists(bits), pa.array(rares, pa.int64()), _lists(colds), _lists(hots)],
                names=["id", "n", "cls", "gid", "bits", "rare", "cold", "hot"],
            )

    return texts.select("id", "t").mapInArrow(run, "id long, n long, cls long, gid long, bits array<long>, rare long, cold array<long>, hot array<long>")


def _ordered(a, b):
    """The pair of two columns with the lesser first."""
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _neighbours(lists: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (a, b) of groups: each with the one before it by size, and with the most central of its bands."""
    steps = F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))
    central = lambda band: F.first(F.struct("gid", "n")).over(Window.partitionBy(*key, band).orderBy("rare", "n", "gid"))
    chain = F.lag(F.struct("gid", "n")).over(Window.partitionBy(*key).orderBy("n", "gid"))
    seen = lists.withColumn("band", F.floor(steps)).withColumn("other", F.floor(steps + 0.5))
    seen = seen.select("gid", "n", chain.alias("x"), central("band").alias("y"), central("other").alias("z"))
    return (
        seen.select("gid", "n", F.explode(F.array("x", "y", "z")).alias("o"))
        .where(F.col("o").isNotNull() & (F.col("o.gid") != F.col("gid")))
        .where((100 * F.col("o.n") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("o.n")))
        .select(*_ordered(F.col("gid"), F.col("o.gid")))
    )


def _with_least(edges: DataFrame, least: DataFrame, node: str, hub: int | None) -> DataFrame:
    """``edges`` joined by ``node`` with ``least`` (``node``, m, degree). Nodes of at least ``hub`` edges are
    broadcast, so no task gets all edges of one node."""
    plain = least.select(node, "m")
    if hub is None:
        return edges.join(plain, node)
    hubs = F.broadcast(least.where(F.col("degree") >= hub).select(node, "m"))
    return edges.join(hubs, node).unionByName(edges.join(hubs, node, "left_anti").join(plain, node))


def connected_components(edges: DataFrame, many: int = 1_000_000) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b): the least node it reaches.

    Alternating large-star and small-star contraction; each round is a grouped minimum and a join, and
    is written to the shared folder. Rounds grow with the logarithm of the longest path. From ``many``
    edges on, a node with a thousandth of them is a hub; there are at most 2,000.
    """
    spark = edges.sparkSession
    now, path = _step(edges.where("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "components")
    mark, count = None, now.count()
    while True:
        hub = max(2, count // 1000) if count >= many else None
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = _with_least(both.where("b > a"), least, "a", hub).select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # here u > v for every row: each node's smaller neighbours
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _with_least(large, low, "u", hub).select(F.explode(F.array(F.struct(F.col("u").alias("b"), F.col("m").alias("a")), F.struct(F.col("v").alias("b"), F.col("m").alias("a")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        new, new_path = _step(small, "components")
        sums = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        discard(spark, path)
        now, path = new, new_path
        if mark == sums:
            break
        mark, count = sums, sums["n"]
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


class _Sets:
    """The shingle sets of the classes that occur in candidate pairs, one document read per class."""

    def __init__(self, texts: DataFrame, table: DataFrame):
        self.texts = texts
        self.firsts = table.where("cls IS NOT NULL AND id IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id"))

    def of(self, pairs: DataFrame) -> DataFrame:
        spark = pairs.sparkSession
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.firsts, "cls").select("id")
        needed, path = _step(needed, "needed")
        count = needed.count()
        size = 1 << min(26, max(12, (16 * count).bit_length()))
        slot = lambda: F.pmod(F.xxhash64("id"), F.lit(size))
        words = needed.select(slot().alias("k")).groupBy(F.shiftright("k", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 AS int))")).alias("v")).toArrow()
        bitmap = np.zeros(size // 64, np.uint64)
        bitmap[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(bitmap)

        def run(batches):
            bits = shared.value
            for batch in batches:
                k = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.flatnonzero((bits[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1))
                sets = [shingle_hashes(word_hashes(t), SHINGLE) for t in batch.column(2).take(pa.array(hit)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(hit)), pa.array([_digest(s.tobytes()) for s in sets], pa.int64()), _lists(sets)], names=["id", "cls", "set"]
                )

        found = self.texts.where("id IS NOT NULL").select("id", slot().alias("k"), "t").mapInArrow(run, "id long, cls long, set array<long>")
        # a repeated id may bring a class twice: classes are told apart by their first row
        first = Window.partitionBy("cls").orderBy("id")
        found = found.join(needed, "id", "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").select("cls", "set")
        out, out_path = _step(found, "sets")
        discard(spark, path)
        self.path = out_path
        return out


def _facts(table: DataFrame) -> DataFrame:
    return table.where("cls IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))


def _may_link(na, xa, nb, xb):
    """Whether the sizes and parity bitmaps of two sets allow a link: each differing bit is a shingle of one set only."""
    apart = sum((F.bit_count(xa[i].bitwiseXOR(xb[i])) for i in range(_BITS // 64)), F.lit(0))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * (na + nb - apart) >= 2 * PERCENT * (na + nb))


def _bounded(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and parity bitmaps allow a link."""
    joined = pairs.join(_facts(table).toDF("a", "na", "xa"), "a").join(_facts(table).toDF("b", "nb", "xb"), "b")
    return joined.where(_may_link(F.col("na"), F.col("xa"), F.col("nb"), F.col("xb"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("cls").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").withColumn("i", shared).where(100 * F.col("i") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table of narrow rows, broadcast if it has at most ``most`` of them."""
    return F.broadcast(df) if df.count() <= most else df


def _crossing(rows: DataFrame, list_rows: int, open_lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (s, cls, c, n, bits, firsts) of one list in different components whose sizes
    and bitmaps allow a link. Members meet only those of their own size band and the one below; a list of
    more than ``list_rows`` members is cut into parts, each of which meets all members in a task of its own.
    There are at most as many such lists as rows divided by ``list_rows``, so they are broadcast."""
    big = open_lists.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > list_rows)
    parts = big.select("s", F.ceil(F.col("m") / list_rows).cast("int").alias("parts"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    rows = rows.join(F.broadcast(parts), "s", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("band", band)
    x = rows.select("s", F.col("band").alias("at"), F.pmod("cls", F.col("parts").cast("long")).cast("int").alias("part"), "band", "cls", "c", "n", "bits", "firsts")
    y = rows.select("s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("at"), "parts", "band", "cls", "c", "n", "bits", "firsts")
    y = y.select("s", "at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "band", "cls", "c", "n", "bits", "firsts")
    x, y = x.toDF("s", "at", "part", "da", "a", "ca", "na", "xa", "fa"), y.toDF("s", "at", "part", "db", "b", "cb", "nb", "xb", "fb")
    crossing = x.join(y, ["s", "at", "part"]).where(
        ((F.col("da") > F.col("db")) | (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb")) & _may_link(F.col("na"), F.col("xa"), F.col("nb"), F.col("xb"))
        & F.coalesce(F.array_min(F.array_intersect("fa", "fb")) >= F.col("s"), F.lit(True))
    )
    return crossing.select(*_ordered(F.col("a"), F.col("b")))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = 16, max_hot: int = 1_000_000, salts: int = 32, list_rows: int = 256) -> DataFrame:
    """``key``, n_shingles and component_id (the least key reachable by links) of every document."""
    spark = df.sparkSession
    arrow_rows(spark)
    texts = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    shared = spark.sparkContext.broadcast(hot_shingles(texts, hot, max_hot))
    table, _ = _step(_prefixes(texts, shared), "prefixes")

    colds = table.where(F.size("cold") > 0).select("gid", "n", "rare", F.explode("cold").alias("s"), F.lit(-1).alias("salt"))
    hots = table.where(F.size("hot") > 0).select("gid", "n", "rare", F.explode("hot").alias("s"), F.pmod("gid", F.lit(salts)).cast("int").alias("salt"))
    entries = colds.union(hots)
    listed = Window.partitionBy("s", "salt")
    shares = entries.select("gid", "n", "rare", "s", "salt", F.min("gid").over(listed).alias("lo"), F.max("gid").over(listed).alias("hi"))
    lists, lists_path = _step(shares.where("lo <> hi OR salt >= 0").select("gid", "n", "rare", "s", "salt").distinct(), "lists")

    # of each salted part, the most central of each size band
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    heads = Window.partitionBy("s", "salt", "band").orderBy("rare", "n", "gid")
    tops = lists.where("salt >= 0").withColumn("band", band).withColumn("k", F.row_number().over(heads)).where("k = 1").select("gid", "n", "rare", "s")
    near = _neighbours(lists, ["s", "salt"]).union(_neighbours(tops, ["s"])).distinct()
    groups = table.where("gid IS NOT NULL").groupBy("gid").agg(F.min("cls").alias("rep"), F.max("cls").alias("top"))
    # a central group has very many pairs: its representative is sent to several tasks, its pairs are dealt among them
    spread_out = F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1)))
    reps = groups.select("gid", "rep", spread_out.alias("k"))
    dealt = lambda other: F.pmod(F.xxhash64(other), F.lit(_SPREAD)).cast("int").alias("k")
    by_rep = near.select("a", "b", dealt("b")).join(reps.toDF("a", "ra", "k"), ["a", "k"]).select("ra", "b", dealt("ra")).join(reps.toDF("b", "rb", "k"), ["b", "k"])
    pairs = (
        by_rep.select(*_ordered(F.col("ra"), F.col("rb")))
        .union(table.join(groups.where("rep <> top"), "gid").where("cls <> rep").select(*_ordered(F.col("cls"), F.col("rep"))))
        .distinct()
    )
    pairs, pairs_path = _step(_bounded(pairs, table), "pairs")
    finder = _Sets(texts, table)
    sets = finder.of(pairs)
    links, links_path = _step(_verified(pairs, sets), "links")
    discard(spark, finder.path)
    components, _ = _step(connected_components(links), "component")

    # second round: lists that are not yet one component, member by member
    members = table.where("gid IS NOT NULL").select("gid", "cls", "n").distinct()
    placed = members.join(components.withColumnRenamed("node", "cls"), "cls", "left").select("gid", "cls", "n", F.coalesce("component", "cls").alias("c"))
    placed, placed_path = _step(placed, "placed")
    spread, spread_path = _step(placed.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "spread")
    mixed = lists.join(_few(spread), "gid").groupBy("s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("s")
    mixed, mixed_path = _step(mixed, "mixed")
    inside = spread.where("lo <> hi").select("gid", F.col("gid").alias("s"))
    open_lists = lists.select("gid", "s").join(_few(mixed), "s", "left_semi").union(inside.select("gid", "s"))
    open_lists, open_path = _step(open_lists.join(placed, "gid").select("s", "cls", "c").distinct(), "open")
    firsts = open_lists.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("s")), 1, _FIRST).alias("firsts"))
    rows = open_lists.join(_facts(table).join(firsts, "cls"), "cls").select("s", "cls", "c", "n", "bits", "firsts")
    crossing = _crossing(rows, max(list_rows, open_lists.count() // 100_000), open_lists)
    more, more_path = _step(crossing.select("a", "b").distinct(), "pairs")
    if more.limit(1).count():
        sets = finder.of(more)
        found, found_path = _step(_verified(more, sets), "links")
        discard(spark, finder.path)
        if found.limit(1).count():
            components, _ = _step(connected_components(links.union(found)), "component")

    least = table.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id"))
    labelled = least.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls"))
    ids = labelled.groupBy("c").agg(F.min("id").alias("component_id"))
    classes, _ = _step(labelled.join(ids, "c").select("cls", "component_id"), "classes")
    discard(spark, lists_path, pairs_path, links_path, placed_path, spread_path, mixed_path, open_path, more_path)
    out = table.select("id", "n", "cls").join(classes, "cls", "left")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )


def op10_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, l, unnest(CASE WHEN len(l) >= 5 THEN range(1, len(l) - 3) WHEN len(l) > 0 THEN [1] ELSE [] END) AS i FROM w)
), n AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(nx.n) AS na, any_value(ny.n) AS nb
  FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n AS nx ON nx.doc_id = x.doc_id JOIN n AS ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))
), r AS (
  SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.reached) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
"""
