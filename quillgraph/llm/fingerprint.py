"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed by a rolling polynomial (computed by doubling: the hash of 2m
characters from two of m). In every window of ``W`` consecutive hashes the least is chosen, the
rightmost on ties, and each chosen hash is kept once with its position. Any passage of at least
``W + K - 1`` code points shared by two texts therefore shares a fingerprint. A text shorter than
``K`` is one gram of all its characters; one with fewer than ``W`` grams is one window.

A fingerprint is a list of (hash, position); as a string, 16 hex digits each: 8 of hash, 8 of position.
Likeness is the Jaccard index of two fingerprints' hash sets, 1 for two empty ones.

The successor of a document is the next by ``doc_id`` (nulls first, ties by the text's hash, then text),
the first one for the last. Documents are dealt into ranges of that order; the first row of every range
is also sent to the range before, so texts are shuffled once and no task sees more than its range. Ranges
end at quantiles of the ids; an id (or null) with more rows than two ranges has a range of its own, cut
into as many by the texts' hashes. The bounds, a few per range, are all that reaches the driver; rows
find their range by two steps of the root of the number of bounds.

Defined results: a null text is empty; an empty text has an empty fingerprint; a single row is its own
successor; repeated rows follow one another (in one range, as they are alike); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, materialize, mix64

K = 16
W = 32
_B = 0x5851F42D4C957F2D


def winnow(text: str, k: int = K, w: int = W) -> np.ndarray:
    """(hash << 32 | position) of the chosen grams, by position. ``k`` is a power of two."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(a)
    if not n:
        return a
    if n < k:
        h = np.zeros(1, np.uint64)
        for c in a:
            h = h * np.uint64(_B) + c + np.uint64(1)
    else:
        h, span, base = a + np.uint64(1), 1, _B
        while span < k:
            h = h[:-span] * np.uint64(base) + h[span:]
            span, base = 2 * span, base * base % (1 << 64)
    h = mix64(h) >> np.uint64(32)
    m = len(h)
    if m >= 1 << 32:
        raise ValueError("a text of 2**32 code points or more")
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
    low, span = key, 1
    w = min(w, m)
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: m - w + 1], low[w - span :])
    keep = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=keep[1:])
    low = low[keep]
    return (low & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF)))


def show(prints: np.ndarray) -> str:
    return prints.astype(">u8").tobytes().hex()


def hashes(prints: np.ndarray) -> np.ndarray:
    return np.unique(prints >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted distinct hash arrays."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` (rounded down) replaced by as many first characters of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rank(column, bounds: list, strict: bool):
    """How many of the ascending ``bounds`` are below the column, or equal unless ``strict``; 0 for nulls."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    passed = lambda m: (m < column) if strict else (m <= column)
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    coarse = F.size(F.filter(array([r[0] for r in runs]), passed))
    run = F.get(F.array(*[array(r) for r in runs]), coarse - 1)
    return F.coalesce((coarse - 1) * width + F.size(F.filter(run, passed)), F.lit(0))


def _ranges(keys: DataFrame, count: int):
    """For rows (id, h): a function that adds ``p``, the row's range, and ``starts``, whether the row sorts first
    in it, and ``back``, the range before; about ``count`` ranges, told apart by what a few jobs over keys give."""
    total = keys.count()
    target = max(1, total // count)
    cuts = keys.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 100 * count).alias("c")).first()["c"] or []
    heavy = keys.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * target).select("id").collect()
    hot = sorted(r["id"] for r in heavy)
    marks = sorted({*cuts, *hot})
    # 0 for nulls; a heavy id has a number of its own
    place = F.when(F.col("id").isNull(), F.lit(0)).otherwise(1 + _rank(F.col("id"), marks, False) + _rank(F.col("id"), hot, True))
    single = F.col("id").isNull() | F.coalesce(F.array_contains(F.array(*[F.lit(x) for x in hot]), F.col("id")), F.lit(False)) if hot else F.col("id").isNull()
    sizes = keys.groupBy(place.alias("b"), single.alias("single")).agg(F.count(F.lit(1)).alias("n")).where("single").collect()
    cut = {r["b"]: -(-r["n"] // target) for r in sizes if r["n"] > 2 * target}
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])[place], F.lit(1)) if cut else F.lit(1)
    # hashes are even, so equal stretches of them hold about as many rows
    sub = F.when(single, F.floor((F.shiftright("h", 11) + F.lit(1 << 52)) / F.lit(float(1 << 53)) * parts)).otherwise(F.lit(0)).cast("int")
    firsts = keys.groupBy(place.alias("b"), sub.alias("sub")).agg(F.min(F.struct(F.col("id"), F.col("h"))).alias("first"))
    rows = sorted((r["b"], r["sub"], r["first"]["id"], r["first"]["h"]) for r in firsts.collect()) if total else []
    table = [(b, k, i, rows_i[2], rows_i[3], (i - 1) % len(rows)) for i, rows_i in enumerate(rows) for b, k in [rows_i[:2]]]
    kind = keys.schema["id"].dataType.simpleString()
    known = F.broadcast(keys.sparkSession.createDataFrame(table, f"b int, sub int, p int, first_id {kind}, first_h long, back int"))

    def deal(df: DataFrame) -> DataFrame:
        dealt = df.withColumn("b", place.cast("int")).withColumn("sub", sub).join(known, ["b", "sub"])
        return dealt.withColumn("starts", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).drop("b", "sub", "first_id", "first_h")

    return deal


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to that and to the next document's."""
    spark = df.sparkSession
    arrow_rows(spark)
    narrow = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    count = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, _ = materialize(narrow.select("id", "h"), "keys")
    deal = _ranges(keys, count)
    here = F.struct(F.col("p"), F.lit(0).alias("copy"))
    # every row alike to the first of a range goes to the range before as well; only one is used there
    to = F.when(F.col("starts"), F.array(here, F.struct(F.col("back").alias("p"), F.lit(1).alias("copy")))).otherwise(F.array(here))
    dealt = (
        deal(narrow)
        .select("id", "t", "h", F.explode(to).alias("to"))
        .select("id", "t", "to.p", "to.copy", "h")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p")
        .sortWithinPartitions("p", "copy", F.col("id").asc_nulls_first(), "h", "t")
    )
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        held = None  # (bucket, id, text, prints, hashes)
        done = None  # bucket whose copied row was used
        for batch in batches:
            out = []
            ids = batch.column(0)
            for i, (t, p, copy) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if held is not None and held[0] != p:
                    raise RuntimeError("a range without its successor row")
                if copy and (held is None or done == p):
                    continue
                prints = winnow(t, k, w)
                own = hashes(prints)
                if held is not None:
                    changed = edited(held[2], t)
                    new = winnow(changed, k, w)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(held[2]), digest, show(held[3]), show(new), likeness(held[4], hashes(new)), likeness(held[4], own)))
                held, done = (None, p) if copy else ((p, ids[i], t, prints, own), done)
            if out:
                cols = list(zip(*out))
                kinds = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                cols[0] = [x.as_py() for x in cols[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        if held is not None:
            raise RuntimeError("a range without its successor row")

    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
