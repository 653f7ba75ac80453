"""Shared helpers: shared-folder tables, Arrow row streaming and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.scratch import discard, folder, shared_dir, table_path

#: Rows handed to Python at once, one number for all operators, so the order in which queries are built
#: changes nothing; Spark bounds a batch's bytes besides.
ARROW_ROWS = 512


_written: list[str] = []


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, release: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    With ``release`` the shuffle files of the write go when it ends, and not when the driver next happens to
    collect its garbage; ``df`` itself can still be run again.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    _written.append(path)
    before = spark.conf.get(_RELEASE, "false")
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if release:
            spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path), path


def run_stage(spark: SparkSession, name: str, make: Callable[[], DataFrame], resume: str | None = None) -> tuple[DataFrame, str]:
    """The table that ``make`` gives, written and read again; what it wrote on the way is removed.

    With ``resume``, the name of a run, the table has a fixed place and stays, and one that an earlier driver
    finished writing there is read instead of made again.
    """
    before = len(_written)
    if resume is None:
        table, path = materialize(make(), name)
    else:
        path = f"{shared_dir(spark)}/{resume}/{name}"
        done, files = folder(spark, f"{path}/_SUCCESS")
        if not files.exists(done):
            make().write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
    discard(spark, *(p for p in _written[before:] if p != path))
    del _written[before:]
    return table, path


def without(df: DataFrame, key: str, gone: DataFrame, max_broadcast: int = 500_000) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``gone`` (one column of distinct keys); a null key goes only
    if ``gone`` holds null. The keys are written and counted: up to ``max_broadcast`` are broadcast, so no
    text is shuffled; more are joined by shuffling."""
    gone, _ = materialize(gone.toDF("__qg_gone"), "gone")
    gone = F.broadcast(gone) if gone.count() <= max_broadcast else gone
    return df.join(gone, df[key].eqNullSafe(F.col("__qg_gone")), "left_anti")


def arrow_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[str], tuple], fields: str) -> DataFrame:
    """``keep`` columns plus the ``fields`` that ``fn`` derives from each text (null: empty)."""
    arrow_rows(df.sparkSession)
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    types = {f.name: f.dataType for f in narrow.schema}
    kept = ", ".join(f"`{c}` {types[c].simpleString()}" for c in keep)
    schema = f"{kept}, {fields}" if kept else fields
    names = [x.split()[0] for x in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            made = [fn(t or "") for t in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*made)) if made else [[] for _ in names]
            kinds = kinds or [ARROW_TYPES[x.split()[1]] for x in fields.split(",")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=keep + names
            )

    return narrow.mapInArrow(run, schema)


def most_frequent(counted: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, about ``most``: those above the least of a ladder of marks, eight to
    a doubling, that leaves few enough, and of the next step those whose key's hash falls in the part there
    is room for. No task sorts or holds more than its own rows."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 8)
    steps = counted.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least, part = most, None, 0
    for r in sorted(steps, key=lambda r: -r["k"]):
        least = r["k"]
        part = min(1 << 20, (room << 20) // r["n"])
        room -= r["n"]
        if room <= 0:
            break
    if least is None:
        return counted.where(F.lit(False))
    return counted.where((step > least) | ((step == least) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < part)))


def some_rows(df: DataFrame, key: str, about: int, total: int) -> DataFrame:
    """About ``about`` of ``total`` rows: those whose key's hash falls in one class of many."""
    classes = max(1, total // max(1, about))
    return df.where(F.pmod(F.xxhash64(key), F.lit(classes)) == 0)


ARROW_TYPES = {
    "string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(),
    "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
}

_PIECE = 1 << 19


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads all input bits over all output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _codes(index: np.ndarray) -> np.ndarray:
    """A 64-bit code without structure for every (place in a word, byte), given as ``256 place + byte``."""
    return mix64(mix64(index.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x632BE59BD9B4E019))


_DEEP = 64
_TABLE = _codes(np.arange(_DEEP * 256))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Stretches of about ``_PIECE`` bytes that end between words; a longer word stays whole."""
    at, end = 0, len(raw)
    while end - at > _PIECE:
        cut = max(raw.rfind(bytes([c]), at, at + _PIECE) for c in b" \t\n\x0b\f\r")
        if cut <= at:
            later = [x for c in b" \t\n\x0b\f\r" if (x := raw.find(bytes([c]), at + _PIECE)) >= 0]
            cut = min(later, default=end)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(text: str, tails: bool = False):
    """64-bit hashes of the words of ``text`` with A-Z lower-cased, in order.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A word's hash sums one pseudo-random code per byte and place
    (Zobrist hashing), so no arithmetic pattern of letters makes two words meet. With ``tails`` the low six
    bits are a word class taken from the last two bytes, so a word's class can be read off its hash. Equal
    words have equal hashes; two different ones meet with probability 2**-64 (2**-58 with ``tails``).
    """
    out = []
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        a = np.frombuffer(piece, np.uint8)
        if not len(a):
            continue
        word = np.empty(len(a) + 2, bool)
        word[0] = word[-1] = False
        np.logical_and(a != 32, (a - np.uint8(9)) > 4, out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        lengths = ends - starts
        heads = np.cumsum(lengths) - lengths
        index = (np.arange(heads[-1] + lengths[-1]) - np.repeat(heads, lengths)) << 8
        index |= a[word[1:-1]]
        codes = _TABLE.take(index, mode="clip")
        if lengths.max() > _DEEP:
            deep = np.flatnonzero(index >= _DEEP << 8)
            codes[deep] = _codes(index[deep])
        h = mix64(np.add.reduceat(codes, heads) + lengths.astype(np.uint64))
        if tails:
            last = a[ends - 1].astype(np.uint64)
            before = np.where(lengths > 1, a[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
            h = (h & np.uint64(0xFFFFFFFFFFFFFFC0)) | ((last * np.uint64(37) + before * np.uint64(11)) & np.uint64(63))
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; fewer words: one shingle; none: empty."""
    if not len(words):
        return words
    mult, half = np.uint64(0xA24BAED4963EE407), np.uint64(32)
    if len(words) < size:
        h, taken = np.full(1, len(words), np.uint64), words[:, None]
    else:
        h = np.zeros(len(words) - size + 1, np.uint64)
        taken = [words[k : len(words) - size + 1 + k] for k in range(size)]
    for w in taken:
        h = ((h ^ (h >> half)) + w) * mult
    return np.unique(mix64(h))
