"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Tokens: words (A-Z lower-cased) and one end per text. The model's symbols are the end, ``classes``
classes of rarer words (by a word's last two bytes) and the most frequent words, ``symbols`` in all.
The two symbols before a token are projected by position vectors, summed and matched with the token's
vector and bias; noise-contrastive estimation against the unigram fits them without normalising.

Training is synchronous and does not depend on how the table is laid out: every text belongs to a shard of
about ``shard_tokens`` tokens by the hash of its id and text, and every shard to one of ``rounds`` rounds.
In a round each shard trains, in the order of those hashes, from the round's common start; the new start
is the mean of the results by tokens, summed as whole numbers, so that the order of summing changes nothing.
The training data never meet in one place, and what is gathered grows with them.

Scoring is normalised: log Z of every pair of context symbols comes from one product of exponentiated
score matrices, and batches of tokens look their scores up. Within a class a word has its share of the
class's training tokens, (c + 0.1) / (N_class + 0.1 (V_class + 1)), so the text's probability is one over
all words, seen or not. ``symbols`` is the one bound on what the neural part learns, at every input size.

Counts cover all training texts. The most frequent words' counts, about ``known``, are broadcast (16
bytes each); every other word of a text is joined with the count table by shuffling, once per text.

Defined results: a null text is empty, an empty text is one end; a null id is held out (its text form
is empty); without training texts N is 0 and the model is its start; repeated rows are scored apart;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, documents, materialize, most_frequent, some_rows, word_hashes

_TAIL = np.uint64(63)
CLASSES = 64


class Vocabulary:
    """Counts of the most frequent words, the model's symbols and the classes' totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, texts: int, tokens: int, distinct: int, symbols: int):
        self.tokens, self.distinct = tokens, distinct
        self.denominator = tokens + 0.1 * (distinct + 1)
        by_value = np.argsort(words)
        self.words, self.counts = words[by_value], counts[by_value]
        own = min(len(words), symbols - CLASSES - 1)
        symbol = np.zeros(len(words), np.int32)
        symbol[:own] = np.arange(CLASSES + 1, CLASSES + 1 + own)
        self.symbol = symbol[by_value]
        self.size = CLASSES + 1 + own
        at = (words[:own] & _TAIL).astype(np.int64)
        self.class_tokens = class_tokens - np.bincount(at, counts[:own], CLASSES)
        self.class_words = class_words - np.bincount(at, minlength=CLASSES)
        self.log_count = np.log10(self.counts + 0.1)
        self.log_class = np.log10(self.class_tokens + 0.1 * (self.class_words + 1))
        self.end = texts
        mass = np.concatenate([[texts], self.class_tokens, counts[:own]]) + 1.0
        self.unigram = mass / mass.sum()

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For word hashes: the model's symbols, places among the known words, and whether they are known."""
        rest = 1 + (h & _TAIL).astype(np.int32)
        if not len(self.words):
            return rest, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        own = self.symbol[at]
        return np.where(known & (own > 0), own, rest), at, known


def learn_vocabulary(training: DataFrame, symbols: int, known: int) -> tuple[Vocabulary, DataFrame, str]:
    """The vocabulary of ``training`` (column ``t``), and the table (w, c) of all its words' counts."""
    block = 1 << 20

    def run(batches):
        held, size = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["w", "c"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(word_hashes(t, tails=True))
                size += len(held[-1])
                if size >= block:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts, path = materialize(training.select("t").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "counts")
    per_class = counts.groupBy(F.col("w").bitwiseAND(F.lit(63)).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        tokens[r["k"]], distinct[r["k"]] = r["c"], r["n"]
    top = most_frequent(counts, "w", "c", known).toArrow()
    texts = training.count()
    words, values = top["w"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.lexsort((words, -values))
    return Vocabulary(words[order], values[order], tokens, distinct, texts, int(tokens.sum()) + texts, int(distinct.sum()) + (texts > 0), symbols), counts, path


class LogBilinear:
    """Context vectors, token vectors, biases and position vectors, with the squared gradients of each row."""

    def __init__(self, unigram: np.ndarray, width: int = 16, seed: int = 5):
        self.n, self.width, self.unigram = len(unigram), width, unigram
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.3, (self.n, width)).astype(np.float32)
        self.token = rng.normal(0, 0.3, (self.n, width)).astype(np.float32)
        self.bias = np.log(unigram).astype(np.float32)
        self.place = np.full((2, width), 0.5, np.float32)
        self._parts = ("context", "token", "bias", "place")
        self._squares = {k: np.full(len(getattr(self, k)), 1e-6, np.float32) for k in self._parts}
        self._upto = np.cumsum(unigram)
        self._floor = np.log(unigram)

    def vector(self) -> np.ndarray:
        """All parameters and squares in one row of float64."""
        return np.concatenate([getattr(self, k).ravel() for k in self._parts] + [self._squares[k] for k in self._parts]).astype(np.float64)

    def load(self, vector: np.ndarray) -> "LogBilinear":
        at = 0
        for store, names in ((self.__dict__, self._parts), (self._squares, self._parts)):
            for k in names:
                store[k] = vector[at : at + store[k].size].reshape(store[k].shape).astype(np.float32)
                at += store[k].size
        return self

    def _climb(self, name: str, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """An Adagrad step on some rows of a parameter; gradients of one row are summed first."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total = np.add.reduceat(grads[order], heads, axis=0)
        rows, squares = rows[heads], self._squares[name]
        squares[rows] += (total * total).mean(axis=1) if total.ndim > 1 else total * total
        scale = rate / np.sqrt(squares[rows])
        getattr(self, name)[rows] += total * (scale[:, None] if total.ndim > 1 else scale)

    def train(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rng: np.random.Generator, noise: int = 50, rate: float = 0.04) -> None:
        """One noise-contrastive step: contexts ``a`` (just before) and ``b`` (before that), tokens ``w``."""
        drawn = np.minimum(np.searchsorted(self._upto, rng.random(noise)), self.n - 1)
        floor = (np.log(noise) + self._floor).astype(np.float32)
        va, vb, vw, vn = self.context[a], self.context[b], self.token[w], self.token[drawn]
        r = va * self.place[0] + vb * self.place[1]
        true = np.einsum("ij,ij->i", r, vw) + self.bias[w] - floor[w]
        false = r @ vn.T + (self.bias[drawn] - floor[drawn])
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dr = up[:, None] * vw + down @ vn
        tokens = np.concatenate([w, drawn])
        grads = np.concatenate([up[:, None] * r, down.T @ r])
        lift = np.concatenate([up, down.sum(0)])
        places = np.stack([(dr * va).sum(0), (dr * vb).sum(0)])
        self._climb("token", tokens, grads, rate)
        self._climb("bias", tokens, lift, rate)
        self._climb("context", np.concatenate([a, b]), np.concatenate([dr * self.place[0], dr * self.place[1]]), rate)
        self._climb("place", np.arange(2), places, rate)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (first context, token), bias included, by (second context, token), and log Z by both contexts."""
        one = (self.context * self.place[0]) @ self.token.T + self.bias
        two = (self.context * self.place[1]) @ self.token.T
        top_one, top_two = one.max(1), two.max(1)
        z = np.exp(one - top_one[:, None], dtype=np.float64) @ np.exp(two - top_two[:, None], dtype=np.float64).T
        return one, two, (np.log(z) + top_one[:, None] + top_two[None, :]).astype(np.float32)


def _symbols(vocabulary: Vocabulary, text: str) -> np.ndarray:
    """A text's symbols with two ends before and one after."""
    own = vocabulary.look_up(word_hashes(text, tails=True))[0]
    return np.concatenate([np.zeros(2, np.int32), own, np.zeros(1, np.int32)])


#: Parameters are summed as whole multiples of 2**-22, weighted by tokens in units of 1,024.
_FIXED, _UNIT = float(1 << 22), 1024


def _trained(texts: DataFrame, vocabulary: Vocabulary, width: int, batch: int, epochs: int = 1, start=None) -> DataFrame:
    """(weight, sums) of each partition of ``texts`` (``shard``, ``t``; shards whole and in order): the sum of
    the parameters of its shards, each trained on all its texts from ``start``, times their weights."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, start))

    def run(batches):
        v, begin = shared.value
        now = model = rng = total = None
        held, size, tokens, weight = [], 0, 0, 0

        def learn():
            s = np.concatenate(held)
            # a token is what has two symbols of its own text before it
            begins = np.cumsum([0] + [len(x) for x in held[:-1]])
            real = np.ones(len(s), bool)
            real[begins] = real[begins + 1] = False
            at = np.flatnonzero(real)
            for _ in range(epochs):
                at = rng.permutation(at)
                for k in range(0, len(at), batch):
                    i = at[k : k + batch]
                    model.train(s[i - 1], s[i - 2], s[i], rng)
            return len(at)

        def close():
            w = -(-tokens // _UNIT)
            whole = np.rint(np.clip(model.vector(), -64, 64) * _FIXED).astype(np.int64) * w
            return (whole if total is None else total + whole), weight + w

        for got in batches:
            for shard, t in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                if shard != now:
                    if now is not None:
                        tokens += learn() if held else 0
                        total, weight = close()
                    now, model, rng = shard, LogBilinear(v.unigram, width), np.random.default_rng([17, shard])
                    held, size, tokens = [], 0, 0
                    if begin is not None:
                        model.load(begin)
                held.append(_symbols(v, t))
                size += len(held[-1])
                if size >= 1 << 18:
                    tokens += learn()
                    held, size = [], 0
        if now is not None:
            tokens += learn() if held else 0
            total, weight = close()
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["weight", "sums"])

    return texts.select("shard", "t").mapInArrow(run, "weight long, sums binary")


def _mean(trained: DataFrame) -> np.ndarray | None:
    """The mean parameters; the sums are added up in a tree."""
    rows = trained.rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.int64)))
    weight, total = rows.treeAggregate((0, 0), lambda x, y: (x[0] + y[0], x[1] + y[1]), lambda x, y: (x[0] + y[0], x[1] + y[1]))
    return total / (weight * _FIXED) if weight else None


def train_model(training: DataFrame, vocabulary: Vocabulary, width: int = 16, batch: int = 2048, warm_up: int = 2000, shard_tokens: int = 1 << 18, rounds: int = 3) -> LogBilinear:
    """Train on all of ``training`` (``h``, ``t``): a warm-up on one class of about ``warm_up`` texts by ``h``, then each text once."""
    model = LogBilinear(vocabulary.unigram, width)
    few = some_rows(training, "h", warm_up, vocabulary.end).select(F.lit(0).alias("shard"), "h", "t")
    start = _mean(_trained(few.repartition(1).sortWithinPartitions("h", "t"), vocabulary, width, batch, epochs=2))
    if start is None:
        start = model.vector()
    count = max(1, -(-vocabulary.tokens // shard_tokens))
    rounds = min(rounds, count)
    parts = max(1, min(count // rounds, int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shard = F.pmod(F.xxhash64(F.lit(23), "h"), F.lit(count))
    for k in range(rounds):
        # each text is shuffled in one round
        mine = training.select(shard.alias("shard"), "h", "t").where(F.pmod("shard", F.lit(rounds)) == k)
        got = _mean(_trained(mine.repartition(parts, "shard").sortWithinPartitions("shard", "h", "t"), vocabulary, width, batch, start=start))
        start = start if got is None else got
    return model.load(start)


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", symbols: int = 2048, known: int = 200_000, width: int = 16, **training_options) -> DataFrame:
    """Per row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    arrow_rows(spark)
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    texts = df.select(F.col(f"`{key}`").alias("id"), (F.crc32(named) % 10 == 0).alias("held_out"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), named.alias("named"))
    training = texts.where("NOT held_out").select("t", F.xxhash64("named", "t").alias("h"))
    vocabulary, counts, counts_path = learn_vocabulary(training, symbols, known)
    model = train_model(training, vocabulary, width, **training_options)
    shared = spark.sparkContext.broadcast((vocabulary, *model.tables()))

    def run(batches):
        v, one, two, log_z = shared.value
        end_known, end_log, floor = int(v.end > 0), np.log10(v.end + 0.1), np.log10(v.denominator)
        for batch in batches:
            n, hits, base, score, rare, times = [], [], [], [], [], []
            for t in batch.column(3).to_pylist():
                h = word_hashes(t, tails=True)
                own, at, is_known = v.look_up(h)
                s = np.concatenate([np.zeros(2, np.int32), own, np.zeros(1, np.int32)])
                a, b, w = s[1:-1], s[:-2], s[2:]
                logs = float((one[a, w] + two[b, w] - log_z[a, b]).sum(dtype=np.float64)) / np.log(10)
                seen = v.log_count[at[is_known]]
                classed = (own > 0) & (own <= CLASSES)
                inside = v.log_count[at[is_known & classed]].sum() - v.log_class[own[classed] - 1].sum()
                values, counted = np.unique(h[~is_known], return_counts=True)
                n.append(len(h) + 1)
                hits.append(int(is_known.sum()) + end_known)
                base.append(float(seen.sum() + end_log - floor * (len(h) + 1)))
                score.append(float(logs + inside))
                rare.append(values.view(np.int64))
                times.append(counted.astype(np.int64))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, many), pa.array(times, many)],
                names=["row", "id", "held_out", "n", "hits", "base", "score", "rare", "times"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n long, hits long, base double, score double, rare array<long>, times array<long>"
    # a row's number is given once, in the job that writes it
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "t")
    scored, _ = materialize(numbered.mapInArrow(run, schema), "scored")
    rest = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
    more = (
        rest.join(counts, "w", "left").groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also"))
    )
    added, _ = materialize(more, "rare")
    discard(spark, counts_path)
    extra = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(added, "row", "left").select(
        F.col("id").alias(key), "held_out", F.col("n").alias("n_tokens"), (F.col("hits") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def op5_lm_score(spark, sf_dir) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
