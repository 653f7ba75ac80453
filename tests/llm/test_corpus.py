"""Fingerprints, mixing, LM, WARC, quality, decontamination and the Jaccard join on small corpora."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.functions import col, expr, lit

from quillgraph.llm import common, fingerprint, lm_score, mixing, ngram_join, pii, quality, warc
from quillgraph.llm import decontaminate
from quillgraph.llm.decontaminate import drop_contaminated, find_overlaps

WORDS = [a + b for a in "bcdfghklmn" for b in ("a", "e", "io", "ur")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# word hashes


def test_words_are_split_at_six_characters_only():
    assert len(common.word_hashes(" a\tb\n\x0bc\x0c\rd\u00a0e \x1cf ")) == 5
    assert (common.word_hashes("ÉA Éa") == common.word_hashes("éa")[0]).tolist() == [False, False]
    long = "x" * (1 << 20) + " " + " ".join(f"w{i}" for i in range(200_000)) + " " + "y" * (1 << 20)
    h = common.word_hashes(long)
    assert len(h) == 200_002 and len({*h.tolist()}) == 200_002 and h[5] == common.word_hashes("W4")[0]
    tails = common.word_hashes("one zone a", tails=True)
    assert (tails[0] & 63) == (tails[1] & 63) and len(common.word_hashes("")) == 0


# op 2


def plain_gram(gram):
    """The polynomial of one gram by Horner's rule, with whole numbers."""
    h, whole = 0, (1 << 64) - 1
    for c in gram:
        h = (h * 0x5851F42D4C957F2D + ord(c) + 1) & whole
    for shift, factor in ((31, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F), (32, 1)):
        h = (h ^ h >> shift) * factor & whole
    return h >> 32


def plain_winnow(text, k=fingerprint.K, w=fingerprint.W):
    values = [plain_gram(text[i : i + k]) for i in range(max(1, len(text) - k + 1))] if text else []
    chosen = set()
    w = min(w, len(values))
    for i in range(len(values) - w + 1 if values else 0):
        part = values[i : i + w]
        chosen.add(i + max(j for j, v in enumerate(part) if v == min(part)))
    return sorted((p, values[p]) for p in chosen)


@pytest.mark.parametrize("text", ["", "a", "short", "a" * 300, "abcabc" * 60, "é𝄞x " * 40, " ".join(map(str, range(120)))])
def test_winnowing_by_definition(text):
    got = [(int(x & np.uint64(0xFFFFFFFF)), int(x >> np.uint64(32))) for x in fingerprint.winnow(text)]
    assert got == plain_winnow(text)


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh ", k=fingerprint.K + fingerprint.W - 1))
    a, b = (fingerprint.hashes(fingerprint.winnow(prose(rng, 60) + passage + prose(rng, 60))) for _ in range(2))
    assert len(np.intersect1d(a, b))


def test_fingerprint_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "x", "word " * 3000] + [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    rows = [(i * 7 - 50, t, "clash") for i, t in enumerate(texts)] + [(None, "of no id", "c"), (-50, "same id", "c")]
    rng.shuffle(rows)
    got = fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"), ranges=6).collect()
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = fingerprint.edited(t, after)
        want[i, t] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.show(fingerprint.winnow(t)), fingerprint.show(fingerprint.winnow(changed)))
    assert sorted(((r[0], *r[1:5]) for r in got), key=repr) == sorted(((i, *v) for (i, _), v in want.items()), key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


# op 4


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


def test_mixing(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one\u00a0word"] + [prose(rng, rng.randint(1, 400)) for _ in range(300)] + [prose(rng, 20_000)]
    df = docs(spark, texts, source=lambda i: None if i % 11 == 0 else "big" if i % 3 else f"s{i % 9}é")
    got = mixing.mix_sources(df, shard_words=2_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(3), shard_words=2_000).collect()))
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    targets, taken = plain_targets(sizes), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and math.isclose(r["target"], targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= max(128, 0.03 * t) for s, t in targets.items()), (taken, targets)
    assert mixing.mix_sources(docs(spark, [])).count() == 0 and mixing.mix_sources(docs(spark, [None, ""])).select("taken").distinct().collect() == [(0,)]


def test_mixing_runs_no_python(spark):
    plan = mixing.mix_sources(docs(spark, ["a b c", "d"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixed_texts_hold_what_is_taken(spark):
    rng = random.Random(33)
    texts = [None, "", "a  b\tc"] + [prose(rng, rng.randint(1, 300)) for _ in range(120)]
    rows = [(i if i % 5 else None, t, "en", f"s{i % 4}", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[10:14] * 3, SCHEMA).withColumnRenamed("n_chars", "begin")
    got = mixing.mix_sources(df, shard_words=700, texts=True)
    assert got.columns == [*df.columns, "size", "source_size", "target", "taken"] and got.count() == df.count()
    plain = sorted(map(tuple, mixing.mix_sources(df, shard_words=700).select("doc_id", "size").collect()), key=repr)
    assert plain == sorted(map(tuple, got.select("doc_id", "size").collect()), key=repr)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    known = {(r[0], len(words(r[1]))): Counter(words(r[1])) for r in rows}
    for r in got.collect():
        assert len(words(r["text"])) == r["taken"] and all(n <= 2 * known[r["doc_id"], r["size"]][w] for w, n in Counter(words(r["text"])).items() if r["doc_id"] is not None)


def test_mixing_with_very_many_sources_and_hot_rows(spark):
    n = 100_000
    few = spark.range(n).select(col("id").alias("doc_id"), expr("repeat('w ', cast(1 + id % 5 as int))").alias("text"), expr("concat('s', id)").alias("source"))
    hot = spark.range(30_000).select(lit(None).cast("long").alias("doc_id"), lit("one two three").alias("text"), lit("s7").alias("source"))
    got = mixing.mix_sources(few.union(hot), block_words=2).agg(*[expr(f"sum({c})").alias(c) for c in ("size", "taken")], expr("count(*)").alias("n"), expr("max(taken - 2 * size)").alias("over")).first()
    assert got["n"] == n + 30_000 and got["over"] <= 0 and abs(got["taken"] - 1.5 * got["size"]) < 0.02 * got["size"]


def test_apportionment_of_any_number_of_rows(spark):
    rng = random.Random(44)
    weights = [float(rng.choice([0, 1, 1, 5, 5, 70, 1000])) for _ in range(400)]
    rows = spark.createDataFrame([(f"r{i:03}", w) for i, w in enumerate(weights)], "r string, w double")
    for seats in (0, 1, 37, 5000):
        got = {r["r"]: r["quota"] for r in mixing.sainte_lague_all(rows, "r", "w", seats, sum(weights)).collect()}
        won = Counter()
        for _ in range(seats):
            best = max(range(400), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        assert got == {f"r{i:03}": won[i] for i in range(400)}


def test_sainte_lague_by_sequence(spark):
    rng = random.Random(4)
    rows = [(g, f"r{i}", float(rng.randint(0, 1000)) if i else 90_000.0 * g) for g in range(3) for i in range(12)]
    seats = {0: 7, 1: 100, 2: 1}
    got = {(r["g"], r["r"]): r["quota"] for r in mixing.sainte_lague(spark.createDataFrame([(g, r, w, seats[g]) for g, r, w in rows], "g int, r string, w double, seats long"), ["g"], ["r"], "w", "seats").collect()}
    for g, n in seats.items():
        won = Counter()
        for _ in range(n):
            best = max(((w / (2 * won[r] + 1), r) for h, r, w in rows if h == g), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            won[best[1]] += 1
        assert {r: got[g, r] for h, r, _ in rows if h == g} == {r: won[r] for h, r, _ in rows if h == g}


# op 5


def test_lm_scores(spark):
    rng = random.Random(5)
    languages = [WORDS[:20], WORDS[20:]]
    texts = [None, "", "neverseen " * 3, "Ba ba BA"] + [prose(rng, rng.randint(5, 120), languages[i % 2]) for i in range(260)]
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs(spark, texts), symbols=90, known=12).collect()}
    tokens = {i: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] + [None] for i, t in enumerate(texts)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t in tokens.items() if i not in held for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["score"] < 0
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)  # context tells the languages apart
    assert lm_score.score_texts(docs(spark, [])).count() == 0


def test_lm_scores_do_not_depend_on_layout(spark):
    rng = random.Random(55)
    texts = [None, ""] + [prose(rng, rng.randint(5, 80), WORDS[k % 2 * 20 : k % 2 * 20 + 20]) for k in range(300)]
    df = docs(spark, texts + texts[:40])
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n, parts in ((1, 4), (4, 2), (32, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        scored = lm_score.score_texts(df.repartition(n), symbols=90, known=30, shard_tokens=1000).collect()
        got.append(sorted((tuple(r) for r in scored), key=lambda r: r[0]))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    for other in got[1:]:
        assert [r[:5] for r in other] == [r[:5] for r in got[0]]
        assert all(math.isclose(x, y, rel_tol=1e-9) for a, b in zip(other, got[0]) for x, y in zip(a[5:], b[5:]))


def test_words_that_share_arithmetic_are_told_apart(spark):
    """Thue-Morse words and their complements, which meet under any polynomial modulo 2**64."""
    one, other = ("".join("ab"[(bin(i).count("1") + x) % 2] for i in range(2048)) for x in (0, 1))
    assert len({common.word_hashes(w)[0] for w in (one, other)}) == 2 and len({common.word_hashes(w, tails=True)[0] for w in (one, other)}) == 2
    pair = docs(spark, [one, other])
    assert [tuple(r) for r in ngram_join.jaccard_components(pair).orderBy("doc_id").collect()] == [(0, 1, 0), (1, 1, 1)]
    ids = [i for i in range(10) if zlib.crc32(str(i).encode()) % 10][:1] + [i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 10 == 0][:1]
    rows = spark.createDataFrame([(ids[0], one), (ids[1], other)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in lm_score.score_texts(rows, symbols=90).collect()} == {ids[0]: 2, ids[1]: 1}


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    v = np.full(40, 1 / 40)
    model = lm_score.LogBilinear(v, 8)
    for _ in range(20):
        a = rng.integers(0, 40, 200)
        model.train(a, rng.integers(0, 40, 200), (a + 1) % 40, rng)
    one, two, log_z = model.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - log_z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    assert p[np.arange(40), 0, (np.arange(40) + 1) % 40].mean() > 1 / 40


def test_extra_columns_never_clash(spark):
    rng = random.Random(12)
    plain = docs(spark, [None, ""] + [prose(rng, 30) for _ in range(30)])
    names = ["id", "t", "h", "j", "size", "sk", "shard", "part", "target", "taken", "begin", "n", "held_out", "named", "row", "weight", "seats", "spans", "words", "at", "seed"]
    wide = plain.withColumns({c: lit(f"extra {c}") for c in names})
    for op in (mixing.mix_sources, lambda df: lm_score.score_texts(df, symbols=90), pii.find_pii):
        assert sorted(map(tuple, op(wide).collect()), key=repr) == sorted(map(tuple, op(plain).collect()), key=repr)
    mixed = mixing.mix_sources(wide, texts=True)
    assert len({*mixed.columns}) == len(mixed.columns) and {r["size"] for r in mixed.collect()} == {0, 30}
    assert pii.redact_pii(wide).columns == wide.columns


# op 6

SEPARATOR = "\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "u", "x" * 5000), (2, None, SEPARATOR * 50), (3, "a b\r\nc", "WARC/1.1\r\n" * 300), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1"), (7, "u", "é" * 7001), (8, "u", "x" * 5000),
    (None, "u", "q" * 2000), (1, "u", "x" * 5000), (9, "u", ("\r\n" * 3 + "WARC/1.1\r\n") * 200), (10, "u", "\r\n\r\nWARC/1.1\r"), (11, "u", "small"), (12, "u", "small"),
]


@pytest.mark.parametrize("chunk", [97, 1000, 65536])
def test_archives_round_trip(spark, chunk):
    got = warc.archive_pages(spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload_digest string"), chunk_bytes=chunk).collect()
    keep = {}
    for i, _, h in PAGES:
        keep[h] = max(keep.get(h, -1), i if i is not None else -1)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        old = len(raw) >= 1000 and i is not None and keep[h] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", keep[h] if old else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_archives_are_gzip_with_unique_records(spark, tmp_path):
    warc.write_archives(warc.chunk_table(spark.createDataFrame(PAGES, "page_id long, url string, html string"), chunk_bytes=1000), f"{tmp_path}/a")
    ids, refers, members = [], [], 0
    for f in (tmp_path / "a").glob("part-*"):
        raw = f.read_bytes()
        text = gzip.decompress(raw)  # a plain reader sees one valid gzip file
        members += raw.count(warc._EMPTY_MEMBER)
        ids += re.findall(rb"WARC-Record-ID: (\S+)", text)
        refers += re.findall(rb"WARC-Refers-To: (\S+)", text)
    assert len({*ids}) == len(ids) == members > len(PAGES) and {*refers} <= {*ids} and refers


def test_a_record_never_holds_the_separator():
    for record in (b"x", warc._EMPTY_MEMBER * 500, os.urandom(900) + warc._EMPTY_MEMBER + os.urandom(900)):
        made = warc._member(record)
        assert warc._EMPTY_MEMBER not in made and zlib.decompress(made, 31) == record


def test_python_sees_only_chunks(spark):
    """A payload of 48 MB arrives in slices, with digests that grow."""
    page = spark.range(1).select(col("id").alias("page_id"), lit("u").alias("url"), expr("repeat('0123456789abcdef', 3 << 20)").alias("html"))
    sizes = warc.chunk_table(page).selectExpr("max(octet_length(data)) as most", "count(*) as n", "count(distinct sha1) as digests", "sum(octet_length(data)) as total").first()
    assert tuple(sizes) == (warc.CHUNK, 768, 768, 48 << 20)
    got = warc.archive_pages(page).first()
    assert (got["payload_bytes"], got["payload_digest"]) == (48 << 20, hashlib.sha1(b"0123456789abcdef" * (3 << 20)).hexdigest())


@pytest.mark.parametrize("chunk", [1000, 65536])
def test_damage_is_found(spark, tmp_path, chunk):
    warc.write_archives(warc.chunk_table(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"), chunk_bytes=chunk), f"{tmp_path}/a")
    assert warc.verify_records(warc.read_archives(spark, f"{tmp_path}/a")).count() == 1
    for f in (tmp_path / "a").glob("*.txt"):
        members = [m for m in f.read_bytes().split(warc._EMPTY_MEMBER) if m]
        members = [warc._member(zlib.decompress(m, 31).replace(b"xxx", b"xyx", 1)) for m in members]
        f.write_bytes(warc._EMPTY_MEMBER.join(members))
        (tmp_path / "a" / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="digest"):
        warc.verify_records(warc.read_archives(spark, f"{tmp_path}/a")).collect()
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# op 7


def junk(rng, k):
    words = [prose(rng, 1) for _ in range(60)]
    return [" ".join(w + "###" for w in words), " | ".join(words), " ".join(w.upper() + "!!" for w in words[:10] * 6)][k % 3]


def test_upper_case_share_does_not_depend_on_length():
    text = "The Quick brown fox sees iPhones, Écoles and NASA. "
    want = sum(c.isupper() for c in text) / len("".join(text.split()))
    for times in (1, 50, 80, 81, 82, 83, 400, 4000):
        assert quality.features(text * times)[5] == pytest.approx(want), times


def test_quality(spark):
    rng = random.Random(6)
    texts = [None, "", "x"] + [junk(rng, i) if i % 5 == 0 else prose(rng, rng.randint(30, 200)).capitalize() + "." for i in range(400)]
    truth = {i: int((i - 3) % 5 != 0) for i in range(3, len(texts))}
    known = [(i, q, 0) for i, q in truth.items() if i % 2] + [(None, 1, 0), (9, None, 0)]
    df, labels = docs(spark, texts), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(df, labels).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert sum(got[i]["keep"] == bool(truth[i]) for i in held) >= 0.97 * len(held)  # held-out accuracy
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("probability", "host_prior", "path_prior"))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}
    assert quality.score_quality(docs(spark, []), labels).count() == 0
    neutral = quality.score_quality(docs(spark, ["a b c", None]), labels.where("false"), threshold=0.4).collect()
    assert all(r["logit"] == 0 for r in neutral)


def plain_priors(rows):
    """Priors of (host, path, evidence) rows by the formulas, each without the row itself."""
    def strength(sites):
        spread = sum(n * (k / n - m) ** 2 for k, n, m in sites)
        noise = sum(m * (1 - m) for _, _, m in sites)
        share = (spread - noise) / sum(n * m * (1 - m) for _, n, m in sites)
        return min(1e4, max(1.0, 1 / share - 1)) if share > 0 else 1e4

    k, n, hk, hn, pk, pn = 0.0, 0, Counter(), Counter(), Counter(), Counter()
    for h, p, e in rows:
        k, n = k + e, n + 1
        hk[h] += e
        hn[h] += 1
        pk[h, p] += e
        pn[h, p] += 1
    overall = (k + 0.5) / (n + 1)
    sh = strength([(hk[h], hn[h], overall) for h in hn])
    sp = strength([(pk[x], pn[x], (hk[x[0]] + sh * overall) / (hn[x[0]] + sh)) for x in pn])
    out = []
    for h, p, e in rows:
        host = (hk[h] - e + sh * (k + 0.5 - e) / n) / (hn[h] - 1 + sh)
        out.append((host, (pk[h, p] - e + sp * host) / (pn[h, p] - 1 + sp)))
    return out


def test_priors_by_brute_force(spark):
    rng = random.Random(61)
    texts = [None, ""] + [junk(rng, i) if i % 7 == 0 else prose(rng, rng.randint(30, 120)).capitalize() for i in range(300)]
    rows = [(i, t, None if i % 13 == 0 else f"l{i % 4}", None if i % 17 == 0 else f"s{min(i % 11, 5)}", "c", "c") for i, t in enumerate(texts)]
    rows += rows[5:9] + [(None, "no id", "l1", "s1", "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, logit string, k string")
    labels = spark.createDataFrame([(i, int(i % 7 != 2), 0) for i in range(0, 300, 3)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels).collect()
    label = {i: float(i % 7 != 2) for i in range(3, 300, 3)} | {0: 1.0}
    evidence = [(r["host"], r["path"], label.get(r["doc_id"], 1 / (1 + math.exp(-r["logit"])))) for r in got]
    for r, (host, path) in zip(got, plain_priors(evidence)):
        assert math.isclose(r["host_prior"], host, rel_tol=1e-9) and math.isclose(r["path_prior"], path, rel_tol=1e-9)
    assert sorted((r["doc_id"], r["host"], r["path"]) for r in got if r["doc_id"] and r["host"] and r["path"]) == sorted((i, s, g) for i, _, g, s, _, _ in rows if i and s and g)
    kept = quality.keep_good(df.withColumn("n", lit(1)).withColumn("__id", lit(1)), labels)
    assert kept.columns == [*df.columns, "n", "__id"] and kept.count() == sum(r["keep"] for r in got)


def test_sparse_sites_shrink(spark):
    rows = [(i, "h1", "p1", 9.0) for i in range(200)] + [(i, "h2", "p1", -9.0) for i in range(200, 400)] + [(400, "h1", "rare", -9.0), (401, "new", "p", 9.0)]
    scored = spark.createDataFrame([(*r, 1 / (1 + math.exp(-r[3]))) for r in rows], "id long, __qg_host string, __qg_path string, __qg_logit double, __qg_e double")
    got = {r["id"]: r for r in quality.judge(scored, 0.5).collect()}
    assert got[0]["__qg_path_prior"] > 0.95 and got[300]["__qg_path_prior"] < 0.05
    assert got[400]["__qg_path_prior"] > 0.5  # one bad page in a good host, seen without itself
    assert math.isclose(got[401]["__qg_path_prior"], (200.5) / 402, rel_tol=0.02)


# op 9


def plain_tokens(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def plain_overlaps(texts, bench):
    """{(document, item): (most equal tokens, window, first place)} by laying every window everywhere."""
    out = {}
    for d, t in enumerate(texts):
        have = plain_tokens(t)
        for i, b in enumerate(bench):
            item = plain_tokens(b)
            w, known = min(13, len(item)), {*item}
            if 100 * sum(x in known for x in have) < 80 * w:
                continue
            for a in range(len(item) - w + 1 if w else 0):
                for s in range(1 - w, len(have)):
                    equal = sum(0 <= s + j < len(have) and have[s + j] == item[a + j] for j in range(w))
                    if 100 * equal >= 80 * w and (equal, -s) > out.get((d, i), (0,))[:1] + tuple(-x for x in out.get((d, i), (0, 0, 0))[2:]):
                        out[d, i] = (equal, w, s)
    return out


def test_masks_are_complete():
    for n, masks in decontaminate.MASKS.items():
        assert decontaminate.complete(masks, n, decontaminate.admitted(n)) and all(len(m) <= n and m[0] == m[-1] == "1" for m in masks)
    assert not decontaminate.complete(("1101100101", "1011010011", "1110010110"), 13, 2)
    assert [decontaminate.admitted(n) for n in range(1, 14)] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2]


def test_decontamination(spark):
    rng = random.Random(7)
    bench = [prose(rng, 40) for _ in range(12)] + ["tiny but exact item", None, "", "..."]
    swapped = bench[2].split()
    for k in (3, 9, 15, 22, 30):
        swapped[k] = "zzz"
    texts = [
        None, "", bench[0], prose(rng, 50) + " " + bench[1].upper() + ". " + prose(rng, 300), " ".join(swapped), " ".join(bench[3].split()[10:24]), prose(rng, 500),
        " ".join(bench[4].split()[:7]) + " " + prose(rng, 80), "so Tiny, but exact item!", prose(rng, 2_000) + " " + bench[5], bench[6] + " " + bench[7],
    ]
    texts = texts + texts[2:3]
    df = docs(spark, texts).withColumn("equal", lit("c")).withColumn("words", lit("c"))
    items = spark.createDataFrame([(i, b, "c") for i, b in enumerate(bench)] + [(0, bench[0], "c")], "item_id long, text string, at string")
    got = {(r[0], r[1]): tuple(r)[2:] for r in find_overlaps(df, items).collect()}
    assert got == plain_overlaps(texts, bench) and {(2, 0), (3, 1), (4, 2), (5, 3), (8, 12), (9, 5), (10, 6), (10, 7), (11, 0)} <= {*got}
    assert {(r[0], r[1]): tuple(r)[2:] for r in find_overlaps(df, items, max_broadcast=0).collect()} == got
    clean = drop_contaminated(df, items)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {*range(len(texts))} - {d for d, _ in got}
    assert find_overlaps(docs(spark, []), items).count() == 0 and find_overlaps(df, items.where("false")).count() == 0
    assert not re.search("Python|Pandas|Arrow", find_overlaps(df, items)._jdf.queryExecution().executedPlan().toString().replace("PythonUDF", ""))
    ids = spark.createDataFrame([(None, bench[0]), (None, "clean"), (1, "clean")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in find_overlaps(ids, items).collect()] == [(None, 0)] and drop_contaminated(ids, items).collect() == [(1, "clean")]


def test_every_admitted_substitution_is_found(spark):
    """All pairs of substituted places in a window of 13, and single ones in shorter items, at both ends of a text."""
    rng = random.Random(70)
    words = [f"w{i}" for i in range(500)]
    bench = [" ".join(rng.sample(words, n)) for n in (30, 13, 12, 11, 10, 9, 8, 7, 6, 5)]
    texts, want = [], set()
    for i, b in enumerate(bench):
        item = b.split()
        w = min(13, len(item))
        for x in range(w):
            for y in range(x, w):
                at = rng.randint(0, len(item) - w)
                part = item[at : at + w]
                for k in {x, y}:
                    part[k] = "zzz"
                for there in (part, ["q"] * 3 + part, part + ["q"] * 3):
                    if 100 * sum(p != "zzz" for p in part) >= 80 * w:
                        want.add((len(texts), i))
                    texts.append(" ".join(there))
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {(r[0], r[1]) for r in find_overlaps(docs(spark, texts), items).collect()}
    assert got == {*plain_overlaps(texts, bench)} and want <= got and len(texts) > 1000


def test_long_and_repetitive_items_stay_small(spark):
    rng = random.Random(71)
    long = " ".join(f"w{rng.randint(0, 9_999)}" for _ in range(20_000))
    items = spark.createDataFrame([(0, long), (1, "a " * 4_000)], "item_id long, text string")
    made = items.select(col("item_id").alias("item"), decontaminate.tokens(col("text")).alias("words"))
    seeds = decontaminate._item_seeds(made, 13, 13, decontaminate.MASKS[13])
    assert sum(len(" ".join(r["there"])) + 100 for r in seeds.collect()) < 100 << 20 and seeds.where("item = 1").count() < 40
    texts = ["a " * 50_000, " ".join(long.split()[5_000:5_013]), "b " * 100]
    assert {(r[0], r[1]) for r in find_overlaps(docs(spark, texts), items).collect()} == {(0, 1), (1, 0)}


# op 10


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("hot", [2, 16])
def test_jaccard_components(spark, hot):
    rng = random.Random(8)
    texts = [None, "", "  ", "one two", "One TWO", "a b c d e", "a b c d e f"]
    base = [prose(rng, n) for n in (40, 90, 200, 6000)]
    passage = prose(rng, 60)
    for t in base:
        words = t.split()
        for edits in (0, 0, 1, 2, 3, 5, len(words) // 30, len(words) // 20, len(words) // 12):
            changed = list(words)
            for k in rng.sample(range(len(words)), edits):
                changed[k] = rng.choice(WORDS)
            texts.append(" ".join(changed))
    for k in range(40):  # one family of drifting copies, and one passage in unlike documents
        words = base[1].split()
        for j in rng.sample(range(len(words)), k % 5):
            words[j] = f"edit{rng.randint(0, 3)}"
        texts += [" ".join(words), passage + " " + prose(rng, 40 + k)]
    got = ngram_join.jaccard_components(docs(spark, texts), hot=hot, salts=3, list_rows=3 if hot == 2 else 256)
    assert sorted(map(tuple, got.collect())) == plain_components(texts)


def test_jaccard_edges(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_components(docs(spark, ["", None])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]
    rows = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (None, "a b c d e f", "x"), (9, "A B C D E F", "x")], "doc_id long, text string, cls string")
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(rows).collect()), key=repr)
    assert got == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None)]


def test_shuffle_files_go_with_their_step(spark):
    """A run must not hold the shuffle files of all its steps until the driver collects its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(x.startswith("shuffle_") for x in disk.getAllBlocks().mkString(" ").split())
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng, before, setting = random.Random(9), held(), spark.conf.get(key)
    base = [prose(rng, 60) for _ in range(20)]
    texts = docs(spark, [b + f" end{k}" for b in base for k in range(3)])
    got = ngram_join.jaccard_components(texts)
    assert held() - before < 20 and spark.conf.get(key) == setting
    assert {tuple(r) for r in got.select("doc_id", "component_id").collect()} == {(i, i - i % 3) for i in range(60)}


@pytest.mark.parametrize("many", [1, 1_000_000])
def test_components_of_chains_and_stars(spark, many):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 300), (300, 200)]
    got = dict(map(tuple, ngram_join.connected_components(spark.createDataFrame(edges, "a long, b long"), many).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == got[200] == 200
