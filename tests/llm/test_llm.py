"""The training-data operators against brute force, and on odd tables."""

from __future__ import annotations

import datetime as dt
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import byte_bpe, common, components, decontamination, jaccard_join, line_dedup, pii, quality_classifier, quality_rules, sharding, toxicity, url_filters
from tempora.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle
from tests.llm import brute

LONG = " ".join(f"w{k % 977}x{k}" for k in range(20000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, PASSAGE), (7, PASSAGE), (8, PASSAGE.upper()), (9, PASSAGE + " omega"), (10, LONG), (11, LONG + " tail"),
    (12, "a@b.c.d, 10.0.0.300 10.0.0.3 +1 (555) 555-0100 4111 1111 1111 1111 a@b.c%x@d.e 1.2.3.4.5.6.7.8"), (13, "é É Éa ÀB \x1c x　y 日本語 🎉"), (14, "the the the the the the the the the the the the"), (15, "x\nx\n\nx\n y\n"), (16, "@" * 500 + "1" * 3000 + "+" * 300), (17, "foo " + PASSAGE + " bar"),
]
#: Names that operators use inside.
EXTRA = ["label", "text_hash", "words", "host", "bad", "score", "n", "spans", "node", "key", "region", "cell", "part", "shard", "slot", "ratio", "name", "fold", "held_out", "copies", "fps", "place", "h", "counted", "url", "n_chars"]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 2)))
    return df.withColumns({c: F.lit(c) for c in EXTRA}) if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD, True)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "one two three"), (3, None), (4, ""), (5, PASSAGE), (None, PASSAGE), (6, " ".join(LONG.split()[500:540]))], "item_id long, text string")


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, sf_dir):
    oracle.check(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLE_SQL[name])


def test_sharding(odd):
    rows = sharding.assign(odd.unionByName(odd), 5, 8).collect()
    assert len(rows) == 2 * len(ODD)
    brute.bound_walk([(r["shard"], r["slot"]) for r in rows], 5)
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 1


def test_sharding_is_the_bounded_ring(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 5)
    df = documents(spark, [(k % 400, f"t{k % 450}") for k in range(900)] + [(None, f"n{k}") for k in range(300)])
    points = spark.range(7 * 8).select((F.col("id") % 7).cast("int").alias("shard"), (F.col("id") / 7).cast("int").alias("copy"))
    points = [(r["shard"], r["cell"]) for r in points.select("shard", F.pmod(F.xxhash64("shard", "copy"), F.lit(sharding.CELLS)).alias("cell")).collect()]
    keys = df.select("doc_id", F.crc32("text").alias("crc"), F.pmod(F.xxhash64("doc_id"), F.lit(sharding.CELLS)).alias("cell")).collect()
    got = sharding.assign(df, 7, 8).collect()
    loads = [sum(r["shard"] == s for r in got) for s in range(7)]
    assert brute.ring_loads(points, [r["cell"] for r in keys], 7) == (loads, brute.ring_homes(points, [r["cell"] for r in keys], 7))
    homes = {r["cell"]: brute.ring_home(points, r["cell"]) for r in keys}
    cell_of = {r["doc_id"]: r["cell"] for r in keys}
    room = [(1200 // 7) + (s < 1200 % 7) for s in range(7)]
    wanted = brute.ring_homes(points, [r["cell"] for r in keys], 7)
    for shard in range(7):  # as many of a shard's own keys as it has room for are at home
        assert sum(r["shard"] == shard == homes[cell_of[r["doc_id"]]] for r in got) == min(room[shard], wanted[shard])


def test_sharding_moves_few(spark):
    df = documents(spark, [(k, f"t{k}") for k in range(4000)])
    one = {r["doc_id"]: r["shard"] for r in sharding.assign(df, 16).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.assign(df, 17).collect()}
    assert sum(one[k] != two[k] for k in one) < 2000  # a rehash would move 15 of 16
    brute.bound_walk([(r["shard"], r["slot"]) for r in sharding.assign(df.withColumn("doc_id", F.lit(None).cast("long")), 16).collect()], 16)


def test_sharding_walk_fills_every_shard():
    out = sharding.walk([(0, 0, 10), (1, 1, 0), (2, 0, 2)], 3)
    assert sum(b - a for _, a, b, _, _ in out) == 12 and {s: sum(b - a for _, a, b, t, _ in out if t == s) for s in range(3)} == {0: 4, 1: 4, 2: 4}


def test_quality_rules(odd):
    texts = dict(ODD)
    for r in quality_rules.judge(odd).collect():
        want = brute.quality_counts(texts[r["doc_id"]] or "")
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_personal_data_base(odd):
    texts = dict(ODD)
    for r in pii.find(odd.unionByName(odd)).collect():
        spans = sorted((x["kind"], x["start"], x["end"]) for x in r["base"])
        assert spans == brute.personal_spans(texts[r["doc_id"]] or ""), r["doc_id"]


def test_personal_data_finds_unseen_identifiers_by_context(spark):
    rows = [(k, f"please dial hotline {'+1 (555) 555-0%03d' % k} before noon") for k in range(30)] + [(99, "please dial hotline 555.867.5309x11 before noon"), (98, "the year 20245 was fine")]
    found = {r["doc_id"]: r["added"] for r in pii.find(documents(spark, rows)).collect()}
    assert [(x["kind"], x["start"]) for x in found[99]] == [(3, 20)] and not found[98] and not found[0]


#: One hop: hotline numbers without a plus.  Two hops: what follows `extension` is only known by numbers that hop one finds.
PERSONAL = (
    [(500 + k, f"please dial hotline {'+1 (555) 555-0%03d' % k} before noon") for k in range(150)]
    + [(100 + k, f"please dial hotline (555) 867-5{300 + k} before noon") for k in range(10)]
    + [(200 + k, f"the extension (555) 867-5{300 + k} rang twice") for k in range(10)]
    + [(300, "the extension 70-1234-99 rang twice"), (301, "the extension 70-1234-99 rang twice"), (98, "the year 20245 was fine"), (99, f"please dial hotline {'x' * 400}1234 {'y' * 400} before noon"), (97, None), (96, "")]
)


def test_personal_data_bootstraps_until_nothing_is_new(spark):
    df = documents(spark, PERSONAL + PERSONAL[:3] + ODD, True)
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    want = brute.bootstrapped({i: t or "" for i, t in PERSONAL + ODD}, pii.MIN_SEEDS, pii.MIN_SCORE, pii.REACH)
    for i, text in PERSONAL + ODD:
        base = brute.personal_spans(text or "")
        assert [got[i][f"n_{k}"] for k in brute.KINDS] == [sum(x[0] == j for x in base) for j in range(4)]
        assert got[i]["base_sha256"] == brute.sha(brute.span_text(base))
        assert got[i]["spans"] == brute.span_text(base + want[i]), i
    assert got[100]["spans"] == "phone:20:34" and got[300]["spans"] == got[301]["spans"] == "phone:14:24" and not got[98]["spans"]


def test_personal_data_in_a_very_long_text(spark):
    text = " ".join(f"word{k} a{k}@b{k}.com é" for k in range(3000))
    row = pii.find(documents(spark, [(1, text)])).first()
    assert [(x["kind"], x["start"], x["end"]) for x in row["base"]] == brute.personal_spans(text)


def test_decontamination(odd, benchmark):
    want = {i: x for (i, _), x in zip(ODD, brute.contamination([t for _, t in ODD], [(r["item_id"], r["text"]) for r in benchmark.collect() if r["item_id"] is not None]), strict=True)}
    rows = decontamination.contamination(odd, benchmark).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == want[r["doc_id"]], r["doc_id"]


def test_decontamination_beyond_broadcast(odd, benchmark, monkeypatch):
    small = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(odd, benchmark).collect()}
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontamination, "MAX_DROPPED", 0)
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(odd, benchmark).collect()} == small
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(odd, benchmark).collect()}
    assert kept.isdisjoint({5, 6, 7, 8, 9, 17}) and {1, 2, 10, 12} <= kept


def test_decontamination_periodic_text(spark):
    rows = [(1, "a b " * 20), (2, "z " + "a b " * 7), (3, "b " * 30)]
    items = spark.createDataFrame([(1, "a b " * 8), (2, "b " * 13)], "item_id long, text string")
    want = brute.contamination([t for _, t in rows], [(1, "a b " * 8), (2, "b " * 13)])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.contamination(documents(spark, rows), items).collect()}
    assert [got[k] for k in (1, 2, 3)] == want


def near_copies(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    out = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 120]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((len(out) * 7 % 1009, " ".join(copy)))
    return out


@pytest.mark.parametrize(("seed", "k", "percent", "leaf", "levels"), [(1, 4, 85, 1000, 3), (2, 4, 85, 3, 2), (3, 5, 80, 4, 1)])
def test_jaccard_join(spark, seed, k, percent, leaf, levels):
    rows = near_copies(seed) + [(100000 + i, t) for i, t in ODD[:9]]
    want = brute.components(rows, k, percent)
    got = jaccard_join.link(documents(spark, rows), jaccard_join.Params(k=k, percent=percent, leaf=leaf, pivots=2, levels=levels)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_group_of_near_copies_is_split(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(base[k % 140 : k % 140 + 10]) if k % 50 == 49 else " ".join(w if rng.random() > 0.008 else f"x{k}" for w in base)) for k in range(150)]  # most within e of each other, some apart
    p = jaccard_join.Params(leaf=20, pivots=3, levels=2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(documents(spark, rows), p).collect()}
    assert got == brute.components(rows)


def test_jaccard_division_takes_few_tasks(spark):
    """Summaries of large regions are small: they should not cost the driver a task for each shuffle partition, level by level."""
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "256k"}
    before = {k: spark.conf.get(k) for k in held}
    sets = documents(spark, rows).select(F.lit(0).cast("long").alias("region"), F.col("doc_id").alias("node"), F.lit(97).cast("long").alias("n"), F.sequence(F.col("doc_id"), F.col("doc_id") + 96).alias("shingles"))
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.range(1).rdd.count()
        first = max(tracker.getJobIdsForGroup(None))
        p = jaccard_join.Params(leaf=20, pivots=3, levels=2)
        jaccard_join._divided(common.materialise(sets, "sets"), p, 1, len(rows))
        spark.range(1).rdd.count()
        last = max(tracker.getJobIdsForGroup(None))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in range(first + 1, last) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 0 < tasks < 400  # 1,323 where each summary was a task a partition, 140 now


def test_jaccard_chain_has_no_large_region(spark):
    words = [f"c{k}" for k in range(700)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(600)]  # each links to its neighbours only, all are one component
    p = jaccard_join.Params()
    found = jaccard_join.signatures(documents(spark, rows), p)
    none = spark.createDataFrame([], "d1 long, d2 long, n long, node long")
    sizes = [r["size"] for r in jaccard_join._regions(found, none, p).select("region", "size").distinct().collect()]
    assert max(sizes) < 130
    assert {r["component_id"] for r in jaccard_join.link(documents(spark, rows)).collect()} == {0}


def test_jaccard_region_alone():
    for seed in range(5):
        rows = [x for x in near_copies(seed) if x[1]]
        want = brute.components(rows)
        sets = [np.unique([hash(tuple(t.split()[j : j + 4])) for j in range(max(len(t.split()) - 3, 1))]) for _, t in rows]
        got = jaccard_join.join_region(np.array([i for i, _ in rows]), sets, 85)
        assert {i: int(c) for (i, _), c in zip(rows, got, strict=True)} == {i: c for i, (_, c) in want.items()}


def test_jaccard_repeated_ids_and_nulls(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE), (3, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 17, 1), (1, 17, 1), (2, 17, 1), (None, 17, None), (3, 0, 3)], key=str)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "node long, hub long")
    assert {r["component"] for r in components.connected_components(links).collect()} == {0, 1000}


def test_line_dedup(spark):
    rows = [(k, f"menu\nbody {k}\n\nfooter") for k in range(1, 20)]
    df = documents(spark, rows, True).withColumn("source", F.when(F.col("doc_id") < 15, "a").otherwise("b"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, 0.5, 6).collect()}
    assert got[3] == "body 3\n" and got[16] == "menu\nbody 16\n\nfooter"


def test_line_dedup_drops_lines_of_a_few_percent_of_the_pages(spark):
    passage = " ".join(f"long{k}" for k in range(60))
    rows = [(k, f"body {k}" + ("\nfooter" if k < 60 else "") + (f"\n{passage}" if k < 5 else "") + ("\npair" if 7 < k < 10 else "")) for k in range(100)]
    df = documents(spark, rows).withColumn("source", F.lit("site")).unionByName(documents(spark, [(1000 + k, f"{passage}\nother {k}") for k in range(2)]).withColumn("source", F.lit("small")))
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df).collect()}
    assert {got[k] for k in range(100)} == {f"body {k}" + ("\npair" if 7 < k < 10 else "") for k in range(100)}  # 60 and 5 pages of 100 go, 2 stay
    assert got[1000] == f"{passage}\nother 0"  # two pages of a host may be copies


def test_line_dedup_beyond_broadcast(spark, monkeypatch):
    df = documents(spark, [(k, f"menu\nbody {k}") for k in range(1, 40)]).withColumn("source", F.lit(None).cast("string"))
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", -1)
    assert {r["text"] for r in line_dedup.drop_boilerplate(df).collect()} == {f"body {k}" for k in range(1, 40)}


def test_byte_bpe_is_what_the_rank_encoder_gives(odd):
    import public_tokenizers as P
    import tiktoken

    codec = byte_bpe.Codec(*byte_bpe.vocabulary())
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.known, special_tokens={})
    rng = random.Random(5)
    texts = [t or "" for _, t in ODD] + ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x2000, 0x2100), 32, 10, 0x1F600 + rng.randrange(60)])) for _ in range(150)) for _ in range(150)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids).decode() == text
        assert codec.digest(text) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))
    back = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(byte_bpe.encode(odd)).collect()}
    assert back == {i: t or "" for i, t in ODD}


def test_byte_bpe_with_another_vocabulary():
    import public_tokenizers as P

    codec = byte_bpe.Codec(*byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")))
    assert codec.decode(codec.encode("héllo  wörld\n")).decode() == "héllo  wörld\n"


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("https://x.com/en/8", "x.com", "/en/8", "com/en/", "block"), ("https://com/en/", "com", "/en/", "com/en/", "block"), ("https://xcom/en/1", "xcom", "/en/1", None, "allow"),
    ("ftp://a.net/x.com/en/", "a.net", "/x.com/en/", None, "allow"), ("https://b.example.net/de/8#q", "b.example.net", "/de/8", "example.net/de/8", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("https://good.org", "good.org", "", None, "allow"),
    ("https://my-spam.org/a", "my-spam.org", "/a", None, "block"), ("https://a.org/es/" + "y" * 5000, "a.org", "/es/" + "y" * 5000, "org/es/", "block"),
])
def test_url_filters(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, host string, rule string")
    r = url_filters.judge(df).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_automaton_spans_words():
    rules = tuple(url_filters.Rule(f"**{k:03d}**z", "block") for k in range(60))
    a = url_filters.Automaton(rules)
    assert a.words > 3
    texts = ["a017bz", "017", "059z", "nothing", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    assert a.best(data, offsets).tolist() == [17, -1, 59, -1, -1]


def labelled_rows(spark, bad_word, n=240):
    rng = random.Random(3)
    vocabulary = [f"tok{k}" for k in range(40)]
    rows, labels = [], []
    for k in range(n):
        y = k % 3 == 0
        rows.append((k, " ".join(rng.choice(vocabulary) if not (y and rng.random() < 0.15) else bad_word for _ in range(60))))
        labels.append((k, int(y)))
    return documents(spark, rows, True), spark.createDataFrame(labels, "doc_id long, label int")


def test_toxicity_held_out(spark):
    df, labels = labelled_rows(spark, "idiot")
    model = toxicity.fit(df, labels.where("doc_id < 180"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(scores) == 240 and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[k] >= 0.5) == (k % 3 == 0) for k in range(180, 240)]) > 0.95


def test_toxicity_counts_grow_with_the_words(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(1000))) for k in range(600)]  # 600,000 words, each once
    words, _ = toxicity.count(documents(spark, rows).select("text", (F.col("doc_id") % 2).cast("int").alias("label")), toxicity.Params())
    both = F.col("n0") + F.col("n1")
    assert tuple(words.agg(F.count(F.lit(1)), F.sum(both), F.max(both), F.sum(F.col("c0") + F.col("c1"))).first()) == (600000, 600000, 1, 600 * 999)


def test_toxicity_is_kneser_ney(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)] + ["stemone", "stemtwo", "stemsix"]
    rows = [(k, " ".join(rng.choice(vocabulary[: 8 + k % 8]) if rng.random() < 0.8 else f"rare{k}" for _ in range(rng.randrange(1, 40)))) for k in range(120)]
    p = toxicity.Params(discount=1.5, discount_pair=6)
    labelled = documents(spark, rows).select("text", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    words, pairs = toxicity.count(labelled, p)
    ratio = brute.kneser_ney([(t, int(k % 3 == 0)) for k, t in rows], p.discount, p.discount_pair)
    texts = [t for _, t in rows] + ["unseen", "stemten w1 w2", "w1 unseen w2 w3 w4 w5 w6 w7 w0 w1 w2 w3"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rated = toxicity.ratios(words.select("a", "b", "n0", "n1", "c0", "c1"), pairs, p)
    assert {r["kind"] for r in rated.select("kind").distinct().collect()} == {0, 1, 2, 3, 4}
    for r in toxicity.measure(df, rated).collect():
        want = sorted(ratio(texts[r["k"]]))
        cut = len(want) // 10
        assert (r["n"], r["mean"], r["middle"]) == pytest.approx((len(want), np.mean(want), np.mean(want[cut : len(want) - cut])), abs=1e-9)


def test_toxicity_counts_every_labelled_row(spark):
    df, labels = labelled_rows(spark, "idiot")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.Params().calibrate)) == 0
    df = df.withColumn("text", F.when(fold & (F.col("doc_id") % 3 == 0), F.concat(F.lit("moron "), "text")).otherwise(F.col("text")))  # only in held-out rows, and toxic
    model = toxicity.fit(df, labels)
    words, _ = toxicity.count(common.labelled(df, labels).withColumn("held", fold), toxicity.Params())
    assert toxicity.without_held(words).count() < words.count()
    score = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, [(1, "tok1 unseen tok3"), (2, "tok1 moron tok3")]), model).collect()}
    assert score[2] > score[1]


def test_toxicity_of_texts_of_toxic_words(spark):
    rng = random.Random(4)
    plain, bad = [f"tok{k}" for k in range(40)], ["idiot", "scum", "moron", "loser"]
    rows = [(k, " ".join(rng.choice(bad if k % 3 == 0 and rng.random() < 0.15 else plain) for _ in range(60))) for k in range(240)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, label int"))
    toxic = ["idiot", "idiot scum", "moron scum loser", "tok1 idiot", "idiot loser " * 30, "idiot scum moron tok3 " * 20]
    neutral = ["tok1", "tok1 tok2", "tok4 tok5 tok6", "tok1 tok2 tok3 tok4 " * 20]
    score = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, list(enumerate([*toxic, *neutral]))), model).collect()}
    assert min(score[k] for k in range(len(toxic))) > 0.7 > max(score[len(toxic) + k] for k in range(len(neutral)))


def test_toxicity_beyond_broadcast(spark, odd, monkeypatch):
    df, labels = labelled_rows(spark, "idiot")
    both = df.unionByName(odd).unionByName(odd).unionByName(df.limit(9))
    want = toxicity.score(both, toxicity.fit(df, labels)).collect()
    monkeypatch.setattr(toxicity, "MAX_BROADCAST", 0)
    got = toxicity.score(both, toxicity.fit(df, labels)).collect()
    assert np.allclose(sorted((r["doc_id"], r["score"]) for r in got), sorted((r["doc_id"], r["score"]) for r in want), atol=1e-6)


def test_toxicity_of_a_phrase_of_ordinary_words(spark):
    rng, rows = random.Random(9), []
    for k in range(240):
        words = [f"tok{j}" for j in rng.sample(range(3, 40), 20)]
        for j, at in enumerate((2, 8, 14)):  # the same words and as many predecessors in either class, other neighbours
            words[at : at + 1] = [f"left{j}", f"{(j + (k % 3 == 0)) % 3}right"]
        rows.append((k, " ".join(words)))
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(180)], "doc_id long, label int"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, rows), model).collect()}
    assert np.mean([(score[k] >= 0.5) == (k % 3 == 0) for k in range(180, 240)]) > 0.95


def test_toxicity_counts_all_pairs(spark):
    rows = [(k, f"a{k} b{k} c{k} a{k} b{k}") for k in range(30)]
    _, pairs = toxicity.count(documents(spark, rows).select("text", (F.col("doc_id") % 2).cast("int").alias("label")), toxicity.Params())
    assert tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.col("n0") + F.col("n1"))).first()) == (90, 120)


def test_toxicity_ratios_take_little_of_the_driver(spark):
    n = 600_000
    rated = spark.range(n, numPartitions=12).select((F.col("id") % 4).cast("int").alias("kind"), F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), F.col("id").cast("double").alias("ratio"))
    tracemalloc.start()
    found, peak = toxicity._lookups(rated), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * n, peak / n  # 16 bytes of them are the result
    ids = np.arange(n)
    rows = rated.orderBy("ratio").toPandas()
    a, b = (rows[c].to_numpy().view(np.uint64) for c in "ab")
    for kind in range(4):
        keys = toxicity._pair_hash(a, b) if kind == toxicity.PAIR else b
        assert np.array_equal(found[kind].get(keys), np.where(ids % 4 == kind, ids, np.nan), equal_nan=True)


def test_toxicity_leaves_no_counts_behind(spark):
    df, labels = labelled_rows(spark, "idiot", 60)
    before = set(common._written)
    toxicity.fit(df, labels)
    left = [path for key, (_, path) in common._written.items() if key not in before]
    assert len(left) == 1 and "toxicity-ratios" in left[0]


def test_materialise_frees_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size())}

    before = files()
    counts = common.materialise(spark.range(5000).groupBy(F.xxhash64("id").alias("a")).count(), "test-counts", free=True)
    for _ in range(50):
        if not (left := {x for x in files() - before if x.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    assert not left and counts.count() == 5000 and spark.conf.get(common.FREE_SHUFFLES) == "false"


def test_quality_held_out(spark):
    df, labels = labelled_rows(spark, "good!")
    model = quality_classifier.fit(df, labels.where("doc_id < 180"), quality_classifier.Params(epochs=12))
    df = df.drop("score")
    scored = quality_classifier.score(df, model)
    scores = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert scored.columns[:-1] == df.columns
    assert np.mean([(scores[k] >= 0.5) == (k % 3 == 0) for k in range(180, 240)]) > 0.95


def test_classifiers_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(6, 1), (8, 1)], "doc_id long, label int")
    for labels in (none, one):
        assert {round(r["score"], 6) for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0.5}
        got = quality_classifier.score(odd.drop("score"), quality_classifier.fit(odd, labels)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_empty_tables(spark, benchmark):
    empty = documents(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert sharding.assign(empty).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert jaccard_join.link(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert quality_classifier.score(empty, quality_classifier.fit(empty, labels)).count() == 0
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert decontamination.drop_contaminated(documents(spark, ODD), benchmark.limit(0)).count() == len(ODD)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    rows = docs.collect()
    assert all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(x[3] for x in brute.contamination([r["text"] for r in rows], items))
    groups = brute.components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    assert all(c == i for i, (_, c) in groups.items())


def test_unused_types_do_not_matter(spark):
    df = documents(spark, ODD).withColumn("when", F.lit(dt.datetime(2024, 1, 1))).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert quality_rules.judge(df).count() == jaccard_join.link(df).count() == len(ODD)


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    """Whole small tables for the queries: odd rows, personal data, labelled prose."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    plain, bad = [f"tok{k}" for k in range(40)], ["idiot", "scum", "moron"]
    prose = [(1000 + k, " ".join(rng.choice(bad if k % 3 == 0 and rng.random() < 0.2 else plain) for _ in range(50)) + (" good!" * 5 if k % 2 else "")) for k in range(300)]
    rows = ODD + [(4000 + i, t) for i, t in PERSONAL] + prose + [(None, "no id at all"), (6, PASSAGE)]
    documents(spark, rows, True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(k % 2), int(k % 3 == 0)) for k, (i, _) in enumerate(prose)] + [(None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_queries_return_what_the_contract_says(spark, fixture_dir):
    folder, rows = fixture_dir
    crc = lambda i: zlib.crc32(str(i).encode())
    run = lambda name: QUERIES[name](spark, folder).collect()

    got = run("op1_sharding")
    brute.bound_walk([(r["shard"], r["slot"]) for r in got], 16)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}

    for name, divisor, fold, right in (("op2_toxicity", 3, 1, lambda k: k % 3 == 0), ("op8_quality_classifier", 4, 2, lambda k: k % 2 == 1)):
        got = run(name)
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        assert all(r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % divisor == fold) for r in got)
        held = [r for r in got if r["held_out"] and 1000 <= r["doc_id"] < 1300]
        assert np.mean([r["predicted"] == right(r["doc_id"] - 1000) for r in held]) > 0.9

    want = {i: (t or "") for i, t in rows}
    for r in run("op3_quality_rules"):
        counts = brute.quality_counts(want[r["doc_id"]])
        assert {k: r[k] for k in counts} == counts and r["kept"] == (not r["base_failed"] and brute.quality_verdict(want[r["doc_id"]], quality_rules.RULES, quality_rules.STOP_WORDS))

    found = brute.bootstrapped({k: t or "" for k, (_, t) in enumerate(rows)}, pii.MIN_SEEDS, pii.MIN_SCORE, pii.REACH)
    spans = {i: brute.span_text(brute.personal_spans(t or "") + found[k]) for k, (i, t) in enumerate(rows)}
    assert all(r["spans"] == spans[r["doc_id"]] for r in run("op4_pii"))

    import public_tokenizers as P
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={x: k for k, x in enumerate(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}, special_tokens={})
    for r in run("op10_byte_bpe"):
        ids = encoder.encode_ordinary(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(want[r["doc_id"]]))


#: Names that operators use, or could, and names that need quoting.
CLASHES = ["text_", "id", "id_", "hash", "host", "bad", "salt", "gone", "Gone_", "score", "SCORE_", "__text", "__score", "__host", "__bad", "__id", "__hash", "__gone", "a`b", "a.b", "node", "region", "near", "blocks", "row number"]


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_clashing_names(spark, sf_dir, kind):
    df = documents(spark, ODD + [(6, PASSAGE), (None, "x y z"), (None, None)]).withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASHES)])
    docs = common.materialise(df.limit(0) if kind == "empty" else df, "clashes")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        kept = out.columns[: len(docs.columns)]
        assert kept == docs.columns and (number == len(corpus_pipeline.STAGES) - 1 or len(out.columns) == len(kept)), name
        rows = out.collect()
        assert len(rows) <= len(ODD) + 3 and (kind == "odd" or not rows)
        assert all(r[c] == f"v{k}" for r in rows for k, c in enumerate(CLASHES))


def test_pipeline_on_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
