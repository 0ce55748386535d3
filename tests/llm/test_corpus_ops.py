"""Operators over whole corpora against brute force: decontamination, archives, scores, near duplicates, mixtures, pipeline."""

import collections
import hashlib
import math
import random
import re
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, mixing, near_dup, suffix_tree, warc
from tidemark.llm.common import Workspace, bitmap, components, in_bitmap, without

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(LOW))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def vary(base, rnd, share):
    return " ".join(rnd.choice("uvw") + str(rnd.randint(0, 999)) if rnd.random() < share else w for w in base.split())


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    new = lambda n: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(n))
    texts = [None, "", "  \n", "a b", "A  b", "a b c d e", new(6000)]
    for size, share in ((200, 0.012), (120, 0.03), (60, 0.01)):
        base = new(80)
        texts += [vary(base, rnd, share) for _ in range(size)]
    texts += [new(60)] * 40 + [new(rnd.randint(20, 90)) for _ in range(150)]
    rnd.shuffle(texts)
    rows = [(i, t, "xx", f"s{i % 3}" if i % 2 else "hot", 1) for i, t in enumerate(texts)]
    return rows + [rows[9], (None, texts[10], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).withColumns({"c": F.lit(1), "node": F.lit("x"), "key": F.lit(2), "f1": F.lit(3)}).repartition(5)


def brute_components(rows, percent=75):
    ids = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    sets = dict(ids)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in inverted[s])
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("options", [{}, {"block": 16, "work": 500, "depth": 3}])
def test_near_duplicates_equal_brute_force(docs, corpus, options):
    want, sets = brute_components(corpus)
    got = near_dup.near_duplicates(docs, **options).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_one_document_of_each_group_stays(docs, corpus):
    want, _ = brute_components(corpus)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(i for i, k in want.items() if i == k)
    assert kept.filter("doc_id is null").count() == 1
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 90])
def test_near_duplicates_at_other_thresholds(spark, percent):
    """Pairs just above the threshold: at least 0.99 of them are linked."""
    rnd = random.Random(percent)
    rows = []
    for i in range(150):
        a = [f"v{rnd.randint(0, 10**6)}" for _ in range(200)]
        b = list(a)
        while True:
            c = list(b)
            c[rnd.randrange(200)] = f"u{rnd.randint(0, 10**6)}"
            s, t = (shingle_set(" ".join(x)) for x in (a, c))
            if 100 * len(s & t) < percent * len(s | t):
                break
            b = c
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    want, _ = brute_components(rows, percent)
    assert all(want[2 * i + 1] == 2 * i for i in range(150))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, depth=2).collect()
    right = sum(r["component_id"] == want[r["doc_id"]] for r in got)
    assert right >= 0.99 * len(rows) and near_dup.least_agree(75) == 85


def test_rows_that_repeat_an_id_stay_if_their_texts_differ(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a, "p"), (1, b, "q"), (2, a + " end", "r"), (1, a, "s"), (3, None, "t"), (3, "", "u"), (None, a, "v"), (4, b, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    assert sorted(r["key"] for r in near_dup.drop_near_duplicates(df).collect()) == ["p", "q", "t", "u", "v"]


def test_components_bitmaps_and_without(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, rnd.randint(101, 400)) for _ in range(300)] + [(500, 500)]
    ws = Workspace(spark, "t")
    got = {r["c"]: r["k"] for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert all(got[i] == 0 for i in range(41)) and {v for k, v in got.items() if k >= 100} == {100}
    partial = components(spark.createDataFrame(edges, "a long, b long"), ws, rounds=1)
    assert partial.groupBy("c").count().filter("count > 1").count() == 0
    import numpy as np

    values = np.array([5, -7, 1 << 40, (1 << 33) + 5], np.int64)
    bits = bitmap(spark.createDataFrame([(int(v),) for v in values], "x long"), "x", 16)
    assert in_bitmap(bits, values, 16).all() and in_bitmap(bits, np.arange(1000, 2000), 16).sum() < 10
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "c"), (None, "d")], "doc_id long, text string").withColumns({"key": F.lit(1), "concerned": F.lit(True), "_key": F.create_map(F.lit(1), F.lit(2))})
    out = without(df, spark.createDataFrame([(3,)], "key long"), F.col("doc_id"), spark.createDataFrame([(2,)], "key long"))
    assert out.columns == df.columns
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == [(1, "a"), (2, "a"), (None, "d")]


def test_contracted_edges_are_about_one_a_vertex(spark):
    """A group linked to several pivots kept all its links, as equal edges too, and met them again in every round."""
    edges = [(leaf, pivot) for leaf in range(1000, 1400) for pivot in (3, 500, 2000, 2001)] + [(7, 8), (8, 9)]
    ws = Workspace(spark, "t")
    kept = common.contracted(spark.createDataFrame(edges, "a long, b long"), ws, rounds=2)
    assert kept.count() <= 407
    got = {r["c"]: r["k"] for r in components(kept.select(F.col("u").alias("a"), F.col("v").alias("b")), ws).collect()}
    assert got == {**{x: 3 for e in edges[:-2] for x in e}, 7: 7, 8: 7, 9: 7}


def test_contained_items_equal_brute_force(spark, docs, corpus):
    rnd = random.Random(3)
    new = lambda n: " ".join(f"q{rnd.randint(0, 9999)}" for _ in range(n))
    items = [(i, new(n)) for i, n in enumerate([16, 20, 33, 59, 150, 7, 5])] + [(20, None), (21, ""), (22, "a b"), (None, new(20)), (23, "a b c d e")]
    hosts = []
    for k, (i, t) in enumerate(items[:7]):
        long = " ".join(f"z{rnd.randint(0, 5000)}" for _ in range(9000)).split()
        at = rnd.randint(0, 8999)
        hosts.append((10_000 + k, " ".join(long[:at] + vary(t, rnd, 0.02).upper().split() + long[at:]), "xx", "hot", 1))
        hosts.append((20_000 + k, " ".join(t.split()[: len(t.split()) // 2]), "xx", "hot", 1))
    rows = corpus + hosts
    df = spark.createDataFrame(rows, SCHEMA).withColumn("keys", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    want = set()
    for d, t, *_ in rows:
        s = shingle_set(t)
        for i, x in items:
            x = shingle_set(x)
            if d is not None and i is not None and x and 100 * len(s & x) >= 75 * len(x):
                want.add((d, i, len(s & x), len(x)))
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.contained_items(df, it).collect()}
    assert got == want and len(want) > 7
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, it).collect()} == {r[0] for r in rows} - {w[0] for w in want}
    assert decontaminate.contained_items(df, it.limit(0)).count() == 0 and decontaminate.contained_items(df.limit(0), it).count() == 0


def test_suffix_tree_base_and_gain(spark, docs, corpus):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, words(t) + ["\0"]) for i, t, *_ in corpus]
    count = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    cond = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    for share in (4e-7, 2e-3):  # all words broadcast; most counts by join
        got = suffix_tree.score_texts(docs, cond, word_share=share).collect()
        assert len(got) == len(corpus)
        want = collections.defaultdict(list)
        for i, t in tokens:
            want[i].append((len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)))
        have = collections.defaultdict(list)
        for r in got:
            have[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
            assert r["held_out"] == held(r["doc_id"])
        assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
        if share < 1e-3:
            test = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert suffix_tree.score_texts(docs.limit(0), cond).count() == 0


def test_suffix_tree_prefers_what_follows_a_context(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["a b c", "a b d", "x y"]) for _ in range(30))) for i in range(40)]
    asked = [(1000 + k, f"x y a b {w}") for k, w in enumerate("abcdxy")] + [(2000, "x y a b unseen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(False)).union(spark.createDataFrame(asked, "doc_id long, text string").withColumn("h", F.lit(True)))
    got = {r["doc_id"]: r for r in suffix_tree.score_texts(df, F.col("h")).collect()}
    by = {w: got[1000 + k]["score"] for k, w in enumerate("abcdxy")}
    assert min(by["c"], by["d"]) > max(by[w] for w in "abxy") + 0.5 > got[2000]["score"]
    assert got[1002]["score"] > got[1002]["base_score"]


def test_hash_index():
    import numpy as np

    words = np.arange(4, dtype=np.uint64) + np.uint64(9)
    index = suffix_tree.HashIndex(words)
    assert index.find(words).tolist() == [0, 1, 2, 3] and index.find(np.array([0, 99], np.uint64)).tolist() == [-1, -1]


def test_suffix_tree_without_training_rows(spark, docs, corpus):
    got = suffix_tree.score_texts(docs, F.lit(True)).collect()
    assert len(got) == len(corpus)
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}


def test_near_duplicates_take_trees_for_their_depth(spark, monkeypatch):
    got, count = [], near_dup.trees_for
    monkeypatch.setattr(near_dup, "trees_for", lambda *a, **b: got.append(count(*a, **b)) or got[-1])
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, base), (2, base + " end"), (3, "x y z")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, depth=3).collect()} == {1: 1, 2: 1, 3: 3}
    assert (1 - near_dup._survives(0.75, 3)) ** got[0] <= 1e-4


def brute_tree_scores(texts, asked, depth=3, least=2):
    """log10 scores by the longest retained suffix, from plain counts of all sequences."""
    rows = [words(t) + ["\0"] for t in texts]
    count = collections.Counter(tuple(r[i : i + k]) for r in rows for k in range(1, depth + 2) for i in range(len(r) - k + 1))
    n, v = sum(len(r) for r in rows), len({w for r in rows for w in r})
    floor = n + 0.1 * (v + 1)
    smooth = {s: (f + 0.1) / floor for s, f in count.items() if len(s) == 1}
    rest, own = {}, {}
    for k in range(2, depth + 2):
        kids = collections.defaultdict(list)
        for s, f in count.items():
            if len(s) == k and f >= least:
                kids[s[:-1]].append(s)
        for c, some in kids.items():
            mass = {s: (count[s] - 0.5) / count[c] for s in some}
            left = 1 - sum(mass.values())
            gain = sum(count[s] * math.log((mass[s] + left * smooth[s[1:]]) / smooth[s[1:]]) for s in some) + (count[c] - sum(count[s] for s in some)) * math.log(left)
            if gain > 0.5 * math.log(n) * len(some):
                rest[c] = left
                own.update(mass)
            smooth.update({s: mass[s] + left * smooth[s[1:]] if c in rest else smooth[s[1:]] for s in some})
    out = []
    for r in (words(t) + ["\0"] for t in asked):
        score = 0.0
        for i, w in enumerate(r):
            p = (count[(w,)] + 0.1) / floor
            for k in range(1, min(i, depth) + 1):
                c = tuple(r[i - k : i])
                if c in rest:
                    p = own.get((*c, w), 0.0) + rest[c] * p
            score += math.log10(p)
        out.append(score)
    return out


def test_suffix_tree_keeps_rare_sequences_of_a_large_table(spark, monkeypatch):
    """A pair of two occurrences counts among 600,000 tokens too; by share it took three."""
    rnd = random.Random(3)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.8))}" for _ in range(400)) for _ in range(1500)] + ["oak elm ash fir", "yew oak elm ash fir", None, ""]
    asked = ["oak elm ash fir", "oak elm", "yew oak", texts[0], texts[5] + " oak elm ash", None]
    df = spark.createDataFrame([(i, t, i >= len(texts)) for i, t in enumerate(texts + asked)], "doc_id long, text string, h boolean")
    want = brute_tree_scores(texts, texts + asked)
    for share, hot in ((5e-6, 1 << 22), (1.0, 2000)):  # what is broadcast and what is hot changes nothing
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        got = {r["doc_id"]: r for r in suffix_tree.score_texts(df.repartition(3), F.col("h"), cache_share=share).collect()}
        assert len(got) == len(want) and max(abs(got[i]["score"] - w) for i, w in enumerate(want)) < 1e-6
    assert got[len(texts)]["score"] > got[len(texts)]["base_score"] + 3


@pytest.mark.parametrize("hot, rows, share, depth", [(40, 500, 4e-7, 3), (25, 200, 0.02, 3), (30, 1 << 20, 0.02, 1), (1 << 21, 300, 0.02, 2)])
def test_suffix_tree_of_hot_and_rare_words_equals_brute_force(spark, monkeypatch, hot, rows, share, depth):
    """Hot contexts of every length, rare words counted in the shuffle, and many reducers."""
    rnd = random.Random(5)
    line = "the quick brown fox of the quick brown dog of the end"
    texts = [" ".join(line if rnd.random() < 0.1 else f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["oak elm"] * 2 + [None, "", "the"]
    asked = ["quick brown fox of the", "oak elm the quick", line, "unseen the quick", texts[3]]
    for name, value in (("HOT", hot), ("TASK_ROWS", rows), ("FLUSH", 1000)):
        monkeypatch.setattr(suffix_tree, name, value)
    df = spark.createDataFrame([(i, t, i >= len(texts)) for i, t in enumerate(texts + asked)], "doc_id long, text string, h boolean")
    want = brute_tree_scores(texts, texts + asked, depth=depth)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_texts(df.repartition(4), F.col("h"), word_share=share, depth=depth).collect()}
    assert len(got) == len(want) and max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-6


def test_suffix_tree_sends_blocks_of_many_tokens(spark, monkeypatch):
    """Tasks gather tokens before they deal them to many reducers: a block for each part and batch grew with the square of the table."""
    rnd = random.Random(6)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.8))}" for _ in range(200)) for _ in range(600)]
    made, lean = spark.sparkContext.accumulator(0), suffix_tree.lean

    def counted(run):
        def each(batches):
            for b in run(batches):
                made.add(b.num_rows)
                yield b

        return lean(each)

    monkeypatch.setattr(suffix_tree, "lean", counted)
    for size in ("TASK_ROWS", "TASK_KEYS"):
        monkeypatch.setattr(suffix_tree, size, 100, raising=False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert suffix_tree.score_texts(df.repartition(3), F.col("doc_id") % 10 == 0).count() == 600
    assert made.value < 600 * 200 / 2, made.value


def test_suffix_tree_keeps_blocks_of_many_tokens_after_hot_words(spark, monkeypatch):
    """What follows hot words came in a block for each file and reducer, and then for each part of every slice: with the square of the table."""
    rnd = random.Random(6)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.8))}" for _ in range(200)) for _ in range(600)]
    made, lean = collections.defaultdict(lambda: spark.sparkContext.accumulator(0)), suffix_tree.lean

    def counted(run):
        own = made[run.__qualname__.split(".")[0]]

        def each(batches):
            for b in run(batches):
                own.add(b.num_rows)
                yield b

        return lean(each)

    for name, value in (("lean", counted), ("HOT", 200), ("TASK_ROWS", 20000), ("SLICES", 2)):
        monkeypatch.setattr(suffix_tree, name, value)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(40)
    assert suffix_tree.score_texts(df, F.col("doc_id") % 10 == 0).count() == 600
    rows = {name: x.value for name, x in made.items()}
    assert 0 < rows["_hot_counted"] < 3000 and 0 < rows["_past_hot"] < 1000, rows


def test_archives_round_trip(spark):
    rnd = random.Random(5)
    big = "<p>" + "é" * 600
    rows = [(i * 7 - 50, f"http://h/{i}", "".join(rnd.choice("<p>abc é\n") for _ in range(rnd.randint(0, 4000)))) for i in range(120)]
    rows += [(2000 + i, None, big) for i in range(30)] + [(5, "http://x y/\n", None), (6, "", "small"), (7, "u", "small"), (2029, "u", big), (None, "u", big), (None, "v", "z" * 1200), (1 << 40, "far", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"shard": F.lit(1), "digest": F.lit("d")})

    def run(parts, **kw):
        root = Workspace(spark, "warc").root
        m = warc.write_warc(df.repartition(parts), root, **kw)
        return m, warc.read_warc(spark, root).collect()

    m, got = run(4, shard_bytes=20_000, file_bytes=6_000)
    files = {r["name"]: (r["sha1"], r["bytes"], r["records"]) for r in m.collect()}
    assert len(files) > 5 and sum(x[2] for x in files.values()) == len(rows)
    assert {r["name"]: (r["sha1"], r["bytes"], r["records"]) for r in run(9, shard_bytes=20_000, file_bytes=6_000)[0].collect()} == files
    want = collections.Counter((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows)
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    byhtml = collections.Counter((r["page_id"], r["payload"].decode()) for r in got if r["record_type"] == "response")
    assert all(byhtml[(p, h or "")] >= 1 for p, _, h in rows if p is not None and len((h or "").encode()) < 1000)
    copies = [r for r in got if r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()]
    assert len(copies) == 32 and [r["page_id"] for r in copies if r["record_type"] == "response"] == [2029]
    assert {r["refers_to"] for r in copies if r["record_type"] == "revisit"} == {2029}
    none = Workspace(spark, "warc").root
    assert warc.write_warc(df.limit(0), none).count() == 0 and warc.read_warc(spark, none).count() == 0


def test_mixture_meets_quotas_and_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(5000, None, "hot"), (5001, "x", None), (5002, "", "none"), (7, "again again", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"s": F.lit(1), "pass": F.lit(2), "o": F.lit(3), "quota": F.lit(4)})
    share = {"bucket_rows": 100, "block_tokens": 500}
    out = mixing.mixture(df, entropy_share=0.98, max_passes=3.0, **share).toPandas()
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    took = out.groupby(out["source"].fillna("-"))["n_tokens"].sum()
    budget = sum(tokens.values())
    assert abs(took.sum() - budget) < 13 * len(took) + 13
    assert all(took.get(s or "-", 0) <= 3.0 * n + 13 for s, n in tokens.items() if n) and "none" not in set(out["source"])
    for _, g in out.groupby("block"):
        assert sorted(g["place"]) == list(range(len(g)))
    full = out[out["pass"] == 0].groupby("source").size()
    assert full["s0"] == sum(1 for _, _, s in rows if s == "s0")
    same = mixing.mixture(df.repartition(7), entropy_share=0.98, max_passes=3.0, **share).toPandas()
    key = ["doc_id", "pass", "block", "place", "n_tokens"]
    assert out[key].sort_values(key).values.tolist() == same[key].sort_values(key).values.tolist()
    plain = mixing.mixture(df, max_passes=1.0, **share)
    assert plain.groupBy("pass").count().collect()[0]["pass"] == 0
    assert mixing.mixture(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixture(df, budget=10 * budget, max_passes=3.0)


def test_mixture_spreads_rows_without_an_id(spark, monkeypatch):
    """Half of the rows have no id and one length: their buckets and blocks hold no more than others, in any partitioning."""
    monkeypatch.setattr(mixing, "COPIES", 50)
    rows = [(None, "w w w", "hot")] * 600 + [(i, "w w w", "hot") for i in range(600)] + [(7, "w w w", "hot")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("x"))
    runs = [mixing.mixture(df.repartition(n), budget=1950, bucket_rows=50, block_tokens=195).toPandas() for n in (2, 5)]
    for out in runs:
        assert abs(out["n_tokens"].sum() - 1950) < 4
        assert 0.3 < out["doc_id"].isna().mean() < 0.6 and all(0.15 < g["doc_id"].isna().mean() < 0.75 for _, g in out.groupby("block"))
    key = ["doc_id", "pass", "block", "place"]
    assert [x[key].fillna(-1).sort_values(key).values.tolist() for x in runs][0] == [x[key].fillna(-1).sort_values(key).values.tolist() for x in runs][1]


def test_exponent_meets_the_target(spark):
    src = spark.createDataFrame([(1000.0,), (10.0,), (100.0,)], "tokens double")

    def entropy(a):
        p = [x**a for x in (1000, 10, 100)]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    a = mixing.find_exponent(src, 1110.0, 0.8, None)
    assert entropy(a) <= 0.8 < entropy(a - 1e-4)
    assert mixing.find_exponent(src, 1110.0, 99.0, None) == 0.0 and mixing.find_exponent(src, 1110.0, 0.01, None) == 1.0
    b = mixing.find_exponent(src, 1110.0, None, 2.0)
    w = 10**b / sum(x**b for x in (1000, 10, 100)) * 1110 / 10
    assert 1.9 < w <= 2.0


def test_pipeline_of_an_empty_table(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0


def test_archive_paths_of_hadoop(tmp_path):
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        fs, path = warc._open(root)
        assert fs.type_name == "local" and path == str(tmp_path)


def test_pipeline_stages_follow_one_another(spark, corpus):
    good = [(i, t, "xx", s, n) for i, t, _, s, n in corpus if t and len(t.split()) > 19 and i is not None]
    item = " ".join(f"q{i}" for i in range(30))
    rows = good + [(9001, "short", "xx", "a", 1), (9002, "r e p e a t a b c d " * 20, "xx", "a", 1), (9003, f"{' '.join('k%d' % i for i in range(40))} {item}", "xx", "a", 1), (9004, " ".join("m%d" % i for i in range(30)) + " call 4785380592391139", "xx", "a", 1)]
    base = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    want, _ = brute_components(good)
    out = corpus_pipeline.run(spark, base).toPandas()
    expected = {i for i, k in want.items() if i == k} | {9004}
    assert set(out["doc_id"]) <= expected and len(out) > 0.8 * len(expected)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = Workspace(spark, "t").write(docs)
    assert {r["doc_id"] for r in docs.collect()} == expected
    assert "4785380592391139" not in docs.filter("doc_id = 9004").first()["text"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_a_shingle_that_all_items_share_multiplies_nothing(spark):
    """Items and documents that all hold one passage meet only where they share more; the result is exact."""
    rnd = random.Random(31)
    new = lambda n: " ".join(f"q{rnd.randint(0, 10**6)}" for _ in range(n))
    opening = "answer the following question with"
    items = [(i, f"{opening} {new(40)}") for i in range(150)]
    rows = [(i, f"{new(30)} {opening} {items[i][1][len(opening) :] if i % 3 == 0 else new(40)} {new(30)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    sets = {i: shingle_set(t) for i, t in items}
    want = {(d, i) for d, t in rows for i in sets if 100 * len(sets[i] & shingle_set(t)) >= 75 * len(sets[i])}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want == {(i, i) for i in range(0, 150, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "shingle#" not in plan and "array_intersect" in plan
