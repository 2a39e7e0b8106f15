"""Operators on groups of documents and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotlog.llm import ann, near_dedup, registry, substring_dedup
from knotlog.llm import components as components_module
from knotlog.llm._common import Words, runs_of
from knotlog.llm.components import components

DOC = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    rnd.shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {k: v for k, v in brute_components(edges).items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(rows, width, percent):
    sets, ids = {}, defaultdict(set)
    for d, t, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        s = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sets.setdefault(s, len(sets))
        if d is not None and s:
            ids[s].add(d)
    edges, keys = [], list(ids)
    for i, a in enumerate(keys):
        edges += [(min(ids[a]), x) for x in ids[a]]
        edges += [(min(ids[a]), min(ids[b])) for b in keys[:i] if 100 * len(a & b) >= percent * len(a | b)]
    return brute_components(edges)


def near_corpus(seed, groups, size, edits):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(groups):
        words = rnd.choices(vocabulary, k=rnd.randrange(40, 160))
        for _ in range(rnd.randrange(1, size)):
            own = words[:]
            for _ in range(rnd.randrange(edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own), "s"))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near(spark, width, percent):
    rows = near_corpus(1, 25, 8, 9) + near_corpus(2, 1, 2, 1)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "Two words", "s"), (904, "two WORDS", "s"), (905, "one", "s"), (906, "one", "s"), (None, rows[0][1], "s"), (None, None, "s"), (3, rows[3][1], "repeat"), (907, rows[9][1], "copy"), (908, "long " * 6000, "s")]
    docs = spark.createDataFrame(rows, DOC).withColumn("component_id", F.lit("clash"))
    got = near_dedup.near_duplicates(docs, width=width, percent=percent).collect()
    want = brute_near(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])
    kept = near_dedup.keep_first(docs, width=width, percent=percent)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in rows if d is None or want.get(d, d) == d}


def test_near_large_group(spark):
    """A group of near copies wider than any neighbourhood is one component."""
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = words[:]
        own[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own), "s"))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC), width=3, percent=85).collect()
    assert {r["component_id"] for r in got} == set(brute_near(rows, 3, 85).values())


def sparse_family(seed, size, words=120):
    """Texts of one template whose similarities lie around the threshold."""
    rnd = random.Random(seed)
    rows = []
    for i in range(size):
        own = [f"t{k}" for k in range(words)]
        for _ in range(rnd.randrange(2, 8)):
            own[rnd.randrange(words)] = f"w{rnd.randrange(5000)}"
        rows.append((i, " ".join(own), "s"))
    return rows


def test_near_sparse_links(spark):
    """Links far apart in every sort order are found as well."""
    rows = sparse_family(7, 1000)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC), width=3, percent=85).collect()
    want = brute_near(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: want.get(d, d) for d, *_ in rows}


def test_near_borders(spark, monkeypatch):
    """Neither borders of stretches nor chunks of a list lose a link."""
    monkeypatch.setattr(near_dedup, "STRETCH_ROWS", 40)
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", 100)
    rows = sparse_family(8, 500)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC), width=3, percent=85).collect()
    want = brute_near(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: want.get(d, d) for d, *_ in rows}


def test_overlaps():
    rnd = np.random.default_rng(3)
    sets = [np.unique(np.r_[rnd.integers(0, 90, 60), rnd.integers(100, 9000, 80)]) for _ in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    of = np.array([0, 3, 4, 40, 69])
    got = near_dedup.overlaps(sets, of)
    assert [[x for j, x in enumerate(r) if i != j] for i, r in zip(of, got.tolist())] == [[x for j, x in enumerate(want[i]) if i != j] for i in of]


def test_near_wide_region_bridge(spark, monkeypatch):
    """A large group and rows around its threshold, cut into many chunks, by distributed components."""
    monkeypatch.setattr(near_dedup, "STRETCH_ROWS", 60)
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", 50)
    monkeypatch.setattr(near_dedup, "SHORT", 8)
    monkeypatch.setattr(near_dedup, "DENSE", 1)
    monkeypatch.setattr(components_module, "SMALL_LINKS", 3)
    rnd = random.Random(12)
    rows = sparse_family(9, 150)
    for i in range(200):  # near copies of one text
        own = [f"t{k}" for k in range(120)]
        own[rnd.randrange(120)] = f"y{i}"
        rows.append((1000 + i, " ".join(own), "s"))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC), width=3, percent=85).collect()
    want = brute_near(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: want.get(d, d) for d, *_ in rows}


def test_near_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(spark.createDataFrame([(1, None, "s")], DOC)).collect()[0]["component_id"] == 1


def brute_substrings(rows, size):
    order = sorted({(d, t or "") for d, t, *_ in rows if d is not None})
    seen, out = set(), {}
    for d, t in order:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out[d, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("packed", [10**6, 300])
def test_substrings(spark, monkeypatch, packed):
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "PACK_WORDS", packed)
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rnd.choices(vocabulary, k=n) for n in (19, 20, 21, 45, 90)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randrange(1, 4)):
            words += rnd.choices(vocabulary, k=rnd.randrange(0, 30)) + rnd.choice(shared)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "same " * 100, "s"), (103, "x same same " + "same " * 30, "s"), (None, rows[0][1], "s"), (104, rows[3][1], "copy"), (5, rows[5][1], "repeat"), (105, "é " * 19, "s"), (-3, rows[7][1], "negative")]
    docs = spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("clash")).repartition(4)
    got = substring_dedup.substring_dedup(docs).collect()
    want, texts = brute_substrings(rows, 20), defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(t or "")
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"], texts[r["doc_id"]][0]]


def test_substrings_empty(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOC)).count() == 0


def test_packing():
    rnd = np.random.default_rng(1)
    for hi in (2**20, 2**40):
        x = np.unique(rnd.integers(0, hi, 500, dtype=np.uint64))
        assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()
    assert len(substring_dedup.unpack(substring_dedup.pack(np.zeros(0, np.uint64)))) == 0


def test_word_hashes():
    texts = ["a b  ab", "", " a\tb\nab ", "ab a b é x"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    w = Words(np.frombuffer(data, np.uint8), offs)
    assert w.count.tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [x for t in texts for x in WORD.findall(t)]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))
    for k in range(1, 12):
        runs = runs_of(w.hash, k)
        assert len(runs) == max(0, len(flat) - k + 1)
        assert len(set(runs.tolist())) == len({tuple(flat[i : i + k]) for i in range(len(runs))})


def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in ok if i != q and len(x) == len(v))
            out[q] = d[:k]
    return out


def test_ann(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "PACK", 4)
    rnd = np.random.default_rng(0)
    centers = rnd.standard_normal((8, 16))
    rows = [(i, (centers[i % 8] + 0.4 * rnd.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(40)]  # ties
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [1.0]), (3100, [2.0]), (None, rows[0][1]), (3005, [float("inf")] + [0.0] * 15), (3200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"], r["rank"]))
    want, hit, total = brute_nearest(rows), 0, 0
    assert set(got) == {q for q, v in want.items() if v}
    for q, found in got.items():
        assert [x[2] for x in found] == list(range(1, len(want[q]) + 1)) and found == sorted(found)
        hit += len({x[1] for x in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert hit / total >= 0.9
    assert [x[1] for x in got[100]] == [i for _, i in want[100]]  # the smallest ids of the ties
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_chi_square():
    assert ann.chi_square_quantile(10, 0.95) == pytest.approx(18.307, abs=1e-3)
    assert ann.chi_square_quantile(2, 0.5) == pytest.approx(1.3863, abs=1e-3)


def test_pipeline(spark, tmp_path):
    rnd = random.Random(2)
    en, fr = [f"the{i} of and" for i in range(60)], [f"le{i} que des" for i in range(60)]
    rows = []
    for i in range(120):
        words = rnd.choices(en if i % 2 else fr, k=40)
        rows.append((i, "a line that very many of the documents share\n" + " ".join(words), "en" if i % 2 else "fr", f"s{i % 3}", 10))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 10) for i in range(10)] + [(300, "12345 !!", "en", "s0", 8), (301, None, "fr", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mix", "bpe"]
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "line_dedup":
            assert docs.where(F.col("text").contains("very many")).count() == 1
        if name == "near_dedup":
            assert {r["doc_id"] for r in docs.collect()} == set(range(120))
    assert counts[:3] == [130, 130, 120] and counts[3] == counts[4]
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "n_tokens"} <= set(done.columns) and done.count() == counts[4]


def test_pipeline_decodes(spark):
    docs = spark.createDataFrame([(1, "some  text\n é東"), (2, ""), (3, None)], "doc_id long, text string")
    assert all(r["round_trip"] for r in corpus_pipeline.tokens(spark, docs, "").collect())


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
