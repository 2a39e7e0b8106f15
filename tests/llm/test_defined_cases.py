"""Cases that every operator and stage defines: nulls, empty tables, hot groups, long texts, clashing names."""

import ctypes
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotlog.llm import ann, bpe_codec, language_id, line_dedup, near_dedup, quality, secret_scan, source_mix, substring_dedup, token_counts

DOC = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 7919}" for i in range(60_000))
ROWS = [
    (1, "the cat and the dog of this house", "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, "the cat and the dog of this house", "en", "a"), (None, "le chat et la maison", "fr", None),
    (5, LONG, "en", "a"), (5, "same id, other text", "en", "a"), (6, "x", None, "b"), (6, "x", None, "b"), (7, "\x00\ufeff\u2028 \U0001f600 e\u0301", "fr", ""), (8, "\n\n\n", "fr", "a"),
]

#: Each operator as a function of documents that gives a row for each of them.
ROW_WISE = {
    "line_dedup": lambda d: line_dedup.line_dedup(d),
    "source_mix": lambda d: source_mix.mix(d),
    "quality": lambda d: quality.quality(d, None),
    "language_id": lambda d: language_id.predict(d, *language_id.fit(d)),
    "near_dedup": lambda d: near_dedup.near_duplicates(d),
    "substring_dedup": lambda d: substring_dedup.substring_dedup(d),
    "bpe_codec": lambda d: bpe_codec.decode(bpe_codec.encode(d)),
    "token_counts": lambda d: token_counts.token_counts(d),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_rows_of_all_kinds(spark, name):
    """Nulls, empty and long texts, repeated rows, shared ids: one row each; clashing columns do no harm."""
    docs = spark.createDataFrame(ROWS, DOC).repartition(3)
    want = Counter(r[0] for r in ROWS)
    got = ROW_WISE[name](docs)
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == want
    clash = docs.select("doc_id", "text", "lang", *[F.lit("c").alias(c) for c in ("mark", "id", "pos", "size", "kept", "n_words", "n_lines", "score", "lang_pred", "ids", "decoded", "n_tokens", "n_bytes", "number", "start", "row", "doc", "key", "n", "left", "split", "gone", "h1", "component", "copies", "target", "p_good", "base_failed")], "source")
    assert Counter(r["doc_id"] for r in ROW_WISE[name](clash).select("doc_id").collect()) == want
    assert ROW_WISE[name](docs.limit(0)).count() == 0


def test_secret_scan_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOC).withColumns({c: F.lit("c") for c in ("spans", "_id", "kind", "start")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(r["doc_id"] for r in secret_scan.op8_secret_scan(spark, str(tmp_path)).collect()) == Counter(r[0] for r in ROWS)


def test_ann_cases(spark):
    """Ties go to the smaller id; nulls, zeros and odd numbers take no part; a third of all rows may be one vector."""
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=8).tolist(), "c") for i in range(60)] + [(100 + i, [1.0] * 8, "c") for i in range(40)]
    rows += [(900, None, "c"), (901, [0.0] * 8, "c"), (902, [float("nan")] * 8, "c"), (903, [None] * 8, "c"), (None, [1.0] * 8, "c"), (904, [1.0, 2.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(df, df.where("vec_id IN (100, 900, 901, 902, 903, 904)")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {100: [(i, 0.0) for i in range(101, 111)]}


def test_hot_line(spark):
    """A line that a third of all documents hold, and a long document with many of them."""
    hot = "this line stands in a third of all documents, and more"
    rows = [(i, f"own {i}\n{hot}\nmore {i}" if i % 3 == 0 else f"own {i}", "en", "a") for i in range(600)]
    rows.append((700, "\n".join([hot, "kept"] * 20_000), "en", "a"))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i]["n_dropped"] == (i % 3 == 0) and hot not in got[i]["kept"] for i in range(600))
    assert got[700]["n_dropped"] == 0 and got[700]["n_lines"] == 40_000


@pytest.mark.parametrize("packed", [1_500_000, 200])
def test_hot_passage(spark, monkeypatch, packed):
    """A passage that a third of all documents share stays in the first of them only, whatever the packs."""
    monkeypatch.setattr(substring_dedup, "PACK_WORDS", packed)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 500)
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    own = lambda i: [f"o{i}x{k}" for k in range(rnd.randrange(5, 40))]
    rows = [(i, " ".join(own(i) + (passage if i % 3 == 1 else []) + own(-i - 1)), "en", "a") for i in range(300)]
    for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOC).repartition(5)).collect():
        assert r["n_removed"] == (60 if r["doc_id"] % 3 == 1 and r["doc_id"] != 1 else 0)


def test_hot_text(spark):
    """A third of all rows with one text, and as many with a near copy of it, are one component."""
    words = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(words) if i % 3 == 0 else " ".join([*words[:50], f"z{i}", *words[51:]]) if i % 3 == 1 else f"own text number {i} of its own kind {i * i}", "en", "a") for i in range(600)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOC), width=3, percent=85).collect()}
    assert got == {i: 0 if i % 3 < 2 else i for i in range(600)}


def test_pipeline_stages(spark, tmp_path):
    """Each stage on documents of all kinds, on none, and with columns of the names it uses itself."""
    extra = ("language_id_score", "line_kept", "line_n_dropped", "bpe_decoded", "same", "copies", "rows", "mark")
    docs = spark.createDataFrame(ROWS, DOC).withColumns({c: F.lit(c) for c in extra})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.where(" AND ".join(f"{c} = '{c}'" for c in extra)).count() == out.count() > 0, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert coded.where("NOT round_trip").count() == 0 and coded.count() == len(ROWS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r[0] for r in ROWS}
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_workers_give_memory_back(spark):
    """After a task of the pipeline's first stage its Python worker keeps the model, but no memory that is free."""

    def held(batches):
        anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read()).group(1)) // 1024
        for batch in batches:
            time.sleep(0.2)  # so that tasks run beside each other, one a worker
            before = anonymous()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            yield pa.RecordBatch.from_arrays([pa.array([before - anonymous()], pa.int64())], ["mb"])

    free = lambda: max(r["mb"] for r in spark.range(0, 16, 1, 16).mapInArrow(held, "mb long").collect())
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 12))) for _ in range(60_000)]
    docs = spark.createDataFrame([(k, " ".join(draw.choices(words, k=300)), "en" if k % 2 else "fr", "a") for k in range(12_000)], DOC).repartition(2)
    free()
    assert language_id.keep_known(docs, docs.limit(50)).count() == 12_000
    assert free() < 12
