import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factlake.llm import quality
from factlake.llm.quality import FEATURES, Model, boost, features
from tests.llm.data import EDGES, documents, prose

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def named(text):
    return dict(zip(FEATURES, features(pa.array([text], pa.binary()))[0].tolist()))


def test_features():
    got = named(b"One two. TWO two two!\nx9 \xc3\xa9\xc3\xa9\n\nOne two. TWO two two!")
    assert got["log_words"] == np.log1p(12) and got["different_words"] == 7 / 12 and got["top_word"] == 2 / 12
    assert got["word_length"] == (3 + 4 + 3 + 3 + 4 + 2 + 2 + 3 + 4 + 3 + 3 + 4) / 12
    assert got["log_lines"] == np.log1p(3) and got["seen_lines"] == 1 - 2 / 3 and got["ended_lines"] == 2 / 3
    assert got["shouted_words"] == 2 / 12 and got["sentence_words"] == 12 / 4 and got["line_words"] == 4
    assert got["short_words"] == 2 / 12 and got["seen_pairs"] == 1 - 7 / 11
    assert abs(named(b"ab" * 50)["byte_entropy"] - 1) < 1e-12


def test_a_text_has_its_features_wherever_it_stands():
    texts = [None, b"", b" \n\t", prose(1, 500).encode(), b"word", b"x" * 100_000, prose(2, 90).encode(), "Ünï 汉字 \U0001f600".encode()]
    both = features(pa.array(texts, pa.binary()))
    for text, row in zip(texts, both):
        assert (features(pa.array([text], pa.binary()))[0] == row).all() and np.isfinite(row).all()


def test_boosting_learns_single_features_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = boost(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    alone = Model(model.base, model.edges, model.tables, model.coarse, [], [])
    assert ((alone.score(x[2000:]) >= 0.5) == y[2000:]).mean() < 0.7
    y = (x[:, 2] > 0.3).astype(float)
    assert ((boost(x[:2000], y[:2000], pairs=0).score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.98


def test_held_out_accuracy_and_no_look_at_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    # labels of the held-out documents are turned round: the scores must not change
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(3), turned)
    assert one.base == two.base and all((a == b).all() for a, b in zip(one.tables, two.tables))
    other = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"))
    got = {r.doc_id: r for r in quality.score(other, two).collect()}
    truth = [(got[r.doc_id], r.quality) for r in labels.collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r, _ in truth)
    held = [(r.predicted == q) for r, q in truth if r.held_out]
    bad = [(r.predicted == q) for r, q in truth if r.held_out and q == 0]
    assert np.mean(held) >= 0.95 and np.mean(bad) >= 0.8


def test_edges(spark):
    docs = documents(spark, [*EDGES, *((100 + i, prose(i, 60)) for i in range(30)), *((200 + i, "$$$ ### " * (20 + i)) for i in range(30))])
    rows = [(100 + i, 1, 0) for i in range(30)] + [(200 + i, 0, 0) for i in range(30)] + [(100, 0, 0), (None, 1, 0), (7, None, 0), (5, 1, 1), (5, 1, 1), (9, 7, 0)]
    labels = spark.createDataFrame(rows, LABELS)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(EDGES) + 60
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {next(r.score for r in got if r.doc_id == 1)}
    assert all(r.predicted == (r.doc_id < 200) for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert sum(r.doc_id is None and r.held_out for r in got) == 2
    # nothing to learn, one kind only, no documents
    none = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in quality.score(docs, quality.fit(docs, none)).collect()} == {(0.5, 1)}
    bad = quality.fit(docs, labels.filter("quality = 0 AND doc_id > 100"))
    assert {r.predicted for r in quality.score(docs, bad).collect()} == {0}
    empty = documents(spark, [])
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
