import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.llm import language_id as li


def test_tables_equal_the_plain_network():
    rng = np.random.default_rng(1)
    x = rng.integers(0, li.SYMBOLS, (300, li.WINDOW))
    y = x[:, 0] % 3
    net = li.train(x, y, ["a", "b", "c"], epochs=1)
    plain, _ = li._features(net, x)
    want = li._softmax(plain @ net.out + net.out_bias)
    assert np.allclose(li.Scorer(net).windows(x), want, atol=1e-4)
    again = li.train(x, y, ["a", "b", "c"], epochs=1)
    assert (again.out == net.out).all()


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, li.SYMBOLS, (64, 20)), rng.integers(0, 2, 64)
    loss = lambda net: -np.log(li._softmax(li._features(net, x)[0] @ net.out + net.out_bias)[np.arange(64), y]).mean()
    before = li.train(x, y, ["a", "b"], epochs=0)
    after = li.train(x, y, ["a", "b"], epochs=40)
    assert loss(after) < 0.5 * loss(before)


def test_windows_cover_whole_texts():
    texts = pa.array(["", "ab", "x" * 96, "y" * 97, "É" * 100])
    x, counts = li.cut(texts)
    assert counts.tolist() == [1, 1, 1, 2, 3] and x.shape == (8, li.WINDOW)
    assert (x[2] == ord("x") - 96).all() and x[4][0] == ord("y") - 96 and (x[4][1:] == 0).all()
    assert len(li.cut(pa.array([], pa.string()))[1]) == 0


def test_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = docs.withColumn("held_out", held)
    net = li.learn(docs, "doc_id", "text", "lang", ~held, sample_rows=800)
    got = li.predict(docs, "doc_id", "text", net, ("held_out", "lang")).filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "12 !? 34", "s"), (4, "the " * 50_000, "s"), (4, "the " * 50_000, "s"), (None, "und die der", "s")], "doc_id long, text string, score string")
    rows = li.predict(odd, "doc_id", "text", net).collect()
    assert sorted((r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)) == [("und", 0.0)] * 3
    assert len(rows) == 6 and all(r.lang_pred in net.languages and 0 <= r.score <= 1 for r in rows if r.doc_id not in (1, 2, 3))
    assert li.predict(odd.limit(0), "doc_id", "text", net).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net = li.learn(df, "doc_id", "text", "lang", F.lit(True))
    assert net is None and li.predict(df, "doc_id", "text", net).first().lang_pred == "und"
