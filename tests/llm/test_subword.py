"""Memory and order of the quality classifier's fitting."""

import tracemalloc
import zlib

import numpy as np

from tracemesh.llm import subword


def test_memory_of_training(monkeypatch):
    """The features of all documents are held in few bytes each, with no text beside them."""
    monkeypatch.setattr(subword, "STEPS", 0)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.integers(0, 1 << 40, 1000).astype(str)) for _ in range(200)]
    n = sum(len(np.unique(subword.features(t))) for t in texts)
    tracemalloc.start()
    subword.train(texts, [k % 2 for k in range(len(texts))], epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * n + (14 << 20)  # the vectors and the features of one text are the constant


def test_bags():
    texts = ["b c b", "", "a " * 70_000, "b " * 300]
    bags = subword.Bags()
    bags.add(texts)
    assert bags.sort([9, -1, 3, 1 << 40]).tolist() == [1, 2, 0, 3]
    for k, d in enumerate([1, 2, 0, 3]):
        ids, counts = np.unique(subword.features(texts[d]), return_counts=True)
        assert np.array_equal(bags[k][0], ids) and np.array_equal(bags[k][1], counts)


def test_fitted_in_order_of_ids(spark):
    """The model is that of the texts by id, however the rows are dealt."""
    texts = {i: f"w{i} " + ("good words here" if i % 2 else "bad ones") * (i % 5) for i in range(-5, 400, 7)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, quality int")
    mine = sorted(i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1)
    plain = subword.train([texts[i] for i in mine], [i % 2 for i in mine])
    fitted = subword.fit_quality(docs, labels)
    assert np.array_equal(fitted.weights, plain.weights) and fitted.bias == plain.bias
