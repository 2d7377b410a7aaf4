"""What op10 holds on the driver and sends: places and counts of the examples' terms, no hash or weight of each."""

from __future__ import annotations

import pickle

import numpy as np

from itemscope.llm import toxicity


def test_index_is_sent_without_weights(monkeypatch):
    rng = np.random.default_rng(0)
    ids, n_terms = np.arange(200), 4000
    at = [np.sort(rng.choice(n_terms, rng.integers(1, 900), replace=False)).astype(np.int32) for _ in ids]
    tf = [rng.integers(1, 70_000, len(a)).astype(np.int32) for a in at]
    idf = rng.random(n_terms) + 1
    index = toxicity.Index.of_examples(ids, np.array([len(a) for a in at]), np.concatenate(at), np.concatenate(tf),
                                       np.arange(n_terms), idf, dict.fromkeys(ids.tolist(), 0), 0.5)
    pairs = len(index.at)
    data = pickle.dumps(index, pickle.HIGHEST_PROTOCOL)
    assert len(data) < 9 * pairs + 16 * n_terms + 64 * len(ids)    # 12 bytes a pair with weights
    monkeypatch.setattr(toxicity, "WEIGHED", 1000)
    index = pickle.loads(data)
    index._invert()
    for i, (a, t) in enumerate(zip(at, tf)):
        v = np.log1p(t) * idf[a]
        assert np.allclose(index.weight[index.off[i]:index.off[i + 1]], v / np.sqrt((v * v).sum()), rtol=1e-14, atol=0)
    want = index.vector(at[7], tf[7])
    places, sims = index.nearest(at[7], want, 3)
    assert places[0] == 7 and abs(sims[0] - 1) < 1e-12


def test_lists_are_made_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = {d: {int(t): float(v) for t, v in zip(rng.choice(300, n, replace=False), rng.random(n))}
               for d, n in enumerate(rng.integers(1, 40, 90))}
    vectors |= {d: v | {0: 0.5} for d, v in list(vectors.items())[::3]}    # a frequent term is a column
    for weighed in (7, 1 << 19):
        monkeypatch.setattr(toxicity, "WEIGHED", weighed)
        index = toxicity.Index(np.arange(300), np.ones(300), vectors, dict.fromkeys(vectors, 0), 0.5)
        index._invert()
        assert index.column[0] >= 0 and index.example.dtype == np.int32
        for t in range(300):
            want = {d: np.float32(v[t]) for d, v in vectors.items() if t in v}
            if index.column[t] >= 0:
                row = index.columns[index.column[t]]
                assert {int(d): row[d] for d in np.flatnonzero(row)} == want
                assert index.start[t] == index.start[t + 1]
            else:
                own = slice(index.start[t], index.start[t + 1])
                assert list(zip(index.example[own].tolist(), index.light[own])) == sorted(want.items())


def test_helpers_are_released(spark, monkeypatch):
    from pyspark import Broadcast
    freed = []
    real = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: freed.append(len(self.value)) or real(self, *a))
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 8 and freed == [4, 5]    # the ids of the examples, then their terms
