import zlib

import numpy as np
import pyarrow as pa

from palimpsest.llm import toxicity


def test_every_text_counts(spark):
    rare = [f"rare{chr(97 + k)}word" for k in range(20)]
    learnt = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 5][:9000]
    texts = [f"plain {rare[k % 20]}" if k < 100 else "plain text" for k in range(9000)]
    docs = spark.createDataFrame([*zip(learnt, texts, strict=True), *((i, "plain other") for i in range(12_000, 25_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in learnt], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, 0.1)
    assert all(np.isin(next(toxicity.features([w]))[1], model.keys).all() for w in rare)


def risk_of(totals, n, prior):
    def risk(w):
        p, u = (row / row[0] for row in totals(w))
        return prior * p[1] + max(0, u[2] - prior * p[2]) + toxicity.DECAY / 2 * w[:n] @ w[:n]

    return risk


def test_fit_has_the_least_risk():
    r = np.random.default_rng(5)
    for prior, n, share in ((0.1, 6, 0.1), (0.4, 6, 0.0), (0.3, 40, 0.02)):
        rows = [(k < 300, (r.random(n) < (0.5 if k < 300 or r.random() < share else 0.1)).nonzero()[0]) for k in range(900)]
        batch = pa.RecordBatch.from_pydict({"positive": [p for p, _ in rows], "at": [x.astype("<u2").tobytes() for _, x in rows], "n": [1 + k % 3 for k in range(900)]})
        totals = lambda w: toxicity.sums([batch], w)  # noqa: B023, E731
        weights, bias = toxicity.fit_nnpu(totals, n, prior)
        best, risk = np.append(weights, bias), risk_of(totals, n, prior)
        for size in (0.3, 0.1, 0.03):
            for _ in range(60):
                assert risk(best) <= risk(best + size * r.standard_normal(n + 1)) + 5 * toxicity.BEND


def test_pairs_are_distinct_across_pieces(monkeypatch):
    long = "alpha beta " * 100
    want = {(i, k) for i, t in enumerate([long, "", "beta"]) for _, x in toxicity.features([t]) for k in x.tolist()}
    monkeypatch.setattr(toxicity, "PAIRS", 8)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 64)
    who, keys = toxicity.distinct_pairs([long, "", "beta"])
    assert list(zip(who.tolist(), keys.tolist(), strict=True)) == sorted(want)
