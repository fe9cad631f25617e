"""Language mixtures against plain expectation-maximisation over all sets, sharding against plain Python row by row."""

import math
import struct
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from daypanel.llm import language, shards
from daypanel.sources.tables import load

# 5: language


def plain_em(cells, logs, chosen, steps=400):
    """Proportions and log likelihood of a set of languages, n-gram by n-gram."""
    theta = [1 / len(chosen)] * len(chosen)
    probs = [[math.exp(logs[j][c]) for j in chosen] for c in cells]
    for _ in range(steps if len(chosen) > 1 else 0):
        sums = [0.0] * len(chosen)
        for p in probs:
            whole = sum(t * x for t, x in zip(theta, p, strict=True))
            for k, (t, x) in enumerate(zip(theta, p, strict=True)):
                sums[k] += t * x / whole
        theta = [s / len(cells) for s in sums]
    return theta, sum(math.log(sum(t * x for t, x in zip(theta, p, strict=True))) for p in probs)


def test_mixtures_equal_plain_em_over_all_sets(spark, medium):
    docs = load(spark, medium, "documents").filter("lang IS NOT NULL AND length(text) > 400")
    model = language.fit(docs)
    names, logs = model["languages"], model["logs"]
    by = {}
    for r in docs.orderBy("doc_id").limit(400).collect():
        by.setdefault(r["lang"], r["text"])
    one, two, three = (by[k] for k in sorted(by)[:3])
    texts = [one[:60], one[:300], one[:200] + " " + two[:200], one[:250] + " " + two[:80], two[:120] + " " + three[:120], "a", "", None]
    found = language.mixtures(pa.array(texts, pa.string()), logs)
    for text, shares in zip(texts, found, strict=True):
        _, cells, n = language._counted(pa.array([text], pa.string()))
        drawn = np.repeat(cells, n).tolist()
        if not drawn:
            assert shares.sum() == 0
            continue
        price = 2.0 * 0.5 * math.log(max(len(drawn), 2))
        every = {}
        for size in (1, 2, 3):
            for chosen in combinations(range(len(names)), size):
                theta, value = plain_em(drawn, logs, chosen)
                every[chosen] = (value - (size - 1) * price, theta)
        picked = tuple(np.flatnonzero(shares).tolist())
        best = max(v for v, _ in every.values())
        # Twelve steps stand for the limit; sets within half a unit of log likelihood are as good.
        assert every[picked][0] >= best - 0.5, (text, picked)
        assert shares[list(picked)] == pytest.approx(every[picked][1], abs=0.05)


# 9: sharding


def spark_hash(*values, seed=42):
    """xxhash64 of a row as Spark chains it: longs by eight bytes, ints by four, strings by theirs; null changes nothing."""
    for value in values:
        if value is not None:
            kind, v = value
            data = struct.pack("<q" if kind == "long" else "<i", v) if kind != "string" else v.encode()
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_numbers(rows, buckets):
    """Rows in order of their bucket and then of their columns, nulls first."""
    def bucket(r):
        return spark_hash(None if r[0] is None else ("long", r[0]), None if r[1] is None else ("string", r[1])) % buckets

    return sorted(rows, key=lambda r: (bucket(r), r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def plain_network(x, rows, seed):
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    b = max(1, -(-rows // a))
    u, v = x % a, x // a
    for j in range(1, shards.ROUNDS + 1):
        f = spark_hash(("int", seed), ("int", j), ("long", v if j % 2 else u))
        if j % 2:
            u = (u + f % a) % a
        else:
            v = (v + f % b) % b
    return v * a + u


def plain_place(x, rows, seed):
    x = plain_network(x, rows, seed)
    while x >= rows:
        x = plain_network(x, rows, seed)
    return x


@pytest.mark.parametrize(("n", "seed", "buckets"), [(1, 0, 4096), (7, 3, 4), (97, 0, 16), (500, 12, 4096)])
def test_sharding_equals_plain_python_row_by_row(spark, n, seed, buckets):
    rows = [(None if i % 11 == 5 else i % 83, None if i % 7 == 3 else f"é{i % 19}") for i in range(n)]
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    got = sorted((r["row_number"], r["key"], r["text"], r["shard"], r["slot"]) for r in shards.shard_rows(df, 5, seed, buckets).collect())
    want = []
    for number, (key, text) in enumerate(plain_numbers(rows, buckets)):
        place = plain_place(number, n, seed)
        want.append((number, key, text, place % 5, place // 5))
    assert got == want
    back = spark.range(n).select("id", shards.permute(shards.permute(F.col("id"), n, seed), n, seed, back=True).alias("b"))
    assert all(r["id"] == r["b"] for r in back.collect())
