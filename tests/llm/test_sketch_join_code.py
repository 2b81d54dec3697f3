import random
import re

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import sketch_dedup


def test_the_join_of_the_last_pairs_is_compiled(spark, monkeypatch):
    """Java interprets methods of over 8,000 bytes; the join's own was of 14,828."""
    rnd, sizes, kept = random.Random(5), [], sketch_dedup.saved
    base = [f"w{rnd.randint(0, 900)}" for _ in range(60)]
    texts = [" ".join(base[: 40 + k % 20] + [f"v{k}_{j}" for j in range(k % 9)]) for k in range(60)]

    def saved(df):
        if df.columns == ["a", "b"]:
            code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code)))
        return kept(df)

    monkeypatch.setattr(sketch_dedup, "saved", saved)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the run
    try:
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        assert sketch_dedup.near_duplicates(docs).count() == len(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_bits_allow_what_single_bits_leave(spark):
    """The bound is the size less the bits that only one sketch has, on either side."""
    draw, kept, pairs = np.random.default_rng(3), sketch_dedup.KEPT, []
    for _ in range(80):
        n, m, common = (int(x) for x in (draw.integers(150, 400), draw.integers(150, 400), draw.integers(0, 150)))
        pool = draw.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = pool[:n][:kept], np.concatenate([pool[:common], pool[n:]])[:m][:kept]
        pairs.append((n, m, *[sketch_dedup.bits_of(x).tolist() for x in (a, b)]))
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, n1 int, n2 int, x array<long>, y array<long>")
    side = lambda c, n, e: rows.select("k", F.col(n).alias("n"), F.col(c).alias("bits")).select("k", "n", *sketch_dedup.bit_columns()).select("k", *[F.col(d).alias(d + e) for d in ("n", "spare", *[f"bits{i}_" for i in range(16)])])
    got = side("x", "n1", "").join(side("y", "n2", "2"), "k").select("k", sketch_dedup.needed("", "2", 85).alias("needed"), sketch_dedup.bits_allow("", "2", 85).alias("may")).collect()
    assert len(got) == len(pairs)
    for r in got:
        n, m, a, b = pairs[r["k"]]
        lacks = lambda x, y: sum((p & ~q & (1 << 64) - 1).bit_count() for p, q in zip(x, y))
        assert r["may"] == (min(min(n, kept) - lacks(a, b), min(m, kept) - lacks(b, a)) >= r["needed"])
