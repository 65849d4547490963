"""A key holding most rows is cut over many range partitions and stays exact."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orderpulse.operators.ordered_fold import brute_force_fold, ordered_fold
from orderpulse.operators.ratelimit import RateFold
from orderpulse.operators.reserve import StockFold


def _skewed(n=20000, hot_share=0.6, seed=7):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < hot_share
    keys = np.where(hot, "hot", "k" + rng.integers(0, 50, n).astype(str))
    return pd.DataFrame({"k": keys, "seq": np.arange(n), "quantity": rng.integers(1, 4, n),
                         "req_ms": np.sort(rng.integers(0, 5_000_000, n))})


def test_hot_key_spans_many_partitions_and_results_match(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf, "k string, seq long, quantity int, req_ms long")
    parts = df.repartitionByRange(16, "k", "seq").select("k", F.spark_partition_id().alias("p"))
    spread = parts.filter("k = 'hot'").select("p").distinct().count()
    assert spread >= 6   # the hot key is not one task
    for fold, order, cols in ((StockFold(1000), ["seq"], ["status", "remaining"]),
                              (RateFold("req_ms", 60000), ["req_ms", "seq"], ["window_start", "request_count"])):
        got = ordered_fold(df, "k", order, fold, 16).toPandas().sort_values("seq").reset_index(drop=True)
        want = brute_force_fold(pdf, "k", order, fold).sort_values("seq").reset_index(drop=True)
        for c in cols:
            assert (got[c].astype(str).to_numpy() == want[c].astype(str).to_numpy()).all(), c
