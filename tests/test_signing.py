"""HMAC-SHA256 from built-in expressions equals the standard library."""
import hashlib
import hmac

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderpulse.functions.hmac import hmac_sha256, signature_header
from orderpulse.operators import saga as sg
from orderpulse.operators import webhooks as wh
from orderpulse.sources import tables as tb
from conftest import SF001


def _py(secret, payload):
    return hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()


def test_known_vector(spark):
    df = spark.createDataFrame([("secret", "hello")], "s string, p string")
    r = df.select(hmac_sha256(F.col("s"), F.col("p")).alias("h"),
                  signature_header(F.col("s"), F.col("p")).alias("sig")).first()
    assert r.h == "88aab3ede8d3adf94d26ab90d3bafd4a2083070c3bcce9c014ee04a443847c0b"
    assert r.sig == "sha256=" + r.h


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(min_size=0, max_size=90), st.text(max_size=300)), min_size=1, max_size=20))
def test_matches_stdlib_for_any_key_length(spark, pairs):
    df = spark.createDataFrame(pairs, "s string, p string")
    got = [r.h for r in df.select(hmac_sha256(F.col("s"), F.col("p")).alias("h")).collect()]
    assert got == [_py(s, p) for s, p in pairs]


def test_secrets_and_payloads_matter(spark):
    df = spark.createDataFrame([("a-secret", "x"), ("b-secret", "x"), ("a-secret", "y")], "s string, p string")
    hs = [r.h for r in df.select(hmac_sha256(F.col("s"), F.col("p")).alias("h")).collect()]
    assert len(set(hs)) == 3


def test_bulk_signing_job_matches_stdlib(spark):
    o = tb.orders_stream(spark, SF001)
    ev = wh.webhook_events(o, sg.payment_decision(o), sg.saga(o))
    eps = tb.endpoints(spark, SF001)
    fan = wh.webhook_fanout(ev, eps)
    signed = wh.sign_payloads(fan, eps).join(fan.select("delivery_id", "payload"), "delivery_id")
    signed = signed.join(eps.select(F.col("id").alias("endpoint_id"), "secret"), "endpoint_id")
    rows = signed.collect()
    assert rows
    for r in rows:
        assert r.signature == "sha256=" + _py(r.secret, r.payload)
