"""Order requests and the orders table: validation (P2), constraint checks
(P3), finders (P4-P6), order placement into orders + outbox (S5), the list
line (P21) and the catalog join (J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_base64
from ..sources.topics import order_record


def blank(c: Column) -> Column:
    """null, empty or whitespace only (Java's isBlank)."""
    return c.isNull() | ~c.rlike(r"\S")


def failed_rules(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules whose *violation* predicate holds, as an array."""
    arr = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return F.filter(arr, lambda x: x.isNotNull())


# Rule names follow the request fields of the reference's order request.
def order_rules() -> list[tuple[str, Column]]:
    return [
        ("tenant_id_blank", blank(F.col("tenant_id"))),
        ("customer_id_blank", blank(F.col("customer_id"))),
        ("product_id_blank", blank(F.col("product_id"))),
        ("currency_blank", blank(F.col("currency"))),
        ("quantity_not_positive", F.coalesce(F.col("quantity") <= 0, F.lit(True))),
        ("amount_not_positive", F.coalesce(F.col("amount") <= 0, F.lit(True))),
    ]


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``failed`` (comma list of broken rules) and ``valid``."""
    fr = failed_rules(rules)
    return df.withColumn("_failed", fr).select(
        "*", (F.size("_failed") == 0).alias("valid"),
        F.concat_ws(",", "_failed").alias("failed")).drop("_failed")


def validate_orders(requests: DataFrame) -> DataFrame:
    return validate(requests, order_rules())


def constraint_violations(orders: DataFrame, key: str = "order_id") -> DataFrame:
    """CHECK / NOT NULL / length / duplicate-key violations per row.

    Duplicate keys are found with a partial (map-side combined) count per key
    joined back on the key; AQE splits a hot key on the join's big side.
    """
    rules = [
        ("quantity_check", F.coalesce(F.col("quantity") <= 0, F.lit(False))),
        ("amount_check", F.coalesce(F.col("amount") <= 0, F.lit(False))),
        ("tenant_not_null", F.col("tenant_id").isNull()),
        ("product_not_null", F.col("product_id").isNull()),
        ("currency_length", F.coalesce(F.length("currency") > 3, F.lit(False))),
    ]
    dup = orders.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    j = orders.join(dup, key, "left")
    rules.append(("duplicate_key", F.col("_copies") > 1))
    fr = failed_rules(rules)
    return (j.withColumn("_failed", fr)
             .filter(F.size("_failed") > 0)
             .select(key, F.concat_ws(",", "_failed").alias("violations")))


def orders_by_customer(orders: DataFrame, customer_id: str) -> DataFrame:
    """One customer's orders, newest first."""
    return orders.filter(F.col("customer_id") == customer_id).orderBy(F.col("placed_at").desc(),
                                                                       F.col("order_id").desc())


def orders_by_tenant_customer(orders: DataFrame, tenant_id: str, customer_id: str) -> DataFrame:
    """P5: as P4 within one tenant."""
    return orders_by_customer(orders.filter(F.col("tenant_id") == tenant_id), customer_id)


def order_lookup(lookups: DataFrame, orders: DataFrame) -> DataFrame:
    """P6 in bulk: not_found / forbidden / ok; a lookup without caller is not checked."""
    o = orders.select("order_id", F.col("customer_id").alias("_owner"))
    j = lookups.join(o, "order_id", "left")
    outcome = (F.when(F.col("_owner").isNull(), F.lit("not_found"))
                .when(F.col("caller").isNotNull() & (F.col("caller") != F.col("_owner")),
                      F.lit("forbidden"))
                .otherwise(F.lit("ok")))
    return j.select("lookup_id", "order_id", "caller", outcome.alias("outcome"))


def place_orders(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests -> (orders rows, outbox rows), both from one input.

    Both outputs are projections of the same validated input, so a
    ``foreachBatch`` writer can commit them together under one batch id.
    """
    ok = validate_orders(requests).filter("valid")
    orders = ok.select("order_id", "tenant_id", "customer_id", "product_id", "quantity", "amount",
                       "currency", F.lit("PLACED").alias("status"),
                       F.col("placed_at").alias("created_at"))
    outbox = ok.select(F.concat(F.lit("ob-"), F.col("order_id")).alias("id"),
                       F.lit("Order").alias("aggregate_type"),
                       F.col("order_id").alias("aggregate_id"),
                       F.lit("orders.placed").alias("topic"),
                       F.lit("OrderPlaced").alias("event_type"),
                       to_base64(order_record()).alias("payload"),
                       F.col("placed_at").alias("created_at"), "tenant_id")
    return orders, outbox


def order_lines_display(orders: DataFrame) -> DataFrame:
    """Short id (8 characters) and the amount with two digits and currency."""
    return orders.select("order_id", F.substring("order_id", 1, 8).alias("short_id"),
                         F.format_string("%.2f %s", F.col("amount").cast("double"),
                                         F.col("currency")).alias("amount_text"))


# Fixed value: the order form warns above this total.
TOTAL_WARN = 1000


def order_totals(orders: DataFrame, catalog: DataFrame) -> DataFrame:
    """Price x quantity per order and a warning flag above 1000.

    The catalog is a dimension table; the planner broadcasts it when its
    measured size is under the broadcast threshold and shuffles otherwise.
    """
    j = orders.join(catalog, "product_id", "inner")
    total = F.col("price") * F.col("quantity")
    return j.select("order_id", "product_id", "quantity", "price", total.alias("total"),
                    (total > TOTAL_WARN).alias("warn"))


def table_violations(df: DataFrame, id_col: str, rules: list[tuple[str, Column]],
                     unique_cols: tuple[str, ...] = ()) -> DataFrame:
    """P3 for any table: rows breaking a rule or sharing a unique column's value.

    Each uniqueness check is a partial (map-side combined) count per value
    joined back on the value, so many copies of one value never meet in one
    task before the combine.
    """
    j = df
    all_rules = list(rules)
    for c in unique_cols:
        cnt = df.groupBy(c).agg(F.count(F.lit(1)).alias(f"_n_{c}"))
        j = j.join(cnt, c, "left")
        all_rules.append((f"duplicate_{c}", F.coalesce(F.col(f"_n_{c}") > 1, F.lit(False))))
    fr = failed_rules(all_rules)
    return (j.withColumn("_failed", fr).filter(F.size("_failed") > 0)
             .select(id_col, F.concat_ws(",", "_failed").alias("violations")))
