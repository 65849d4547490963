"""Stock reservation per product in arrival order.

Rule (inventory service): every product starts with ``initial_stock`` units.
An order is RESERVED when the current stock covers its quantity, and the
stock drops by the quantity; otherwise it is OUT_OF_STOCK and the stock is
unchanged, so a later, smaller order may still pass.  Declined payments do
not return stock.

The fold is exact and vectorised: while stock lasts, a run of orders whose
running quantity fits is reserved in one ``cumsum``/``searchsorted``; after a
refusal the next order that fits is found by a vectorised scan.  Every
reservation lowers the stock by at least one unit, so a key segment costs at
most ``initial_stock`` jumps plus a linear scan, however many rows it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered_fold import KeyFold, ordered_fold

# Fixed value: stock a product starts with before any reservation.
DEFAULT_STOCK = 100
RESERVED, OUT_OF_STOCK = "RESERVED", "OUT_OF_STOCK"
_BLOCK = 4096
_NEVER_FITS = 1 << 40  # an order without a quantity is refused


def _quantities(seg: dict, col: str) -> np.ndarray:
    q = np.asarray(seg[col])
    if q.dtype == object or q.dtype.kind == "f":
        q = np.array([_NEVER_FITS if v is None or v != v else int(v) for v in q.tolist()])
    return q.astype(np.int64)


def _next_fitting(q: np.ndarray, i: int, limit: int) -> int:
    """First index >= i with q <= limit, or len(q)."""
    n = len(q)
    while i < n:
        hit = np.flatnonzero(q[i:i + _BLOCK] <= limit)
        if len(hit):
            return i + int(hit[0])
        i += _BLOCK
    return n


def reserve_scan(q: np.ndarray, stock: int) -> tuple[np.ndarray, int]:
    """Reserve along ``q`` starting from ``stock``; returns (reserved mask, stock left)."""
    n = len(q)
    taken = np.zeros(n, dtype=bool)
    if n == 0:
        return taken, stock
    if (q <= 0).any():  # not valid orders (P2 rejects them); keep the plain rule
        for i in range(n):
            if stock >= q[i]:
                taken[i] = True
                stock -= int(q[i])
        return taken, stock
    i = 0
    while i < n:
        j = _next_fitting(q, i, stock)
        if j >= n:
            break
        cs = np.cumsum(q[j:j + _BLOCK])
        k = int(np.searchsorted(cs, stock, side="right"))  # >= 1 since q[j] <= stock
        taken[j:j + k] = True
        stock -= int(cs[k - 1])
        i = j + k
    return taken, stock


class StockFold(KeyFold):
    result_ddl = "status string, remaining int"

    def __init__(self, initial_stock: int = DEFAULT_STOCK, qty_col: str = "quantity"):
        self.initial = int(initial_stock)
        self.qty_col = qty_col
        self.input_cols = (qty_col,)

    def init(self, key):
        return self.initial

    def step(self, key, seg, state):
        q = _quantities(seg, self.qty_col)
        taken, left = reserve_scan(q, int(state))
        remaining = int(state) - np.cumsum(np.where(taken, q, 0))
        return {"status": np.where(taken, RESERVED, OUT_OF_STOCK).astype(object),
                "remaining": remaining.astype(np.int32)}, left

    # Transfer function: the exit stock for every possible entry stock 0..initial.
    # Each applied order lowers the largest entry, so at most `initial` orders
    # change the table; the others are skipped by the same vectorised scan.
    def tf_identity(self):
        return np.arange(self.initial + 1, dtype=np.int64)

    def tf_step(self, tf, seg):
        q = _quantities(seg, self.qty_col)
        if (q <= 0).any():
            for v in q:
                tf = np.where(tf >= v, tf - v, tf)
            return tf
        i, n = 0, len(q)
        while i < n:
            top = int(tf.max())
            j = _next_fitting(q, i, top)
            if j >= n:
                break
            tf = np.where(tf >= q[j], tf - q[j], tf)
            i = j + 1
        return tf

    def tf_apply(self, tf, state):
        return int(tf[int(state)])

    def tf_compose(self, first, second):
        return second[first]


def stock_reservation(orders: DataFrame, initial_stock: int = DEFAULT_STOCK,
                      key: str = "product_id", order: tuple[str, ...] = ("placed_at", "order_id"),
                      num_partitions: int | None = None) -> DataFrame:
    """Append ``status`` (RESERVED / OUT_OF_STOCK) and ``remaining`` to each order."""
    return ordered_fold(orders, key, list(order), StockFold(initial_stock), num_partitions)


def reservations(orders: DataFrame, **kw) -> DataFrame:
    """The ``inventory.reserved`` records: one per order, keyed by product."""
    r = stock_reservation(orders, **kw)
    return r.select("order_id", "product_id", "quantity", "status",
                    F.col("placed_at").alias("reserved_at"), "correlation_id", "tenant_id",
                    "remaining")
