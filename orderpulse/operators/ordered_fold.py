"""Exact per-key ordered folds that never put a whole key into one task.

The reference keeps per-key state in a keyed store (stock per product, a
rate-limit window per tenant) and updates it one record at a time.  The
result of row *i* depends on every earlier row of its key, so a plain
``groupBy(key).applyInPandas`` would send a hot key - possibly a third of
all rows - to a single task.  Instead:

1. ``repartitionByRange(n, key, *order)`` + ``sortWithinPartitions``: the
   range bounds include the ordering columns, so a hot key is cut into
   contiguous slices over many partitions, each sorted.
2. Pass 1 (``mapInArrow``, streamed batch by batch; only the key and the
   fold's inputs leave Arrow, so all other columns pass unchanged): every key segment of a
   partition is folded from the key's initial state.  For the first segment
   of each partition the fold also builds a *transfer function* - a compact
   summary mapping any entry state to the exit state (bounded by the state
   domain, not by the rows).  Each partition emits two meta rows: the
   transfer function of its first segment and the exit state of its last.
3. The output of pass 1 is checkpointed (reliable, in ``spark.checkpoint.dir``)
   so the lineage is cut and both later reads see the same partitions.
4. Carry resolution: meta rows (at most two per partition) are composed in
   blocks of ~sqrt(n) partitions in parallel, the block functions are
   chained per key, and the functions inside each block are applied in
   parallel, yielding the true entry state of every continuation segment
   (no group ever holds a whole key's transfer functions).
5. Pass 2: only first segments whose entry differs from the initial state
   are folded again (``mapInArrow`` over the checkpointed partitions, after
   a broadcast join with the resolved entries - at most one row per
   partition).  All other rows are read straight from the checkpoint by the
   JVM and unioned back.

The work is two linear passes over the data, fully parallel even when one key
dominates; the only data that crosses tasks besides the range shuffle is the
meta table, whose size is bounded by the number of partitions.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ensure_checkpoint_dir, ship_package

_KIND_ROW = "R"
_KIND_FIRST = "A"   # meta: transfer function of a partition's first segment
_KIND_LAST = "B"    # meta: exit state of a partition's last segment (when not also first)


class KeyFold:
    """A sequential per-key fold with a composable transfer function.

    Subclasses implement the five methods; every one of them works on a
    *contiguous, sorted slice* of one key's rows, given as a dict of numpy
    arrays (the columns named in ``input_cols``), so slicing costs no copies.
    """

    #: DDL of the columns the fold appends to each row.
    result_ddl: str = ""
    #: Input columns the fold reads.
    input_cols: tuple[str, ...] = ()

    def init(self, key: Any) -> Any:
        raise NotImplementedError

    def step(self, key: Any, seg: dict, state: Any) -> tuple[dict, Any]:
        """Fold a slice from ``state``; returns ({result column: array}, state)."""
        raise NotImplementedError

    def tf_identity(self) -> Any:
        raise NotImplementedError

    def tf_step(self, tf: Any, seg: dict) -> Any:
        raise NotImplementedError

    def tf_apply(self, tf: Any, state: Any) -> Any:
        raise NotImplementedError

    def tf_finish(self, tf: Any) -> Any:
        """Hook to close a transfer function once its segment has ended."""
        return tf

    # Optional fast path: ``step_many(keys, segments, arrays, entries) ->
    # (result columns for the whole batch, exit state per segment)`` folds all
    # key slices of a batch at once; folds over many small keys implement it.

    def tf_compose(self, first: Any, second: Any) -> Any:
        """The transfer function of ``first``'s slice followed by ``second``'s.

        Its size must stay within the bound of a single transfer function (the
        state domain), so resolution can compose blocks of partitions.
        """
        raise NotImplementedError


@dataclass
class _Meta:
    key: Any = None
    tf: Any = None
    single: bool = True
    seen: bool = False


def _segments(keys: np.ndarray):
    n = len(keys)
    if n == 0:
        return []
    brk = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], brk))
    ends = np.concatenate((brk, [n]))
    return list(zip(starts.tolist(), ends.tolist()))


def _objects(col: pa.Array) -> np.ndarray:
    out = np.empty(len(col), dtype=object)
    out[:] = col.to_pylist()
    return out


def _inputs(col: pa.Array) -> np.ndarray:
    if pa.types.is_timestamp(col.type):   # UTC microseconds, so every Spark timestamp fits
        col = col.cast(pa.timestamp("us"))
    return col.to_pandas().to_numpy()


def _key_values(col: pd.Series) -> np.ndarray:
    # object array so that None compares as its own key
    return col.astype(object).where(col.notna(), None).to_numpy()


# Target bytes per range partition (input size as Catalyst estimates it).
PARTITION_BYTES_CONF = "orderpulse.fold.partitionBytes"
DEFAULT_PARTITION_BYTES = 256 * 1024 * 1024
_UNKNOWN_SIZE = 1 << 62  # Spark reports Long.MaxValue for sizes it cannot estimate


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range cut: one per available core (default parallelism),
    or more when the plan's estimated size needs them to keep each near the
    target size.

    The estimate comes from the optimized plan's statistics, so no job runs to
    size the cut.  Without cost-based statistics a join is estimated as a
    product, so the estimate is capped by the summed size of the plan's leaf
    scans - the bytes actually read.
    """
    spark = df.sparkSession
    base = max(1, spark.sparkContext.defaultParallelism)
    target = int(spark.conf.get(PARTITION_BYTES_CONF, str(DEFAULT_PARTITION_BYTES)))
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        est = int(str(plan.stats().sizeInBytes()))
        leaves = plan.collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        read = sum(x for x in sizes if x < _UNKNOWN_SIZE)
        est = min(est, read)
    except Exception:  # noqa: BLE001 - statistics are best effort
        est = 0
    return int(max(base, -(-est // target)))


def ordered_fold(df: DataFrame, key: str, order: list[str], fold: KeyFold,
                 num_partitions: int | None = None) -> DataFrame:
    """Fold ``fold`` over the rows of each ``key`` in ``order``; returns df + result columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    n = num_partitions or range_partitions(df)
    # every column nullable: meta rows leave the data columns empty
    in_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    res_schema = T.StructType.fromDDL(fold.result_ddl)
    meta_fields = [T.StructField("_pid", T.IntegerType()), T.StructField("_first", T.BooleanType()),
                   T.StructField("_kind", T.StringType()), T.StructField("_meta", T.BinaryType())]
    p1_schema = T.StructType(list(in_schema.fields) + list(res_schema.fields) + meta_fields)
    in_cols = [f.name for f in in_schema.fields]
    res_cols = [f.name for f in res_schema.fields]
    all_cols = in_cols + res_cols

    res_types = [to_arrow_type(f.dataType) for f in res_schema.fields]

    def _batch(cols: list, like: pa.Schema) -> pa.RecordBatch:
        """Columns in the order of p1_schema, with the input's own Arrow types."""
        names = all_cols + ["_pid", "_first", "_kind", "_meta"]
        types = [like.field(c).type for c in in_cols] + res_types + [pa.int32(), pa.bool_(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t, from_pandas=True)
                                           for v, t in zip(cols, types)], names=names)

    def _meta_batch(like: pa.Schema, pid: int, kind: str, key_value: Any, payload: Any) -> pa.RecordBatch:
        cols = [[key_value] if c == key else [None] for c in all_cols]
        return _batch(cols + [[pid], [None], [kind], [pickle.dumps(payload)]], like)

    def pass1(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        first = _Meta()
        cur_key, state, in_first, started, like = None, None, True, False, None
        for batch in batches:
            n_rows = batch.num_rows
            if n_rows == 0:
                continue
            like = batch.schema
            keys = _objects(batch.column(key))
            arrs = {c: _inputs(batch.column(c)) for c in fold.input_cols}
            parts: dict[str, list] = {c: [] for c in res_cols}
            first_flags = np.zeros(n_rows, dtype=bool)
            segs = _segments(keys)
            entries = []
            for s, e in segs:
                k = keys[s]
                if started and k == cur_key:      # continues the previous batch's last key
                    entries.append(state)
                else:
                    if started:
                        in_first = False
                    started = True
                    entries.append(fold.init(k))
                    if in_first:
                        first.key, first.tf, first.seen = k, fold.tf_identity(), True
                cur_key = k
                if in_first:
                    first.tf = fold.tf_step(first.tf, {c: a[s:e] for c, a in arrs.items()})
                    first_flags[s:e] = True
            if hasattr(fold, "step_many"):
                res, exits = fold.step_many(keys, segs, arrs, entries)
                for c in res_cols:
                    parts[c].append(np.asarray(res[c]))
            else:
                exits = []
                for (s, e), entry in zip(segs, entries):
                    res, ex = fold.step(keys[s], {c: a[s:e] for c, a in arrs.items()}, entry)
                    exits.append(ex)
                    for c in res_cols:
                        parts[c].append(np.asarray(res[c]))
            state = exits[-1]
            yield _batch([batch.column(c) for c in in_cols] + [np.concatenate(parts[c]) for c in res_cols]
                         + [[pid] * n_rows, first_flags, [_KIND_ROW] * n_rows, [None] * n_rows], like)
        if first.seen:
            first.single = in_first
            yield _meta_batch(like, pid, _KIND_FIRST, first.key, (fold.tf_finish(first.tf), first.single))
            if not in_first:
                yield _meta_batch(like, pid, _KIND_LAST, cur_key, state)

    parted = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    p1 = parted.mapInArrow(pass1, schema=p1_schema).checkpoint(eager=True)

    # ---- carry resolution over the meta table (<= 2 rows per partition) -------
    # Each meta row is a function of the entry state: a last-slice row is a
    # constant (its exit from a fresh start), a first-slice row is its transfer
    # function.  A key's entries are the prefix compositions of its functions in
    # partition order.  They are resolved in blocks of ~sqrt(n) partitions:
    # (1) compose each block's functions, in parallel; (2) chain the block
    # functions per key; (3) apply the functions inside each block, in
    # parallel.  No group holds more than ~sqrt(n) transfer functions, each
    # bounded by the fold's state domain.
    key_field = T.StructField(key, in_schema[key].dataType, True)
    fix_schema = T.StructType([T.StructField("_fix_pid", T.IntegerType()),
                               T.StructField("_entry", T.BinaryType())])
    block = max(2, math.isqrt(max(n - 1, 0)) + 1)

    def fn_of(kind, blob):
        payload = pickle.loads(blob)
        return ("c", payload) if kind == _KIND_LAST else ("t", payload[0])

    def apply_fn(fn, state):
        return fn[1] if fn[0] == "c" else fold.tf_apply(fn[1], state)

    def then(first, second):
        if second[0] == "c":
            return second
        if first[0] == "c":
            return ("c", fold.tf_apply(second[1], first[1]))
        return ("t", fold.tf_compose(first[1], second[1]))

    blk_schema = T.StructType([key_field, T.StructField("_blk", T.IntegerType()),
                               T.StructField("_fn", T.BinaryType())])

    def compose_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid")
        fn = None
        for kind, blob in zip(pdf["_kind"], pdf["_meta"]):
            f = fn_of(kind, blob)
            fn = f if fn is None else then(fn, f)
        return pd.DataFrame({key: [_key_values(pdf[key])[0]], "_blk": [int(pdf["_blk"].iloc[0])],
                             "_fn": [pickle.dumps(fn)]})

    ent_schema = T.StructType([T.StructField("_bkey", in_schema[key].dataType, True),
                               T.StructField("_bblk", T.IntegerType()),
                               T.StructField("_bentry", T.BinaryType()),
                               T.StructField("_has_prev", T.BooleanType())])

    def chain_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        k = _key_values(pdf[key])[0]
        state, has_prev, out = fold.init(k), False, []
        for blk, blob in zip(pdf["_blk"], pdf["_fn"]):
            out.append((k, int(blk), pickle.dumps(state), has_prev))
            state, has_prev = apply_fn(pickle.loads(blob), state), True
        return pd.DataFrame(out, columns=["_bkey", "_bblk", "_bentry", "_has_prev"])

    def fixes_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid")
        state = pickle.loads(pdf["_bentry"].iloc[0])
        has_prev = bool(pdf["_has_prev"].iloc[0])
        out_pid, out_entry = [], []
        for kind, pid, blob in zip(pdf["_kind"], pdf["_pid"], pdf["_meta"]):
            if kind == _KIND_FIRST and has_prev:
                out_pid.append(int(pid))
                out_entry.append(pickle.dumps(state))
            state, has_prev = apply_fn(fn_of(kind, blob), state), True
        return pd.DataFrame({"_fix_pid": pd.Series(out_pid, dtype="int32"),
                             "_entry": pd.Series(out_entry, dtype=object)})

    meta = p1.filter(F.col("_kind") != _KIND_ROW).select(key, "_pid", "_kind", "_meta")
    meta = meta.withColumn("_blk", F.floor(F.col("_pid") / block).cast("int"))
    blocks = meta.groupBy(key, "_blk").applyInPandas(compose_block, schema=blk_schema)
    entries = blocks.groupBy(key).applyInPandas(chain_blocks, schema=ent_schema)
    with_entry = meta.join(entries, meta[key].eqNullSafe(entries["_bkey"])
                           & (meta["_blk"] == entries["_bblk"]), "inner")
    fixes = (with_entry.select(key, "_blk", "_pid", "_kind", "_meta", "_bentry", "_has_prev")
             .groupBy(key, "_blk").applyInPandas(fixes_in_block, schema=fix_schema))

    return _pass2(p1, fixes, fold, key, order, in_schema, res_schema, all_cols)


def _pass2(p1: DataFrame, fixes: DataFrame, fold: KeyFold, key: str, order: list[str],
           in_schema: T.StructType, res_schema: T.StructType, all_cols: list[str]) -> DataFrame:
    # ---- pass 2: refold continuation segments ----------------------------------
    rows = p1.filter(F.col("_kind") == _KIND_ROW).drop("_kind", "_meta")
    # fixes has at most one row per partition, so its size is bounded by n.
    joined = rows.join(F.broadcast(fixes), rows["_pid"] == fixes["_fix_pid"], "left")
    need = F.col("_first") & F.col("_entry").isNotNull()
    # Rows outside continuation slices never go back to Python: a JVM scan of
    # the checkpoint.  Only the (at most n) continuation slices are re-folded,
    # each in the task of its own partition (filter and join keep partitioning).
    keep = joined.filter(~need).select(*all_cols)
    p2_schema = T.StructType(list(in_schema.fields) + list(res_schema.fields))

    def pass2(batches):
        # one slice of one key, in pass 1's order: folded batch by batch with the state carried
        state, started = None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not started:
                state, started = pickle.loads(batch.column("_entry")[0].as_py()), True
            arrs = {c: _inputs(batch.column(c)) for c in fold.input_cols}
            res, state = fold.step(batch.column(key)[0].as_py(), arrs, state)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in in_schema.fields]
                + [pa.array(np.asarray(res[f.name]), to_arrow_type(f.dataType), from_pandas=True) for f in res_schema.fields],
                names=all_cols)

    refolded = joined.filter(need).mapInArrow(pass2, schema=p2_schema)
    return keep.unionByName(refolded)


def brute_force_fold(pdf: pd.DataFrame, key: str, order: list[str], fold: KeyFold) -> pd.DataFrame:
    """Single-process reference implementation used by the tests."""
    pdf = pdf.sort_values([key] + list(order), kind="stable").reset_index(drop=True)
    outs = []
    for k, seg in pdf.groupby(key, sort=False, dropna=False):
        kk = None if (isinstance(k, float) and np.isnan(k)) else k
        seg = seg.reset_index(drop=True)
        res, _ = fold.step(kk, {c: seg[c].to_numpy() for c in fold.input_cols}, fold.init(kk))
        for c, v in res.items():
            seg[c] = np.asarray(v)
        outs.append(seg)
    return pd.concat(outs, ignore_index=True)
