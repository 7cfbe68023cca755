"""Run a user function over every row on the executors (M1).

The function sees one row as a dict and returns a dict of output
values. Rows travel to Python in Arrow batches (``mapInArrow``), so integers
keep all their digits and a missing value is ``None``; one batch at a time, so the work spreads over all tasks like any
narrow transformation. Per row, an exception is either captured in the
``error`` column (default) or fails the job (``fail_fast``) — the two
behaviours of a run-on-every-host helper. Pair with ``aggs.fold_outcomes``
to fold per-row errors into one outcome per operation.

``map_until_failure`` stops at the first failure without failing: calls
under way finish, no further call is made, no row's function is called
again after its error, and every row has an outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.session import materialize, scratch_path


def map_rows(df: DataFrame, fn: Callable[[dict], dict], out_schema: T.StructType | str,
             keep: Sequence[str] = (), fail_fast: bool = False,
             error_col: str = "error") -> DataFrame:
    """Apply ``fn`` to each row; output = ``keep`` columns + ``fn``'s fields
    (+ ``error`` unless ``fail_fast``)."""
    if isinstance(out_schema, str):
        out_schema = T._parse_datatype_string(out_schema)
    keep = list(keep)
    kept_fields = [df.schema[c] for c in keep]
    fields = kept_fields + list(out_schema.fields)
    if not fail_fast:
        fields.append(T.StructField(error_col, T.StringType(), True))
    schema = T.StructType(fields)
    out_names = [f.name for f in out_schema.fields]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for row in batch.to_pylist():
                err = None
                try:
                    res = fn(row) or {}
                except Exception as e:  # captured per row
                    if fail_fast:
                        raise
                    res, err = {}, f"{type(e).__name__}: {e}"
                values = [row[k] for k in keep] + [res.get(n) for n in out_names] + [err] * (not fail_fast)
                for c, v in zip(columns, values):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


STATUSES = OK, FAILED, NOT_RUN = "ok", "failed", "not-run"


def map_until_failure(df: DataFrame, fn: Callable[[dict], dict], out_schema: T.StructType | str,
                      keep: Sequence[str] = (), waves: int = 8, error_col: str = "error",
                      status_col: str = "status") -> DataFrame:
    """Apply ``fn`` row by row until a call fails: ``keep`` columns, ``fn``'s fields, ``error``, ``status``.

    The rows are dealt into ``waves`` folders of the checkpoint folder and
    the waves run one after another as jobs of their own. A failure is an
    outcome, not a failed task, so Spark has nothing to retry: the row is
    ``failed`` with its error, its task calls ``fn`` no more, and the other
    tasks of the wave, whose calls are under way, finish theirs. After a wave
    with a failure no further one is run; the rows that got no call are
    ``not-run``. Outcomes of finished waves are written before the next one
    begins, so they are kept whatever comes after. More waves end sooner and
    cost a job each. If an executor is lost, the rows of its unfinished tasks
    are called again; rows whose call failed belong to finished tasks.
    """
    if waves < 1:
        raise ValueError("waves must be >= 1")
    if isinstance(out_schema, str):
        out_schema = T._parse_datatype_string(out_schema)
    keep, spark = list(keep), df.sparkSession
    out_names = [f.name for f in out_schema.fields]
    schema = T.StructType([df.schema[c] for c in keep] + list(out_schema.fields)
                          + [T.StructField(error_col, T.StringType()), T.StructField(status_col, T.StringType())])
    arrow = to_arrow_schema(schema)
    whole = scratch_path(spark, "waves")
    # dealt by partition and place, so a wave is a share of every task's rows
    dealt = df.withColumn("_wave", F.pmod(F.monotonically_increasing_id(), F.lit(waves)).cast("int"))
    dealt.write.partitionBy("_wave").parquet(whole)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_wave", T.IntegerType())])).parquet(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = False
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for row in batch.to_pylist():
                res, err, status = {}, None, NOT_RUN
                if not failed:
                    try:
                        res, status = fn(row) or {}, OK
                    except Exception as e:
                        err, status, failed = f"{type(e).__name__}: {e}", FAILED, True
                for c, v in zip(columns, [row[k] for k in keep] + [res.get(n) for n in out_names] + [err, status]):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    out, wave = None, 0
    while wave < waves:
        done = materialize(rows.where(F.col("_wave") == wave).drop("_wave").mapInArrow(run, schema), "outcomes")
        out = done if out is None else out.unionByName(done)
        wave += 1
        if not done.where(F.col(status_col) == FAILED).isEmpty():
            break
    if wave < waves:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(keep):-1]]
        out = out.unionByName(rows.where(F.col("_wave") >= wave).select(*keep, *nothing, F.lit(NOT_RUN).alias(status_col)))
    return out
