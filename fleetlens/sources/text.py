"""Line-oriented inputs: key/value device lines, fixed-arity fields,
operation logs and object-store paths (S3, S4, S5, S7).

Each reader is a row-local parse (regex / split expressions inside
whole-stage codegen) over a string column, so it runs equally on a text
scan (``spark.read.text``) or a column of a table. Lines that do not
parse are kept with ``status = 'invalid'`` for quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files to one row per line (column ``value``)."""
    return spark.read.text(path)


PAIR_RE = r'([^\s="]+)="([^"]*)"'


def read_device_lines(df: DataFrame, col: str, names: Sequence[str], id_cols: Sequence[str] = (),
                      lower_values: bool = True) -> DataFrame:
    """``KEY="value"`` lines as one row per line with the columns ``names``.

    Keys are matched in lower case; a key that a line does not carry is
    NULL, a repeated key keeps its last value, and other keys are ignored.
    """
    line = F.col(col)
    keys = F.transform(F.regexp_extract_all(line, F.lit(PAIR_RE), 1), F.lower)
    values = F.regexp_extract_all(line, F.lit(PAIR_RE), 2)
    out = df.select(*id_cols, keys.alias("_k"), values.alias("_v"))

    def value(name: str):
        # the last place of the key: its first place from the end
        place = F.size("_k") - F.array_position(F.reverse("_k"), name.lower()) + 1
        v = F.when(F.array_contains("_k", name.lower()), F.get("_v", (place - 1).cast("int")))
        return F.lower(v) if lower_values else v

    return out.select(*id_cols, *[value(n).alias(n) for n in names])


def read_key_value_lines(df: DataFrame, col: str, id_cols: Sequence[str],
                         lower_values: bool = False) -> DataFrame:
    """``KEY="value" KEY2="value2"`` lines to one row per pair
    (``id..., key, value``). Keys are lower-cased. Values keep their case
    unless ``lower_values`` is set (the device-listing parser lower-cases
    them too, which also changes the case of mount paths)."""
    keys = F.regexp_extract_all(F.col(col), F.lit(PAIR_RE), 1)
    values = F.regexp_extract_all(F.col(col), F.lit(PAIR_RE), 2)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    out = df.select(*id_cols, F.explode(pairs).alias("_p"))
    value = F.lower(F.col("_p.v")) if lower_values else F.col("_p.v")
    return out.select(*id_cols, F.lower(F.col("_p.k")).alias("key"), value.alias("value"))


def read_fields(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Whitespace-separated fields with a fixed arity to named columns.

    A line with a different number of fields gets ``status = 'invalid'``
    and NULL fields (the line itself is kept for quarantine).
    """
    parts = F.split(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""), r"\s+")
    ok = F.size(parts) == len(names)
    out = df.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("invalid")))
    return out.withColumns({n: F.when(ok, F.get(parts, i)) for i, n in enumerate(names)})


# Operation log line layout
# "<asctime> - <logger>.<module, padded to 9> - <level, padded to 5> - <message>",
# asctime as "YYYY-MM-DD HH:MM:SS,mmm"; host messages start with "[host] ".
LOG_RE = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ([^ ]+?) *"
          r" - ([A-Z]+) * - (?:\[([^\]]*)\] )?(.*)$")
LOG_PARTS = "$1\u0001$2\u0001$3\u0001$4\u0001$5"


def read_operation_log(df: DataFrame, col: str) -> DataFrame:
    """Operation log lines to (status, ts, logger, level, host, message).

    One pattern pass cuts a line into its parts. A line of another layout,
    or whose time is not a time, is ``invalid`` with NULL parts.
    """
    parts = F.split(F.regexp_replace(F.col(col), LOG_RE, LOG_PARTS), "\u0001", 5)
    cut = df.withColumn("_parts", F.when(F.size(parts) == 5, parts))
    ts = F.replace(F.get("_parts", 0), F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    cut = cut.withColumn("ts", ts)
    ok = F.col("ts").isNotNull()

    def part(i):
        return F.when(ok, F.get("_parts", i))

    return cut.withColumns({
        "status": F.when(ok, F.lit("ok")).otherwise(F.lit("invalid")),
        "logger": part(1),
        "level": part(2),
        "host": F.when(part(3) != "", part(3)),
        "message": part(4),
    }).drop("_parts")


def normalize_object_paths(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``s3://`` and ``s3n://`` paths to ``s3a://`` so ``spark.read`` can load them."""
    return df.withColumn(out or col, F.regexp_replace(F.col(col), r"^s3n?://", "s3a://"))
