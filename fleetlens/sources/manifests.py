"""Cluster manifests: JSON documents that record what is installed.

A manifest is ``{"java_version": int, "services": [[name, {settings}], ...],
...}``. Reading parses each document once into a VARIANT and explodes the
service pairs; writing folds service rows back into one canonical
document per cluster (keys sorted, compact). Parsing is row-local;
writing is one aggregate whose groups are bounded by the number of
services a cluster runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Manifest layout. Top-level keys "java_version" (int) and
# "services" (list of [service name, settings object] pairs); the service
# version is the settings key "version".
JAVA_KEY = "java_version"
SERVICES_KEY = "services"
VERSION_KEY = "version"


def read_manifests(df: DataFrame, json_col: str, id_cols: Sequence[str],
                   fields: dict[str, str] | None = None) -> DataFrame:
    """One row per installed service: ``id..., status, java_version, service,
    version`` plus any ``fields`` (name -> Spark type) read from the service
    settings. A document that is not JSON, or has no service list, gives
    one row with ``status = 'invalid'``.
    """
    fields = fields or {}
    doc = F.try_parse_json(F.col(json_col))
    services = F.try_variant_get(doc, f"$.{SERVICES_KEY}", "array<variant>")
    base = df.select(*id_cols, doc.alias("_doc"), services.alias("_services"))
    exploded = base.select(
        *id_cols,
        F.when(F.col("_services").isNull(), F.lit("invalid")).otherwise(F.lit("ok")).alias("status"),
        F.try_variant_get(F.col("_doc"), f"$.{JAVA_KEY}", "int").alias("java_version"),
        F.explode_outer("_services").alias("_pair"))
    pair = F.col("_pair")
    return exploded.select(
        *id_cols, "status", "java_version",
        F.try_variant_get(pair, "$[0]", "string").alias("service"),
        F.try_variant_get(pair, f"$[1].{VERSION_KEY}", "string").alias("version"),
        *[F.try_variant_get(pair, f"$[1].{name}", typ).alias(name) for name, typ in fields.items()])


def _json_string(col) -> F.Column:
    """A JSON string literal for ``col`` (quoted and escaped)."""
    return F.regexp_replace(F.to_json(F.array(col)), r"^\[|\]$", "")


def write_manifests(df: DataFrame, cluster_col: str, service_col: str,
                    setting_cols: Sequence[str], java_col: str, path: str | None = None) -> DataFrame:
    """Service rows to one canonical JSON manifest per cluster.

    Settings become a JSON object with sorted keys (NULL kept as ``null``);
    services are sorted by name, a missing Java version is ``null``. Rows
    that disagree are all kept as entries of the list, the greatest Java
    version is taken, and ``conflict`` is true. With ``path`` the documents are also
    written as text files, one line per cluster.
    """
    settings = F.to_json(F.struct(*[F.col(c) for c in sorted(setting_cols)]),
                         {"ignoreNullFields": "false"})
    pair = F.concat(F.lit("["), _json_string(F.col(service_col)), F.lit(","), settings, F.lit("]"))
    # One entry per (cluster, service, settings) first, so a cluster's list is
    # bounded by its different entries, whatever the input repeats.
    entries = (df.groupBy(cluster_col, F.col(service_col).alias("_s"), pair.alias("_p"))
               .agg(F.max(java_col).alias("_java"), F.min(java_col).alias("_java_min")))
    per_cluster = (entries.groupBy(cluster_col)
                   .agg(F.max("_java").alias("_java"), F.min("_java_min").alias("_java_min"),
                        F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"),
                                                             F.col("_p").alias("p")))).alias("_pairs")))
    names = F.transform("_pairs", lambda x: x["s"])
    conflict = (F.coalesce(F.col("_java") != F.col("_java_min"), F.lit(False))
                | (F.size(F.array_distinct(names)) < F.size(names)))
    doc = F.concat(F.lit('{"' + JAVA_KEY + '":'), F.coalesce(F.col("_java").cast("string"), F.lit("null")),
                   F.lit(',"' + SERVICES_KEY + '":['),
                   F.array_join(F.transform("_pairs", lambda x: x["p"]), ","),
                   F.lit("]}"))
    out = per_cluster.select(F.col(cluster_col).alias("cluster"), doc.alias("manifest"), conflict.alias("conflict"))
    if path is not None:
        out.select(F.concat_ws("\t", "cluster", "manifest").alias("value")).write.mode("overwrite").text(path)
    return out
