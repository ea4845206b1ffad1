"""Writers: JSON lines, layers, reports, content-addressed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Separators that line readers of other systems split at.
SEPARATORS = (("\u2028", "\\u2028"), ("\u2029", "\\u2029"), ("\x85", "\\u0085"))


def json_line(*cols: str) -> Column:
    """A row as one JSON line with the Unicode line separators escaped."""
    out = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    for c, esc in SEPARATORS:
        out = F.replace(out, F.lit(c), F.lit(esc))
    return out


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.select(json_line(*df.columns).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each layer as JSON lines under the path; rows are counted while they are written."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in layers.items():
        seen = Observation(name)
        write_json_lines(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, arrays joined by semicolons."""
    flat = [F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def store_new(df: DataFrame, path: str, key: str = "sha256") -> int:
    """Append rows whose key the store lacks, one row a key; the number appended. A second run with the same rows appends none."""
    spark = df.sparkSession
    new = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    try:
        old = spark.read.parquet(path).select(key)
        new = new.join(old, key, "left_anti")
    except AnalysisException:
        pass
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def manifest(inputs: DataFrame, config: str, plan: list[str]) -> DataFrame:
    """One row: hash of the configuration, number and hash of the inputs (name, sha256), steps.

    The hash of the inputs is that of the hashes of 4,096 groups of them, so that no task holds all names.
    """
    line = F.sha2(F.concat_ws(":", "name", "sha256"), 256)
    lines = inputs.select(line.alias("l"), F.substring(line, 1, 3).alias("g"))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    groups = lines.groupBy("g").agg(F.count("*").alias("n"), digest("l").alias("h"))
    one = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_inputs"), digest("h").alias("inputs_hash"))
    return one.withColumns({"config_hash": F.sha2(F.lit(config), 256), "plan": F.array(*(F.lit(p) for p in plan))})
