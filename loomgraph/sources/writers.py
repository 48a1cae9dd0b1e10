"""Sinks: CSV, versioned Parquet tables with gates, and small result files with fixed formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RowCountMismatch(ValueError):
    """What was written isn't as many rows as were to come."""


class GateFailed(ValueError):
    """A gate of the rows written doesn't hold."""


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def _files(spark: SparkSession, path: str):
    """(file system, constructor of its paths)."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def _versions(spark: SparkSession, path: str, folder: str) -> list[int]:
    fs, to = _files(spark, path)
    if not fs.exists(to(f"{path}/{folder}")):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(to(f"{path}/{folder}"))]
    return sorted(int(n.removeprefix("version=")) for n in names if n.removeprefix("version=").isdigit())


def current(spark: SparkSession, path: str) -> int | None:
    """Number of the version that readers see; None where nothing was committed."""
    return max(_versions(spark, path.rstrip("/"), "_committed"), default=None)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_parquet() committed last."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(f"{path.rstrip('/')}/data/version={version}")


def write_gated(df: DataFrame, path: str, expected: int | None = None, gates: dict[str, Column] | None = None) -> dict[str, object]:
    """Writes df as the next version of the table at `path`, and commits it if its gates hold.

    Rows, and the aggregates `gates`, are observed while the rows are written: no second job reads them. A gate is a boolean
    aggregate, such as F.count_if(..) == 0. Raises RowCountMismatch or GateFailed, and leaves the table as it was.

    The commit is the creation of one empty file, _committed/<version>, which every file system does whole or not at all; nothing
    is renamed. Until then readers see the version before, and after it this one. The version before stays for those who
    still read it; older ones, and what broken-off writes left, go. df may read from `path` itself.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, to = _files(spark, path)
    held = _versions(spark, path, "_committed")
    version = max([*held, *_versions(spark, path, "data"), 0]) + 1
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(gate.alias(name) for name, gate in (gates or {}).items()))
    observed.write.parquet(f"{path}/data/version={version}")
    found = seen.get
    if expected is not None and found["n_rows"] != expected:
        raise RowCountMismatch(f"{path}: {found['n_rows']} rows, expected {expected}")
    if failed := [name for name in gates or {} if not found[name]]:
        raise GateFailed(f"{path}: {', '.join(failed)}")
    fs.create(to(f"{path}/_committed/{version}"), False).close()
    keep = {version, *held[-1:]}
    for folder, name in (("_committed", "{}"), ("data", "version={}")):  # a version's mark goes before its data
        for old in _versions(spark, path, folder):
            if old not in keep and old < version:
                fs.delete(to(f"{path}/{folder}/{name.format(old)}"), True)
    return found


def write_parquet(df: DataFrame, path: str, expected: int | None = None) -> int:
    """write_gated() with no gate but the number of rows, which it returns."""
    return write_gated(df, path, expected)["n_rows"]


def small_csv(df: DataFrame, formats: dict[str, str]) -> str:
    """A result of a few rows (a row a year, decile or threshold) as CSV text; formats: of columns, as '.6f'."""
    lines = [",".join(df.columns)]
    for row in df.collect():
        lines.append(",".join(format(v, formats[c]) if c in formats and v is not None else "" if v is None else str(v) for c, v in row.asDict().items()))
    return "\n".join(lines) + "\n"


def line_chart(df: DataFrame, x: str, y: str, path: str, by: str | None = None) -> bool:
    """A PNG of a small result, a line for each value of `by`; False where matplotlib isn't installed."""
    try:
        import matplotlib
    except ModuleNotFoundError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot

    rows = df.orderBy(x).collect()
    figure, axes = pyplot.subplots()
    for name in sorted({r[by] for r in rows}) if by else [None]:
        own = [r for r in rows if by is None or r[by] == name]
        axes.plot([r[x] for r in own], [r[y] for r in own], label=name)
    axes.set_xlabel(x)
    axes.set_ylabel(y)
    if by:
        axes.legend()
    figure.savefig(path)
    pyplot.close(figure)
    return True
