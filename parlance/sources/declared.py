"""O2: load a table against a declared schema.

``read.schema(...)`` and ``DataFrame.to(...)`` do not check: a missing
column turns into NULLs, an extra one is dropped, and int -> string is
accepted. So every file's schema is compared with the declared one first
(footers only, no data), and only then is the widening applied.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the only implicit widening allowed, file type -> declared type.
WIDENINGS = {(T.IntegerType(), T.LongType())}
# Formats whose files store their own schema (in the footer).
SELF_DESCRIBING = ("parquet", "orc")


class SchemaMismatch(ValueError):
    """The stored table does not fit the declared schema."""


def as_struct(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromDDL(schema)


def schema_problems(found: T.StructType, declared: T.StructType) -> list[str]:
    """Every difference that makes ``found`` unusable as ``declared``."""
    problems = []
    fnames = [f.name for f in found.fields]
    dnames = [f.name for f in declared.fields]
    missing = [n for n in dnames if n not in fnames]
    extra = [n for n in fnames if n not in dnames]
    if missing:
        problems.append(f"missing columns {missing}")
    if extra:
        problems.append(f"extra columns {extra}")
    if not missing and not extra and fnames != dnames:
        problems.append(f"column order {fnames} differs from declared {dnames}")
    ftypes = {f.name: f.dataType for f in found.fields}
    for d in declared.fields:
        ft = ftypes.get(d.name)
        if ft is None or ft == d.dataType:
            continue
        if (ft, d.dataType) in WIDENINGS:
            continue
        problems.append(
            f"column {d.name!r} is {ft.simpleString()}, declared {d.dataType.simpleString()}"
        )
    return problems


def check_schema(found: T.StructType, declared: T.StructType | str, what: str = "table") -> None:
    problems = schema_problems(found, as_struct(declared))
    if problems:
        raise SchemaMismatch(f"{what}: " + "; ".join(problems))


def conform(df: DataFrame, declared: T.StructType | str, what: str = "table") -> DataFrame:
    """Check ``df`` against ``declared`` and apply the allowed widenings."""
    declared = as_struct(declared)
    check_schema(df.schema, declared, what)
    return df.to(declared)


# Schemas that Spark infers at the same time, each by a small job of its own.
SCHEMAS_AT_ONCE = 16


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``: names of the data files under ``path``, as Spark's readers list them,
    found and kept on the executors. Files without rows are among them; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def _footer_print(file: str, fmt: str) -> tuple[str | None, str | None]:
    """(what a footer says about the schema, as text, None); or (None, why not)."""
    from pyarrow import ArrowException, fs, orc, parquet

    try:
        if file.startswith("file:"):
            store, path = fs.LocalFileSystem(), "/" + file[len("file:"):].lstrip("/")
        else:
            store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as f:
            if fmt == "orc":
                return str(orc.ORCFile(f).schema), None
            meta = parquet.read_metadata(f)
            own = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
            tree = str(meta.schema).partition("\n")[2]  # its first line names the Python object
            return f"{tree}{own.decode()}", None
    except (OSError, ArrowException, ValueError) as e:
        # a store this reader does not know, or a file it cannot read
        return None, f"{type(e).__name__}: {e}"[:200]


def footer_prints(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """``file, print, why``: one row per file, its footer read where its name is listed."""

    def prints(frames):
        for f in frames:
            got = [_footer_print(x, fmt) for x in f["file"]]
            yield f.assign(print=[g[0] for g in got], why=[g[1] for g in got])

    return data_files(spark, path).mapInPandas(prints, "file string, print string, why string")


def one_file_per_footer(spark: SparkSession, path: str, fmt: str) -> Iterator[str]:
    """Files that stand for all under ``path``: one for each distinct footer schema.

    One job lists the files, reads their footers on the executors and returns a row
    per distinct schema. Files that cannot be opened there stand for themselves; a
    warning says how many and why, and their names come one after the other.
    """
    prints = footer_prints(spark, path, fmt)
    shut = None
    seen = prints.groupBy("print").agg(F.min("file").alias("file"), F.min("why").alias("why"), F.count(F.lit(1)).alias("n"))
    for r in sorted(seen.collect(), key=lambda r: r["file"]):
        if r["print"] is None:
            shut = r
        else:
            yield r["file"]
    if shut:
        warnings.warn(
            f"{shut['n']} footers are read by Spark jobs of their own; the first is {shut['file']}: {shut['why']}",
            stacklevel=2,
        )
        yield from (r["file"] for r in prints.where("print is null").select("file").toLocalIterator())


def file_schemas(spark: SparkSession, files: Iterator[str], fmt: str) -> Iterator[tuple[str, T.StructType]]:
    """Each file's own schema, as Spark reads it from the footer, a few at a time."""

    def schema(file: str) -> tuple[str, T.StructType]:
        # a name is a pattern to the reader
        name = re.sub(r"([\[\]{}*?\\])", r"\\\1", file)
        return file, spark.read.format(fmt).load(name).schema

    with ThreadPoolExecutor(SCHEMAS_AT_ONCE) as pool:
        while some := list(islice(files, SCHEMAS_AT_ONCE)):
            yield from pool.map(schema, some)


def _partition_names(file: str) -> list[str]:
    """Names of the ``name=value`` folders above a file."""
    folders = file.split("/")[:-1]
    return [f.split("=", 1)[0] for f in folders if "=" in f]


def declared_scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    all_files: bool = True,
) -> DataFrame:
    """Read ``path`` as ``schema``; raise ``SchemaMismatch`` before any data is read.

    Every file is checked: a missing, extra, reordered or mistyped column in any
    of them raises and names the file. Files may mix int and bigint where bigint
    is declared. Columns that come from ``name=value`` folders are checked on the
    table as a whole. One job lists the files and reads their footers on the
    executors, and Spark then infers one schema per distinct footer
    (:func:`one_file_per_footer`); no list of files passes through Python on the
    driver. ``all_files=False`` checks only the one footer Spark opens anyway, for
    tables whose writer is trusted.

    The result is an ordinary lazy scan: later filters and projections still
    reach the file reader as pushed filters and a pruned read schema.
    """
    if fmt not in SELF_DESCRIBING:
        raise ValueError(f"{fmt!r} files carry no schema to check; use one of {SELF_DESCRIBING}")
    declared = as_struct(schema)
    df = spark.read.format(fmt).load(path)
    checked = conform(df, declared, path)
    # the number of files alone: their names stay in the JVM
    if not all_files or len(df._jdf.inputFiles()) < 2:
        return checked
    distinct = set()
    for file, found in file_schemas(spark, one_file_per_footer(spark, path, fmt), fmt):
        folders = set(_partition_names(file)) & set(declared.fieldNames())
        check_schema(found, T.StructType([f for f in declared.fields if f.name not in folders]), file)
        distinct.add(tuple(f.dataType.simpleString() for f in found.fields))
    if len(distinct) == 1:
        return checked
    # int and bigint files together: the reader widens file by file
    return spark.read.format(fmt).schema(declared).load(path)
