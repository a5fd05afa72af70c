"""Case-report-form (CRF) scan: a folder of CSV exports with a multi-row header.

Each file starts with ``header_rows`` header lines (group row(s) with merged
cells exported as empty cells, then the field row).  The header of every file is
read from its first lines, flattened to ``Group::Field`` names, and its records
are read as text by that header; header records are told by their place.
Then: rename / drop / required check (before any job) -> date parsing ->
numeric coercion -> range validation -> complete-case filter.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import quality as Q


GLOB = "*.{csv,txt}"


def clean_name(name) -> str:
    return str(name).strip()


def flatten_header(rows: Sequence[Sequence[str]], sep: str = "::") -> list[str]:
    """Header rows -> flat names.

    One row: names are stripped.  Several rows: empty group cells take the
    last group label to their left (merged cells); leading empty group cells
    are named ``Unnamed: {i}_level_{r}``; parts are stripped, empty parts
    skipped, and joined with ``sep``.
    """
    if len(rows) == 1:
        return [clean_name(c) for c in rows[0]]
    width = max(len(r) for r in rows)
    grid = [list(r) + [""] * (width - len(r)) for r in rows]
    for r in range(len(grid) - 1):
        last = None
        for i in range(width):
            cell = clean_name(grid[r][i])
            if cell:
                last = cell
            grid[r][i] = cell or (last if last is not None else f"Unnamed: {i}_level_{r}")
    out = []
    for i in range(width):
        parts = [clean_name(grid[r][i]) for r in range(len(grid))]
        out.append(sep.join(p for p in parts if p))
    return out


def read_headers(spark: SparkSession, path: str, header_rows: int) -> dict[str, list[list[str]]]:
    """The header rows of every file: the first ``header_rows`` lines of each (header cells hold no line break)."""
    lines = (spark.read.option("pathGlobFilter", GLOB).text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
             .where("start = 0").select("file", "value"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}  # a file's first block is read by one task, in order
        for batch in batches:
            files = batch.column(0).to_pylist()
            keep = []
            for i, file in enumerate(files):
                seen[file] = seen.get(file, -1) + 1
                if seen[file] < header_rows:
                    keep.append((file, seen[file], batch.column(1)[i].as_py()))
            yield pa.RecordBatch.from_pydict({"file": pa.array([k[0] for k in keep], pa.string()), "place": pa.array([k[1] for k in keep], pa.int32()), "value": pa.array([k[2] for k in keep], pa.string())})

    out: dict[str, list[list[str]]] = {}
    for r in lines.mapInArrow(first, "file string, place int, value string").orderBy("file", "place").collect():  # header_rows lines a file
        out.setdefault(r["file"], []).append(next(csv.reader(io.StringIO(r["value"])), []))
    if not out:
        raise FileNotFoundError(f"no CSV lines under {path}")
    return out


def read_crf(spark: SparkSession, path: str, header_rows: int = 2, sep: str = "::") -> DataFrame:
    """All columns as text with flattened names, by Spark's CSV reader.

    A quoted cell may hold line breaks: a file is read whole by one task, as
    exports of forms are small and many.  Each file is read by its own header,
    so files may hold their columns in any order; a column that a file lacks is
    NULL there.  The first ``header_rows`` records of a file are its header
    wherever else the same record stands; records without any text are left out.
    """
    forms: dict[tuple[str, ...], list[str]] = {}  # distinct headers and their files
    for file, rows in read_headers(spark, path, header_rows).items():
        forms.setdefault(tuple(flatten_header(rows, sep)), []).append(file)
    names = list(dict.fromkeys(n for f in forms for n in f))
    out = None
    for form, files in forms.items():
        schema = ", ".join(f"_c{i} string" for i in range(len(form)))
        cells = spark.read.schema(schema).csv(files, multiLine=True, escape='"', header=False, enforceSchema=True)
        data = _without_header(cells.select("*", F.col("_metadata.file_path").alias("file")), header_rows)
        some = F.lit(False)
        for i in range(len(form)):
            some = some | (F.trim(F.coalesce(F.col(f"_c{i}"), F.lit(""))) != "")
        part = data.where(some).select(*[F.col(f"_c{form.index(n)}").alias(n) if n in form else F.lit(None).cast("string").alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    return out


def _without_header(cells: DataFrame, header_rows: int) -> DataFrame:
    """Records behind each file's first ``header_rows``: a file is read by one task, in order, so it counts them."""
    last = len(cells.columns) - 1

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            files = batch.column(last).dictionary_encode()
            keep = np.ones(batch.num_rows, bool)
            for k, file in enumerate(files.dictionary.to_pylist()):
                at = np.flatnonzero(files.indices.to_numpy() == k)
                keep[at[:max(0, header_rows - seen.get(file, 0))]] = False
                seen[file] = seen.get(file, 0) + len(at)
            yield batch.filter(pa.array(keep))

    return cells.mapInArrow(behind, cells.schema)


def rename_and_select(df: DataFrame, renames: Mapping[str, str], drop: Iterable[str] = (),
                      required: Iterable[str] = ()) -> DataFrame:
    """Rename, drop (unknown names ignored), then raise ``KeyError`` listing missing required columns."""
    renames = {clean_name(k): clean_name(v) for k, v in (renames or {}).items()}
    present = {k: v for k, v in renames.items() if k in df.columns}
    out = df.withColumnsRenamed(present) if present else df
    drops = [c for c in (clean_name(d) for d in drop) if c in out.columns]
    out = out.drop(*drops) if drops else out
    missing = [c for c in (clean_name(r) for r in required) if c not in out.columns]
    if missing:
        raise KeyError(f"the export lacks required columns {missing}")
    return out


def ingest_crf(spark: SparkSession, path: str, *, renames: Mapping[str, str], required: Sequence[str],
               drop: Sequence[str] = (), date_columns: Sequence[str] = (), numeric_columns: Sequence[str] = (),
               rules: Mapping[str, tuple[float, float]] | None = None, header_rows: int = 2,
               drop_missing: bool = True, key: str | None = None,
               date_formats: Sequence[str] = P.DEFAULT_DATE_FORMATS) -> DataFrame:
    """The ingest chain of the reference on a CSV export folder.

    Dates are read by ``date_formats``; other texts become NULL and then count
    as missing (:func:`unread_dates` counts them).
    """
    df = rename_and_select(read_crf(spark, path, header_rows), renames, drop, required)
    df = df.withColumns({c: P.parse_timestamp(F.col(c), date_formats) for c in date_columns if c in df.columns})
    df = df.withColumns({c: P.to_number(F.col(c)) for c in numeric_columns if c in df.columns})
    if rules:
        Q.range_violations(df, rules, key=key or df.columns[0], mode="fail")
    if drop_missing:
        df = Q.complete_case(df, required)
    return df


def unread_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = P.DEFAULT_DATE_FORMATS) -> DataFrame:
    """(column, n_unread): cells with text that no format reads, from one aggregate over the text columns."""
    counts = [F.count_if((F.trim(F.col(f"`{c}`")) != "") & P.parse_timestamp(F.col(f"`{c}`"), formats).isNull()).alias(f"n{k}") for k, c in enumerate(columns)]
    return df.agg(*counts).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n_unread")) for k, c in enumerate(columns)])))


def write_crf(df: DataFrame, path: str, header: Sequence[Sequence[str]]) -> None:
    """Write a CSV export folder, each file with the header lines (test/export helper)."""
    cols = df.columns
    quoted = lambda c: F.when(c.rlike("[\",\n]"), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    lines = df.select(F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in cols]).alias("value"))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(header)
    head = out.getvalue()

    def with_header(batches):
        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": pa.array([head + v if first and not i else v for i, v in enumerate(values)], pa.string())})
            first = first and not values
        if first:
            yield pa.RecordBatch.from_pydict({"value": pa.array([head.rstrip("\n")], pa.string())})

    lines.mapInArrow(with_header, "value string").write.mode("overwrite").text(path, lineSep="\n")
