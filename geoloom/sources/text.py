"""Text sources: point tables, matrices, predictions, the region catalog and region lists.

Columns keep the order of the file, for roles come from it. `NA` and empty cells are null, blanks around are dropped.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"STATE", "NEON", "CEC", "BOX"}


def points(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV point table of doubles. With `columns` the file has no header; else the header names them."""
    read = spark.read.option("nullValue", "NA").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if columns is None:
        columns = read.option("header", True).csv(path).columns  # reads one line
        read = read.option("header", True)
    return read.schema(", ".join(f"`{c}` double" for c in columns)).csv(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions without a header: their first three columns, as x, y and sm."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = F.split("value", ",")
    return lines.select(*(_number(cells[i]).alias(c) for i, c in enumerate(("x", "y", "sm"))))


def _number(cell):
    return F.trim(cell).try_cast("double")


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, separators: str = "[,\t]") -> DataFrame:
    """Doubles divided by any of some separators, a pattern that the CSV reader can't take.

    Without `columns`, the first line names them; lines equal to it are headers.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if columns is None:
        header = spark.read.text(path).first()
        if header is None:
            raise ValueError(f"no header in {path}")
        columns = [c.strip() for c in spark.createDataFrame([header], "value string").select(F.split("value", separators)).first()[0]]
        lines = lines.where(F.col("value") != header[0])
    cells = F.split("value", separators)
    return lines.select(*(_number(F.try_element_at(cells, F.lit(i + 1))).alias(c) for i, c in enumerate(columns)))


def matrix(spark: SparkSession, path: str, width: int, header_rows: int = 0, separator: str = ",") -> DataFrame:
    """Columns c0..c{width-1} of doubles; the first `header_rows` lines of every file are left out.

    A file's lines may be read by many tasks: the one that has its first block leaves the headers out, which must
    lie in that block. `separator` is a pattern; use r"\\s+" for blanks.
    """
    lines = spark.read.text(path)
    if header_rows:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

        def body(batches):
            passed: dict[str, int] = {}
            for b in batches:
                stay = []
                for file, start in zip(b["file"].to_pylist(), b["start"].to_pylist()):
                    if start == 0 and passed.get(file, 0) < header_rows:
                        passed[file] = passed.get(file, 0) + 1
                        stay.append(False)
                    else:
                        stay.append(True)
                yield b.select(["value"]).filter(pa.array(stay, pa.bool_()))

        lines = lines.mapInArrow(body, "value string")
    cells = F.split(F.trim("value"), separator)
    return lines.where(F.trim("value") != "").select(*(_number(F.try_element_at(cells, F.lit(i + 1))).alias(f"c{i}") for i in range(width)))


def region_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(reg_type, region) of the catalog: a column for each type, a second line of descriptions in each file, blanks below.

    All are strings, for a code such as 10 or 6.10 is not a number.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))  # small files
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "reg_type string, region string")
    columns = [c.strip().strip('"') for c in first.lines[0].split(",")]
    body = lines.select(F.posexplode("lines").alias("place", "line")).where("place >= 2 and trim(line) != ''")
    wide = body.select(F.from_csv("line", F.lit(", ".join(f"`{c}` string" for c in columns))).alias("r")).select("r.*")
    each = F.explode(F.array(*(F.struct(F.lit(c.split(".")[0]).alias("reg_type"), F.trim(F.col(f"`{c}`")).alias("region")) for c in columns)))
    return wide.select(each.alias("r")).select("r.*").where("region is not null and region != ''").distinct()


def region_list(spark: SparkSession, text: str) -> DataFrame:
    """(place, reg_type, region) of a literal list of pairs, in its order; a type that isn't known is an error."""
    pairs = ast.literal_eval(text.strip())
    for kind, _ in pairs:
        if kind not in TYPES:
            raise ValueError(f"unknown type of region: {kind}")
    return spark.createDataFrame([(i, k, str(r)) for i, (k, r) in enumerate(pairs)], "place int, reg_type string, region string")
