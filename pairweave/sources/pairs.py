"""Text readers for pair tables and object lists, and the assignment writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates fields, and what separates the names of a header.
FIELD_SEPARATORS = "[,\\t]"
#: What can't occur in a line, as the separator of a reader that shall not separate.
NO_SEPARATOR = "\u0001\u0002"
ORDER = "_order"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines ``(value, _order)`` of every file after its first; Hadoop splits the files, the order key
    restores the order of lines.

    Lines are read as records of a single field: only that reader knows in which split a file begins.
    """
    lines = spark.read.schema("value string").option("header", True).option("enforceSchema", True).option("sep", NO_SEPARATOR).option("quote", "").option("escape", "").csv(path)
    key = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return lines.select(F.regexp_replace("value", "\\r$", "").alias("value"), key.alias(ORDER)).filter("value <> ''")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a delimited file: blanks, commas and tabs separate them."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].replace(",", " ").split() if first else []


def read_pairs(spark: SparkSession, path: str, *, id_cols=None, distance_col=None, filters=(), numeric_ids: bool = False, permissive: bool = False) -> tuple[DataFrame, Column]:
    """A delimited pair table with a header, and the order of its rows. The path may be a folder of such files.

    The first line of a file is its header, whatever it says; one that stands elsewhere is a row, and ill-formatted.
    Comma and tab both separate fields, even within one file. Only the ids, the distance and the filter columns are
    converted. A row of another width, or a value that isn't a number, is an error with that row in it; with
    ``permissive`` such rows are left out instead. A file with a header only gives an empty table.
    """
    names = header_of(spark, path)
    if len(names) < 3:
        raise ValueError("a pair table has at least three columns")
    ids = list(id_cols or names[:2])
    wanted = list(dict.fromkeys([*ids, distance_col or names[2], *filters]))
    unknown = [c for c in wanted if c not in names]
    if unknown:
        raise ValueError(f"the pair table has no column {unknown[0]!r}")
    wanted.sort(key=names.index)
    lines = _lines(spark, path).withColumn("f", F.split("value", FIELD_SEPARATORS, -1))
    columns, good = [], F.size("f") == len(names)
    for c in wanted:
        raw = F.get(F.col("f"), F.lit(names.index(c)))
        kind = "string" if c in ids and not numeric_ids else "bigint" if c in ids else "double"
        value = raw if kind == "string" else F.expr(f"try_cast(f[{names.index(c)}] as {kind})")
        good = good & value.isNotNull()
        columns.append(value.alias(c))
    if permissive:
        lines = lines.filter(F.coalesce(good, F.lit(False)))
    else:
        lines = lines.filter(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("ill-formatted row in the pair table: "), F.col("value"))).cast("boolean")))
    return lines.select(*columns, ORDER), F.col(ORDER)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(object, gi)``: the first field of each line after the header, with its 0-based position."""
    from pairweave.operators.assign import with_position

    lines = _lines(spark, path).select(F.get(F.split("value", FIELD_SEPARATORS), F.lit(0)).alias("object"), ORDER)
    return with_position(lines, [F.asc(ORDER)], "gi").select("object", "gi")


def write_assignment(assigned: DataFrame, path: str, *, csv: bool = False) -> None:
    """A folder of lines ``object<sep>cluster``, ordered by cluster and then output order over all its files.

    One file per range of clusters, so that no single task sorts everything, each with the header, as readers of
    folders expect; :func:`write_single_file` writes one file with one header.
    """
    ordered = assigned.orderBy("cluster_no", "out_key").select(F.col("object").cast("string").alias("object"), F.col("cluster").cast("string").alias("cluster"))
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.mode("overwrite").options(header=True, sep="," if csv else "\t", quote="\u0000", emptyValue="", **blanks).csv(path)


def write_single_file(assigned: DataFrame, path: str, *, csv: bool = False) -> None:
    """Header ``object<sep>cluster`` and one line per object in output order, in one local file, streamed through the
    driver a partition at a time."""
    sep = "," if csv else "\t"
    ordered = assigned.orderBy("cluster_no", "out_key").select(F.col("object").cast("string"), F.col("cluster").cast("string"))
    with open(path, "w", newline="") as out:
        out.write(f"object{sep}cluster\n")
        for row in ordered.toLocalIterator():
            out.write(f"{row[0]}{sep}{row[1]}\n")


def edge_lines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(src, nearby, line)``: ``name,name,distance`` of every directed entry, the distance with ten decimals.

    Lines sort by the first name and then by the first appearance (``nearby``) of the second object.
    """
    from pairweave.operators.edges import symmetrize

    both = symmetrize(edges).join(vertices.select(F.col("id").alias("dst"), F.col("appear_key").alias("nearby")), "dst")
    line = F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string"), F.format_string("%.10f", F.col("d")))
    return both.select("src", "nearby", line.alias("line"))


def dump_edges(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """:func:`edge_lines` in their order, in a folder of text files."""
    edge_lines(edges, vertices).orderBy("src", "nearby").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
