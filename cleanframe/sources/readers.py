"""CSV, JSON and Parquet readers, format detection and source row ids."""

from __future__ import annotations

from functools import partial, reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.vocabulary import READER_NULLS, SEPARATORS
from ..operators.order import BROADCAST_CHUNKS
from ..schema import nan_to_null, quoted
from ..session import scratch_path, write_table

_EXTENSIONS = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def read_file(
    spark: SparkSession, path: str, sep: str | None = None, file_format: str | None = None,
    row_id: str | None = None, **options,
) -> DataFrame:
    """Read by extension: csv, txt, tsv, json, jsonl or parquet."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    chosen = file_format or _EXTENSIONS.get(extension)
    if chosen == "csv":
        return read_csv(spark, path, sep or ("\t" if extension == "tsv" else None), row_id=row_id, **options)
    if chosen == "json":
        return read_json(spark, path, row_id=row_id, **options)
    if chosen == "parquet":
        return read_parquet(spark, path, row_id=row_id, **options)
    raise ValueError(f"unsupported format: {extension!r}")


# --- detection ------------------------------------------------------------------------------

def separator_scores(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(place, separator, least, most, total)`` over all lines of the source.

    Quoted parts are removed before counting. One aggregate, combined before its shuffle.
    """
    lines = spark.read.text(path)
    bare = lines.where(F.length(strip(F.col("value"))) > 0).select(F.regexp_replace("value", '"[^"]*"', "").alias("value"))
    marks = bare.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("place"), F.lit(s).alias("separator"),
                (F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))).alias("hits"),
            )
            for i, s in enumerate(SEPARATORS)
        ]))
    )
    return marks.groupBy("place", "separator").agg(
        F.min("hits").alias("least"), F.max("hits").alias("most"), F.sum("hits").cast("long").alias("total")
    )


def detect_separator(spark: SparkSession, path: str) -> str:
    """Separator present in every line with the least varying count; else the most frequent one."""
    scores = separator_scores(spark, path)
    steady = F.when(F.col("least") > 0, F.col("most") - F.col("least"))
    best = scores.orderBy(steady.asc_nulls_last(), F.col("total").desc(), "place").first()
    return best["separator"] if best else SEPARATORS[0]


def is_utf8(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(lines, utf8)``: whether every line of the file is valid UTF-8."""
    lines = spark.read.text(path)
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
    )


def detect_encoding(spark: SparkSession, path: str) -> str:
    return _encoding_name(is_utf8(spark, path).first()["utf8"])


def _encoding_name(utf8: bool) -> str:
    return "UTF-8" if utf8 else "ISO-8859-1"


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with text: ``file``, ``utf8``, and ``breaks``.

    ``breaks``: some line has an odd number of quotes, so a quoted value may go on in the next line.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("breaks"))


def _plain_paths(uris: list[str]) -> list[str]:
    """Paths from the escaped ones that Spark gives for its files, in their order."""
    return sorted(unquote(u) for u in uris)


# --- readers --------------------------------------------------------------------------------

def read_csv(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
    multi_line: bool | None = None, typed: bool = False, row_id: str | None = None,
) -> DataFrame:
    """CSV with a header, every column as text, missing-value spellings as null.

    One pass over the text decides, file by file, between UTF-8 and Latin-1 and whether quoted values
    go on over line breaks; only files with such values are kept from being split. A given
    ``encoding`` or ``multi_line`` holds for all files, and both together save the pass. ``typed`` gives
    columns that hold only numbers or booleans their type, as a reader with inference would.
    """
    sep = sep or detect_separator(spark, path)
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    kinds: dict[tuple[str, bool], list[str]] = {}
    if encoding is None or multi_line is None:
        # One row per file, as in the file list that Spark itself keeps.
        for r in csv_files(spark, path).collect():
            kind = (encoding or _encoding_name(r["utf8"]), r["breaks"] if multi_line is None else multi_line)
            kinds.setdefault(kind, []).append(r["file"])
    kinds = kinds or {(encoding or "UTF-8", bool(multi_line)): []}

    def part(kind: tuple[str, bool]) -> DataFrameReader:
        return reader.option("encoding", kind[0]).option("multiLine", kind[1])

    if len(kinds) == 1:
        frames = [part(kind).csv(path) for kind in kinds]
    else:
        first = min(kinds, key=lambda k: _plain_paths(kinds[k])[0])
        schema = part(first).csv(_plain_paths(kinds[first])[0]).schema
        frames = [part(kind).schema(schema).csv(_plain_paths(files)) for kind, files in sorted(kinds.items())]
    names = frames[0].columns
    df = number_rows(frames, row_id) if row_id else reduce(DataFrame.union, frames)
    df = df.withColumns({n: F.when(~quoted(n).isin(*READER_NULLS), quoted(n)) for n in names})
    return apply_reader_types(df) if typed else df


def apply_reader_types(df: DataFrame) -> DataFrame:
    """Cast text columns that hold only integers, numbers or booleans; one aggregate decides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(texts):
        c = strip(quoted(n))
        measures += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(r"^[+-]?\d{1,18}$")).alias(f"int{i}"),
            F.count_if(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"num{i}"),
            F.count_if(F.lower(c).isin("true", "false")).alias(f"bool{i}"),
        ]
    row = df.agg(*measures).first()
    changes = {}
    for i, n in enumerate(texts):
        present = row[f"n{i}"]
        if present and row[f"int{i}"] == present == row["rows"]:
            changes[n] = strip(quoted(n)).try_cast("long")
        elif present and row[f"num{i}"] == present:
            # Integers with gaps are read as doubles
            changes[n] = strip(quoted(n)).try_cast("double")
        elif present and row[f"bool{i}"] == present == row["rows"]:
            changes[n] = strip(quoted(n)).try_cast("boolean")
    return df.withColumns(changes) if changes else df


_JSON_STRING = r'"(?:[^"\\]|\\.)*"'
# A closing brace before an opening one, outside strings: in valid JSON only between two records.
_BETWEEN_RECORDS = r'\}\s*\{(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)'


def json_layouts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with text: ``file`` and ``layout``, judged by all its lines.

    ``lines``: at least half of the lines are whole records; ``mixed`` if others hold an array of them. Else
    ``array`` or ``objects``, by the first character of the file.
    """
    line = strip(F.regexp_replace("value", "^\ufeff", ""))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"), line.alias("line"),
    ).where(F.length("line") > 0)
    whole = F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}"))
    found = lines.groupBy("file").agg(
        F.count_if(whole).alias("whole"), F.count(F.lit(1)).alias("lines"),
        F.count_if(F.startswith("line", F.lit("["))).alias("arrays"),
        F.min_by(F.substr("line", F.lit(1), F.lit(1)), F.struct("block", "seen")).alias("first"),
    )
    by_line = F.when(F.col("arrays") == 0, "lines").otherwise("mixed")
    layout = F.when(F.col("whole") * 2 >= F.col("lines"), by_line).when(F.col("first") == "[", "array").otherwise("objects")
    return found.select("file", layout.alias("layout"))


def array_records(spark: SparkSession, files: list[str], whole: bool = True) -> DataFrame:
    """(file, place, value): elements of files, or else of lines, with one array each; a broken array as it is."""
    texts = spark.read.text(files, wholetext=whole).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    elements = F.from_json("value", "array<string>")
    parts = F.when(F.startswith(strip(F.col("value")), F.lit("[")) & ~F.exists(elements, lambda p: p.isNull()), elements)
    cut = texts.select("file", F.explode(F.coalesce(parts, F.array("value"))).alias("value"))
    return cut.select("file", F.monotonically_increasing_id().alias("place"), "value")


def object_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, place, value): records of files with objects over several lines, split by bracket depth.

    Depths are summed within each split of a file and carried over from the splits before, so a file is
    not bound to one task. A record that never closes takes the lines up to the file's end.
    """
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = F.split(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), _BETWEEN_RECORDS, "}\n{"), "\n")
    lines = lines.select("file", "block", F.explode(pieces).alias("value")).where(F.length(strip(F.col("value"))) > 0)
    bare = F.regexp_replace("value", _JSON_STRING, "")
    turn = F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))
    # Written: splits and numbers of the lines must come from one read.
    lines = write_table(lines.withColumns({"turn": turn, "seen": F.monotonically_increasing_id()}), "lines")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "block").orderBy("seen")
    sums = lines.groupBy("file", "block").agg(F.sum("turn").alias("sum"))
    carried = sums.select("file", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    depth = F.col("before") + F.sum("turn").over(inside) - F.col("turn")
    starts = lines.join(carried, ["file", "block"]).withColumn("start", F.when(depth <= 0, F.col("seen")))
    last = starts.groupBy("file", "block").agg(F.max("start").alias("start"))
    open_ = last.select("file", "block", F.last("start", ignorenulls=True).over(earlier).alias("open"))
    keyed = starts.join(open_, ["file", "block"]).select(
        "file", "block", "seen", "value", F.coalesce(F.max("start").over(inside), "open").alias("record"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seen", "value"))), lambda x: x["value"]), " ")
    found = keyed.groupBy("file", "record").agg(F.min(F.struct("block", "seen")).alias("at"), joined.alias("value"))
    return found.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("long").alias("place"), "value")


def read_json(
    spark: SparkSession, path: str, multi_line: bool | None = None, flat: bool = True, row_id: str | None = None,
    schema=None, bad: str = "keep", bad_column: str = "bad_record",
) -> DataFrame:
    """JSON records, one per line, as one array or as objects over several lines; nested objects become
    dotted columns. Each file is judged by itself, by all its lines.

    No record is lost. A broken one is a row of nulls with its text in ``bad_column``, which stands last, with
    an inferred schema only where there is one; with ``bad="error"`` it raises, with ``bad="drop"`` it goes. Records that are
    not on lines of their own are written to the scratch folder as lines first. Such files come
    behind the others in the order of rows. A given ``schema`` saves the pass that infers it,
    ``multi_line=False`` the one that judges the lines.
    """
    if bad not in ("keep", "drop", "error"):
        raise ValueError(f"bad must be keep, drop or error, not {bad!r}")
    files: dict[str, list[str]] = {}
    if multi_line is not False:
        # One row per file, as in the file list that Spark itself keeps.
        for r in json_layouts(spark, path).collect():
            files.setdefault(r["layout"], []).append(r["file"])
    paths = [path]
    if set(files) - {"lines"}:
        makers = {"array": array_records, "mixed": partial(array_records, whole=False), "objects": object_records}
        parts = [make(spark, _plain_paths(files[k])) for k, make in makers.items() if k in files]
        folder = scratch_path(spark, "records")
        one_line = F.regexp_replace("value", r"[\r\n]+", " ").alias("value")
        reduce(DataFrame.union, parts).orderBy("file", "place").select(one_line).write.text(folder)
        paths = [*_plain_paths(files.get("lines", [])), folder]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_column}
    # Lines that are arrays are known only where the lines were judged.
    some_bad = schema is not None or multi_line is False
    if schema is None:
        schema = spark.read.options(**options).json(paths).schema
        some_bad = some_bad or bad_column in schema.names
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = [f for f in schema.fields if f.name != bad_column]
    record = F.from_json("value", T.StructType([*fields, T.StructField(bad_column, T.StringType())]), options)
    lines = spark.read.text(paths)
    lines = lines.withColumn("value", F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 1 << 30)).otherwise(F.col("value")))
    read = lines.where(F.length(strip(F.col("value"))) > 0).select(record.alias("r"))
    if row_id:
        read = number_rows([read], row_id)
    df = read.select(*([quoted(row_id)] if row_id else []), *(F.col("r").getField(f.name).alias(f.name) for f in fields), F.col("r").getField(bad_column).alias(bad_column))
    broken = quoted(bad_column).isNotNull()
    if bad == "error" and some_bad:
        first = df.where(broken).select(quoted(bad_column)).first()
        if first:
            raise ValueError(f"broken JSON record: {first[0][:200]}")
    elif bad == "drop":
        df = df.where(~broken)
    if bad != "keep" or not some_bad:
        df = df.drop(bad_column)
    return nan_to_null(flatten(df) if flat else df)


def _leaves(c: Column, dtype: T.DataType, name: str) -> list[Column]:
    if not isinstance(dtype, T.StructType):
        return [c.alias(name)]
    return [leaf for f in dtype.fields for leaf in _leaves(c.getField(f.name), f.dataType, f"{name}.{f.name}")]


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns, at any depth, as one column per leaf named ``a.b``; arrays stay."""
    return df.select(*[leaf for f in df.schema.fields for leaf in _leaves(quoted(f.name), f.dataType, f.name)])


def read_parquet(spark: SparkSession, path: str, row_id: str | None = None, nan_as_null: bool = True) -> DataFrame:
    """Parquet, with NaN as null. ``nan_as_null=False`` suits files without NaN: filters on
    fractional columns then reach the scan too."""
    df = spark.read.parquet(path)
    if row_id:
        df = number_parquet_rows(df, row_id)
    return nan_to_null(df) if nan_as_null else df


# --- source row ids ---------------------------------------------------------------------------

def number_parquet_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Position of every row over all files, from the row index each file already has.

    Only the file level is summed up (one row per file); the data is neither sorted nor
    shuffled while the file table is small enough to broadcast.
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    sizes = df.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index")) \
        .groupBy("__file").agg((F.max("__index") + 1).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
    if len(df.inputFiles()) <= BROADCAST_CHUNKS:
        offsets = F.broadcast(offsets)
    placed = marked.join(offsets, "__file")
    return placed.select(
        (F.col("__before") + F.col("__index")).alias(name), *[quoted(n) for n in df.columns]
    )


def number_rows(frames: list[DataFrame], name: str = "row_id") -> DataFrame:
    """Position of every row of a text-format source (CSV, JSON), in file order over all its frames.

    The rows are written once as Parquet together with their split: how files are split
    may change from job to job, so numbering and data must come from one read.
    """
    parts = [f.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")) for f in frames]
    marked = write_table(reduce(DataFrame.union, parts).withColumn("__seen", F.monotonically_increasing_id()), "rows")
    splits = marked.groupBy("__file", "__block").agg(F.min("__seen").alias("__first"), F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    if splits.count() <= BROADCAST_CHUNKS:
        offsets = F.broadcast(offsets)
    placed = marked.join(offsets, ["__file", "__block"])
    return placed.select(
        (F.col("__before") + F.col("__seen") - F.col("__first")).alias(name), *[quoted(n) for n in frames[0].columns]
    )
