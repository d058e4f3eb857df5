"""Series from many files, and tables to files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.cells import is_true
from tallyfold.functions.dates import guess_format, parse_time
from tallyfold.functions.text import file_name, proper_name
from tallyfold.operators.align import merge_into
from tallyfold.sources.storage import discard, scratch


def list_files(spark: SparkSession, folder: str, extension: str | None = None, recursive: bool = True, only: list[str] | None = None, never: list[str] | None = None, skip_containing: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """(path, name, size) of a folder's files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension}")
    d = reader.load(folder).select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"))
    if only:
        d = d.filter(F.col("name").isin(only))
    if never:
        d = d.filter(~F.col("name").isin(never))
    for part in skip_containing or []:
        d = d.filter(~F.contains(F.col("path"), F.lit(part)))
    return d if keep_empty else d.filter("size > 0")


def read_series(
    spark: SparkSession, paths: list[str] | str, columns: list[str], separator: str = ",", encoding: str | list[str] = "UTF-8", trim: bool = True, recursive: bool = False, glob: str = "*.csv", header: bool | None = None
) -> DataFrame:
    """(the named columns as text, path, number) of CSV files; number orders the lines of a file.

    header: whether the first line of each file is one; by default it is if its second field is text that is no number.
    No other line is dropped. Of several encodings a file is read by the first that leaves no character unreadable, the
    last one at worst; each costs one more pass. GBK needs spark.sql.legacy.javaCharsets=true in the session.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)

    def lines(name: str) -> DataFrame:
        reader = spark.read.schema(schema).option("sep", separator).option("encoding", name).option("ignoreLeadingWhiteSpace", str(trim).lower())
        reader = reader.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
        place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("number")]
        return reader.csv(paths).select("*", *place)

    tried = [encoding] if isinstance(encoding, str) else list(encoding)
    done, left = [], None
    for k, name in enumerate(tried):
        d = lines(name) if left is None else lines(name).join(left, "path", "left_semi")
        if k < len(tried) - 1:
            odd = F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), lambda x: F.contains(x, F.lit("\ufffd")))
            left = d.filter(odd).select("path").distinct()
            d = d.join(left, "path", "left_anti")
        done.append(d.select(*columns, "path", "_block", "number"))
    d = reduce(DataFrame.unionByName, done)
    if header is False:
        return d.drop("_block")
    first = d.filter("_block = 0").groupBy("path").agg(F.min("number").alias("number")).withColumn("_first", F.lit(True))  # a row for each file
    second = F.trim(columns[min(1, len(columns) - 1)])
    text = F.lit(True) if header else is_true((second != "") & second.try_cast("double").isNull())
    return d.join(first, ["path", "number"], "left").filter(~(is_true(F.col("_first")) & text)).select(*columns, "path", "number")


def series_names(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, series_id): the file's name; where names repeat, with its whole folder below the one common to all, parts joined by _."""
    d = files.select(F.col(path).alias("path")).distinct().withColumn("_name", proper_name(F.col("path")))
    parts = lambda x: F.slice(F.split(x, "/"), 1, F.size(F.split(x, "/")) - 1)
    ends = d.agg(F.min("path").alias("_a"), F.max("path").alias("_z")).select(parts("_a").alias("_a"), parts("_z").alias("_z"))  # one row
    same = F.aggregate(F.sequence(F.lit(0), F.size("_a")), F.lit(0), lambda n, i: F.when((n == i) & is_true(F.get("_a", i) == F.get("_z", i)), n + 1).otherwise(n))
    many = d.groupBy("_name").count().filter("count > 1").select("_name", F.lit(True).alias("_many"))
    d = d.join(many, "_name", "left").crossJoin(F.broadcast(ends.select(same.alias("_same"))))
    below = F.slice(F.split("path", "/"), F.col("_same") + 1, F.size(F.split("path", "/")) - F.col("_same") - 1)
    return d.select("path", F.when(F.col("_many"), F.concat_ws("_", below, "_name")).otherwise(F.col("_name")).alias("series_id"))


def parse_series(raw: DataFrame, time: str, values: list[str], kind: str | Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """(series_id, time, field, value): times parsed by the given format, or by the one guessed from each file's first value. names: (path, series_id), by default series_names."""
    first = raw.filter(F.col(time).isNotNull()).groupBy("path").agg(F.min_by(time, "number").alias("_sample"))
    names = series_names(raw) if names is None else names
    known = names.join(first, "path", "left").select("path", "series_id", (guess_format(F.col("_sample")) if kind is None else F.lit(kind)).alias("_kind"))
    d = raw.join(known, "path")
    parsed = d.select("series_id", parse_time(F.col(time), F.col("_kind")).alias("time"), *[F.trim(F.col(v)).try_cast("double").alias(v) for v in values])
    return parsed.unpivot(["series_id", "time"], values, "field", "value")


def one_frame(parsed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(time, and a column for each series and field) of (series_id, time, field, value); of values at one time the largest counts.

    Columns are called by series where there is one field, by field where there is one series, else series_field. Names
    that are not given are looked up, Spark's spark.sql.pivotMaxValues of them at most.
    """
    if names is None:
        n = parsed.agg(F.countDistinct("series_id"), F.countDistinct("field")).first()
        name = F.col("series_id") if n[1] == 1 else F.col("field") if n[0] == 1 else F.concat_ws("_", "series_id", "field")
    else:
        name = F.concat_ws("_", "series_id", "field")
    return parsed.select("time", name.alias("_name"), "value").groupBy("time").pivot("_name", names).agg(F.max("value"))


def write_csv(df: DataFrame, path: str, header: bool = True, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", str(header).lower()).option("encoding", encoding).csv(path)


def write_results(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def wide_results(df: DataFrame, index: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """(index, and a column for each of the names): results in wide form; what is not there is missing."""
    return df.groupBy(*index).pivot(name, names).agg(F.first(value))


def upsert(new: DataFrame, path: str, time: str = "time", period: str = "month") -> list:
    """Put new values (series_id, time, value) over those stored at the path, which is made if it does not exist; the periods that were written anew.

    The store is divided by period of time. Only periods that the new data touch are read and written: merged aside
    first, then put in their places, so that what fails on the way can be run again and gives the same. Duplicates on
    either side raise. Files of other periods stay as they are.
    """
    spark = new.sparkSession
    place = F.date_format(F.trunc(F.col(time), period), "yyyy-MM-dd").alias("period")
    touched = [r["period"] for r in new.select(place).distinct().collect()]  # a calendar's periods, not rows
    store, aside = spark._jvm.org.apache.hadoop.fs.Path(path), scratch(spark, "upsert")
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)
    old = None
    if there:
        kept = spark.read.parquet(path)
        old = kept.filter(kept["period"].cast("string").isin(touched)).select("series_id", F.col(time).alias("time"), "value")
    merge_into(new.select("series_id", F.col(time).alias("time"), "value"), old).withColumnRenamed("time", time).select("*", place).write.parquet(aside)
    spark.read.schema(spark.read.parquet(aside).schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    discard(spark, aside)
    return sorted(touched, key=str)


def as_map(df: DataFrame, key: str, value: str, by: str | None = None) -> DataFrame:
    """The lookup as a map: in one row, for tables small enough to be one value, or (by, lookup) in one for each value of a column."""
    lookup = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("lookup")
    return df.groupBy(by).agg(lookup) if by else df.agg(lookup)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, sha1) of each file's contents; a file is one value, and so has 2 GB at most."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return d.select("path", file_name(F.col("path")).alias("name"), F.sha1("content").alias("sha1"))
