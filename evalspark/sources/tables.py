"""Readers for delimited text, JSON lines, keyed JSON, annotations and file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.functions.text import parent_name, renamed, stem, suffix

COCO_SCHEMA = (
    "images array<struct<id:bigint,file_name:string>>,"
    "annotations array<struct<id:bigint,image_id:bigint,name:string>>"
)

# Value type of the per-video annotation file.
VIDEO_SCHEMA = (
    "struct<annotations:array<struct<label:string,segment:array<double>>>,"
    "taxnomy:array<map<string,string>>,duration:double,resolution:string,fps:int,subset:string,url:string>"
)


def read_table(
    spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", header: bool = True
) -> DataFrame:
    """Delimited text with a declared schema, so no pass over the data is spent on types."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    return reader.option("mode", "FAILFAST").option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keyed_json(
    spark: SparkSession, path: str, value_schema: str, key: str = "id", one_per_line: bool = False
) -> DataFrame:
    """JSON objects from ids to records, one object per file or per line: one row per id.

    A JSON document cannot be split, so one document is one task; several run in parallel.
    """
    text = spark.read.text(path, wholetext=not one_per_line)
    records = F.explode(F.from_json("value", f"map<string,{value_schema}>"))
    return text.select(records.alias(key, "_v")).select(key, "_v.*")


def read_videos(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Video annotations with segments in seconds and the frame size as numbers."""
    from evalspark.functions.text import resolution, segment

    raw = read_keyed_json(spark, path, VIDEO_SCHEMA, "vid_id", one_per_line)
    return raw.select(
        "vid_id",
        F.col("taxnomy").alias("taxonomy"),
        F.transform(
            "annotations",
            lambda a: F.struct(
                a["label"].alias("label"),
                segment(a["segment"])["start_s"].alias("start_s"),
                segment(a["segment"])["end_s"].alias("end_s"),
            ),
        ).alias("annotations"),
        F.col("duration").alias("duration_s"),
        resolution(F.col("resolution")).alias("resolution"),
        "fps",
        "subset",
        "url",
    )


def read_coco(spark: SparkSession, path: str, strict: bool = True, one_per_line: bool = False) -> DataFrame:
    """Images with the name of their only annotation: ``(img_id, file_name, label)``.

    An image with no or several annotations fails the job, or is kept with a null
    label and its count when not strict.
    """
    doc = spark.read.schema(COCO_SCHEMA).option("multiLine", not one_per_line).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.id", "i.file_name")
    notes = doc.select(F.explode("annotations").alias("a")).groupBy(F.col("a.image_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("a.name").alias("name")
    )
    joined = images.join(notes, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.when(F.col("n") == 1, F.col("name"))
    if strict:
        problem = F.concat(F.lit("image "), F.col("id").cast("string"), F.lit(" does not have exactly one annotation"))
        one = one.otherwise(F.raise_error(problem).cast("string"))
    out = joined.select(F.col("id").cast("string").alias("img_id"), "file_name", one.alias("label"), "n")
    return out.drop("n") if strict else out


def example_paths(df: DataFrame, path: Column) -> DataFrame:
    """Id (file stem), class (folder) and extension of each path."""
    return df.withColumns({"img_id": stem(path), "label": parent_name(path), "suffix": suffix(path)})


def scan_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder: ``(path, img_id, label, suffix, length)``.

    File contents are not read unless a later step asks for them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return example_paths(files.load(root).select("path", "length"), F.col("path"))


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files with their content: ``(name, content)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return files.load(root).select(name.alias("name"), "content")


def read_bytes_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with their overall row number ``index`` (files in name order).

    The number is the file's offset plus the row's place in the file, so no sort is needed.
    """
    rows = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")
    files = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    numbered = rows.join(files, "file_path").withColumn("index", F.col("_off") + F.col("row_index"))
    return numbered.drop("file_path", "row_index", "_off")


def read_wide_results(
    spark: SparkSession, path: str, schema: str | StructType, drop: list[str], rename: dict[str, str],
    names: dict[str, str], model: str = "Model", mean: str = "Mean",
) -> DataFrame:
    """Wide results file as a leaderboard: drop and rename columns, map names, best first."""
    wide = read_table(spark, path, schema).drop(*drop).withColumnsRenamed(rename)
    return wide.withColumn(model, renamed(F.col(model), names)).orderBy(F.desc(mean), model)
