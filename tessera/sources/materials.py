"""Files of a submission: classes, counts, roots of tables, lanes, repositories, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File classes by extension, and words of a path that tell of data.
CLASSES = {
    "structured_table_xlsx": ("xlsx", "xlsm"),
    "structured_table_text": ("csv", "tsv"),
    "raw_data": ("rds", "rda", "rdata", "h5", "hdf5", "loom", "mtx"),
    "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"),
    "archive": ("zip", "tar", "gz", "tgz", "7z", "rar"),
    "pdf_supplement": ("pdf",),
}
HINTS = ("source data", "source_data", "source-data", "supplement", "supplementary", "data", "raw")
TABLES = ("xlsx", "xlsm", "xls", "csv", "tsv")
UNSUPPORTED = ("structured_table_text", "raw_data", "archive")
#: Names that a repository's parts end with.
REPOSITORY = {"entrypoint": ("py", "R"), "config": ("yml", "yaml", "json"), "result": ("csv", "tsv")}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def first_pdf(files: DataFrame) -> str:
    """The first PDF by name in the top folder of files(relative_path); an error if none."""
    row = files.where(~F.col("relative_path").contains("/") & (F.lower("relative_path").endswith(".pdf"))).agg(F.min("relative_path").alias("p")).first()
    if row["p"] is None:
        raise FileNotFoundError("no PDF in the folder")
    return row["p"]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, size_bytes) of all files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    return files.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "").alias("relative_path"), F.col("length").alias("size_bytes"))


def inventory(files: DataFrame, paper: str | None = None) -> DataFrame:
    """files(relative_path, size_bytes) without the paper, with extension, class, directory."""
    path = F.col("relative_path")
    ext, near = extension(path), F.lower(F.array_join(F.slice(F.reverse(F.split(path, "/")), 1, 4), " "))
    kind = F.coalesce(*[F.when(ext.isin(*e), k) for k, e in CLASSES.items()], F.when(near.rlike("|".join(HINTS)), "possible_data_artifact"), F.lit("other"))
    kept = files.where(path != paper) if paper is not None else files
    return kept.select("relative_path", "size_bytes", ext.alias("extension"), kind.alias("material_type"), F.regexp_replace(path, "/?[^/]*$", "").alias("directory"))


def counts(found: DataFrame) -> DataFrame:
    """(counted, key, n_files) by extension and by class."""
    by = lambda name, c: found.groupBy(c.alias("key")).agg(F.count("*").alias("n_files")).select(F.lit(name).alias("counted"), "key", "n_files")
    return by("extension", F.when(F.col("extension") == "", "<none>").otherwise(F.col("extension"))).unionByName(by("material_type", F.col("material_type")))


def hint_score(directory: Column) -> Column:
    """Two for each hint of source data in the path, one for each other hint."""
    text = F.lower(F.regexp_replace(directory, "/", " "))
    return sum((F.when(text.contains(h), 2 if h.startswith("source") else 1).otherwise(0) for h in HINTS), F.lit(0))


def candidate_roots(found: DataFrame, samples: int = 12) -> DataFrame:
    """Directories with tables, best first: files, executable, confidence, sample files."""
    tables = found.where(F.col("extension").isin(*TABLES))
    agg = tables.groupBy("directory").agg(F.count("*").alias("file_count"), F.count_if(F.col("extension").isin(*CLASSES["structured_table_xlsx"])).alias("xlsx_count"), F.count_if(F.col("extension").isin("csv", "tsv")).alias("csv_tsv_count"),
                                          F.array_join(F.slice(F.array_sort(F.collect_list("relative_path")), 1, samples), ",").alias("sample_files"))
    executable = F.col("xlsx_count") > 0
    confidence = F.when(executable & (hint_score(F.col("directory")) >= 2), "high").when(executable, "medium").otherwise("low")
    out = agg.select("*", executable.alias("executable"), confidence.alias("confidence"))
    order = [F.desc("executable"), F.coalesce(*[F.when(F.col("confidence") == c, i) for i, c in enumerate(("high", "medium", "low"))]), F.desc("file_count"), "directory"]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # a row a directory


def lane(roots: DataFrame) -> DataFrame:
    """One row: the first executable root is selected, or the material is missing."""
    first = roots.where("executable").agg(F.min_by("directory", "place").alias("root"))
    return first.select(F.lit("source_data_xlsx").alias("lane_id"), F.when(F.col("root").isNull(), "missing_material").otherwise("selected").alias("status"), "root")


def contained(root: str, folder: str) -> bool:
    """Does a root, relative to a folder or absolute, lie inside it?"""
    import posixpath

    whole = posixpath.normpath(posixpath.join(folder, root))
    return whole == posixpath.normpath(folder) or whole.startswith(posixpath.normpath(folder).rstrip("/") + "/")


def unsupported(found: DataFrame, most: int = 80) -> DataFrame:
    return found.where(F.col("material_type").isin(*UNSUPPORTED)).orderBy("relative_path").limit(most).select("relative_path", "material_type")


def repository(files: DataFrame, most: int = 20) -> DataFrame:
    """One row: file count and the first candidates for entry points, settings and results."""
    pick = lambda names: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("relative_path").rlike(rf"\.(?:{'|'.join(names)})$"), F.col("relative_path")))), 1, most), ",")
    return files.agg(F.count("*").alias("file_count"), *[pick(n).alias(f"{k}_candidates") for k, n in REPOSITORY.items()])


def best_markdown(files: DataFrame) -> str | None:
    """``full.md`` at the top, else the first one by path, else the first Markdown file."""
    rank = F.when(F.col("relative_path") == "full.md", 0).when(F.col("relative_path").endswith("/full.md"), 1).otherwise(2)
    row = files.where(F.col("relative_path").endswith(".md")).agg(F.min(F.struct(rank.alias("r"), "relative_path"))["relative_path"].alias("p")).first()
    return row["p"]


def cases(spark: SparkSession, root: str, schema: str = "case_id string, title string, status string") -> DataFrame:
    """Rows of ``*/case.json`` below a folder, with the case's folder."""
    found = spark.read.option("multiLine", True).option("pathGlobFilter", "case.json").option("recursiveFileLookup", True).schema(schema).json(root)
    return found.withColumn("folder", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))


def artifact_index(files: DataFrame, known: DataFrame) -> DataFrame:
    """known(artifact_id, kind, file_name) with whether the file exists and its size."""
    there = files.select(F.col("relative_path").alias("file_name"), "size_bytes")
    return known.join(there, "file_name", "left").select("artifact_id", "kind", "file_name", F.col("size_bytes").isNotNull().alias("exists"), "size_bytes")
