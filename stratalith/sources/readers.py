"""Readers with explicit schemas. Each gives a DataFrame; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_no, number, text_id
from ..functions.years import interval

MATCH = "root_segnr array<string>, par_segnr array<string>, root_segtext array<string>, par_segtext array<string>, score double, root_length int, par_length int"
SEGMENTS = "array<struct<original:string,analyzed:string,full_analysis:array<struct<lemma:string,tag:string>>>>"
CONSTRAINT = "type string, arg1 string, arg2 string, arg3 string, note string"
WORK_INFO = "work_id string, title string, author string, tradition string, genre string, date_estimate string, summary string, history string, related_works array<string>, confidence string, sources array<string>"


def matches(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """Match events, a JSON object per line, plain or gzip. Blank and malformed lines go, or are kept in ``bad``.

    A file that breaks off keeps the rows before the break. A gzip file is one task: many files, not large ones.
    """
    # Broken lines are told apart from good ones by parsing, so that both outcomes come from one scan.
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_name"))
    parsed = lines.select("file", F.col("value").alias("bad"), F.from_json("value", MATCH + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    good = F.col("m._corrupt_record").isNull()
    if keep_bad:
        return parsed.select("file", "m.*", F.when(~good, F.col("bad")).alias("bad")).drop("_corrupt_record")
    return parsed.where(good).select("file", "m.*").drop("_corrupt_record")


def match_endpoints(matches: DataFrame) -> DataFrame:
    """root, par (text ids of the first segments), score, root_len, par_len; events without segments on a side go."""
    some = matches.where((F.size("root_segnr") > 0) & (F.size("par_segnr") > 0))
    return some.select(
        text_id(F.element_at("root_segnr", 1)).alias("root"),
        text_id(F.element_at("par_segnr", 1)).alias("par"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("root_length", F.lit(0)).alias("root_len"),
        F.coalesce("par_length", F.lit(0)).alias("par_len"),
    )


def _marked(side: int):
    return lambda s, pos: F.struct(F.lit(side).alias("side"), pos.alias("pos"), s.id.alias("id"), s.text.alias("text"))


def matched_segments(matches: DataFrame) -> DataFrame:
    """text, line, seg_text, and the place (file, side, pos) of every segment of either side; a side stops at its shorter array."""
    both = []
    for side, ids, texts in ((0, "root_segnr", "root_segtext"), (1, "par_segnr", "par_segtext")):
        n = F.greatest(F.least(F.size(ids), F.size(texts)), F.lit(0))
        zipped = F.slice(F.zip_with(ids, texts, lambda i, t: F.struct(i.alias("id"), t.alias("text"))), F.lit(1), n)
        whole = F.transform(zipped, _marked(side))
        both.append(F.coalesce(whole, F.array().cast("array<struct<side:int,pos:int,id:string,text:string>>")))
    # Both sides come out of one row, so the files are read and parsed once.
    rows = matches.select("file", F.explode(F.concat(*both)).alias("s"))
    return rows.select(text_id(F.col("s.id")).alias("text"), line_no(F.col("s.id")).alias("line"), F.col("s.text").alias("seg_text"), "file", "s.side", "s.pos")


def segments(spark: SparkSession, path: str, exclude_suffix: str = "_analyzed.json", probe: int = 80) -> DataFrame:
    """text, ord, original, analyzed, full_analysis: a row per element of each file's JSON array, in order.

    Files with the suffix are left out, and those with no analysis among their first ``probe`` elements (0: none).
    """
    files = spark.read.text(path, wholetext=True).where(~F.endswith(F.col("_metadata.file_name"), F.lit(exclude_suffix)))
    parsed = files.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("text"), F.from_json("value", SEGMENTS).alias("segs"))
    if probe:
        parsed = parsed.where(F.exists(F.slice("segs", 1, probe), lambda s: F.coalesce(F.size(s.full_analysis) > 0, F.lit(False))))
    return parsed.select("text", F.posexplode("segs").alias("ord", "s")).select("text", "ord", "s.*")


def tsv(spark: SparkSession, path, schema: str, quoted: bool = False) -> DataFrame:
    """Table with a header, by tabs; quotes are data unless ``quoted``."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"' if quoted else "", mode="PERMISSIVE")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """work, title, author, nb, na from the quoted metadata table; rows without a work go; reversed dates change places."""
    raw = tsv(spark, path, "work string, title string, author string, nb string, na string", quoted=True).where(F.trim("work") != "")
    dates = interval(number(F.col("nb")), number(F.col("na")))
    return raw.select(F.trim("work").alias("work"), "title", "author", F.coalesce(dates.lo, number(F.col("nb"))).alias("nb"), F.coalesce(dates.hi, number(F.col("na"))).alias("na"))


def constraints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Typed constraint rows of the files that exist, with src (place in the list) and line; short rows are padded, blank lines go."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for k, path in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
            cells = F.split(F.concat("value", F.lit("\t\t\t\t")), "\t")
            rows = lines.where((F.col("line") > 0) & (F.trim("value") != ""))
            there.append(rows.select(F.lit(k).alias("src"), "line", *[cells[i].alias(c) for i, c in enumerate(("type", "arg1", "arg2", "arg3", "note"))]))
    if not there:
        return spark.createDataFrame([], "src int, line int, " + CONSTRAINT)
    return reduce(DataFrame.unionByName, there)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and the fields of the values of one JSON object; ``value``: their struct."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return raw.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def work_info(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions of works from files that hold JSON lists; of rows with one id the first by title stays."""
    rows = spark.read.option("multiLine", True).schema(WORK_INFO).json(path)
    return rows.groupBy("work_id").agg(F.min_by(F.struct(*rows.columns), F.struct("title", "author", "summary")).alias("r")).select("r.*")


def names(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """What a pattern's groups find in the names of files; the files are not read. ``path`` may be a glob."""
    listed = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return listed.where(F.col("name").rlike(pattern)).select("name", *[F.regexp_extract("name", pattern, i + 1).alias(c) for i, c in enumerate(columns)])


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet exported as CSV."""
    return spark.read.schema(schema).csv(path, header=True)
