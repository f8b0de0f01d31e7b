"""File sources with declared schemas, and rules about file names.

Readers never infer a schema from data. Malformed JSON lines become rows of nulls with the raw text in
``_corrupt_record``; a missing path raises. Paths may be directories, globs or lists and on any file system Spark knows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.jsonfix import listed, wrapped

CHARTS = "id string, chart string, text string"
TEXTS = "id string, text string"
PATHS = "center_id string, center string, paths array<array<struct<from_id:string,to_id:string,type:string,source:string,key:string>>>, sources array<string>"
TASKS = "query string, answer string, gt_sources string, start_candidates string, gt_entities string"


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(paths)


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One or several parquet tables as one; columns that a file lacks are null."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select(*columns) if columns else df


def arrow_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A data set saved as Arrow stream files, read by one task per file. Files must share a schema."""
    import glob

    import pyarrow as pa

    files = sorted(glob.glob(f"{path}/*.arrow"))
    if not files:
        raise FileNotFoundError(path)
    with pa.memory_map(files[0]) as source:
        schema = pa.ipc.open_stream(source).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def scan(batches):
        for b in batches:
            for f in b.column(0).to_pylist():
                with pa.memory_map(f) as source:
                    yield from pa.ipc.open_stream(source)

    return spark.createDataFrame([(f,) for f in files], "f string").repartition(len(files)).mapInArrow(scan, from_arrow_schema(schema))


def whole_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_text(text: Column) -> Column:
    """The strings of a JSON object or list, one per line, without values of other types; a JSON string's content; any other text
    as it stands."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    strings = lambda xs: F.transform(F.filter(xs, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    of_map = strings(F.map_values(F.from_json(body, "map<string,variant>")))
    of_list = strings(F.from_json(body, "array<variant>"))
    single = F.when(body.startswith('"'), F.try_variant_get(F.try_parse_json(body), "$", "string"))
    return F.coalesce(F.when(body.startswith("{"), F.array_join(of_map, "\n")), F.when(body.startswith("["), F.array_join(of_list, "\n")), single, text)


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpg|jpeg|gif|bmp)$")


def is_text(path: Column) -> Column:
    return F.lower(path).rlike(r"\.txt$")


def is_json(path: Column) -> Column:
    return F.lower(path).rlike(r"\.json$")


def mime_type(path: Column) -> Column:
    kind = F.regexp_extract(F.lower(path), r"\.(\w+)$", 1)
    return F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").when(kind == "", "png").otherwise(kind))


def data_url(path: Column, content: Column) -> Column:
    """A base64 data URL; addresses that are one already pass through."""
    ready = path.rlike(r"^(https?:|data:)")
    return F.when(ready, path).otherwise(F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", "")))


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, url): image files as data URLs."""
    return spark.read.format("binaryFile").load(paths).select("path", data_url(F.col("path"), F.col("content")).alias("url"))


def task_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Task files with quoted fields over several lines; a column that a file lacks is null."""
    schema = T._parse_datatype_string(TASKS)
    df = spark.read.csv(paths, header=True, multiLine=True, quote='"', escape='"')
    return task_columns(df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in schema.fields]))


def task_columns(df: DataFrame) -> DataFrame:
    """``gt_sources`` (JSON array or comma list) and ``start_candidates`` (name or JSON list) as arrays, empty for null."""
    none = F.array().cast("array<string>")
    out = df.withColumn("gt_sources", F.coalesce(listed(F.col("gt_sources")), none)).withColumn("start_candidates", wrapped(F.col("start_candidates")))
    return out.withColumn("gt_entities", F.coalesce(listed(F.col("gt_entities")), none)) if "gt_entities" in df.columns else out


def run_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a dump directory with ``step`` from each file's name."""
    rows = json_lines(spark, folder, schema)
    return rows.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("int"))


def rollouts(spark: SparkSession, folder: str, mask: str = "") -> DataFrame:
    """(step, index, fields): every line of the JSON-lines files of a dump directory, whose names are steps.

    ``fields`` maps names to texts: strings with what the regular expression ``mask`` matches replaced by ``*``, other values
    as JSON. ``index`` counts a file's lines from 0; blank and broken lines are left out.
    """
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.withColumn("v", F.from_json("value", "map<string,variant>")).where("v is not null")
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1
    as_string = lambda x: F.try_variant_get(x, "$", "string")
    shown = lambda k, x: F.when(F.schema_of_variant(x) == "STRING", F.regexp_replace(as_string(x), mask, "*") if mask else as_string(x)).otherwise(F.to_json(x))
    return rows.select(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("step"), place.alias("index"), F.transform_values("v", shown).alias("fields"))


def prompt_templates(text: str) -> dict[str, str]:
    """The templates of a YAML document, nested names joined by dots."""
    import yaml  # optional dependency

    def walk(node: object, name: str) -> dict[str, str]:
        if isinstance(node, dict):
            return {k: t for key, x in node.items() for k, t in walk(x, f"{name}.{key}" if name else str(key)).items()}
        return {name: str(node)}

    return walk(yaml.safe_load(text) or {}, "")


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled; doubled braces stand for themselves, a null value for an empty text, and a
    place without a value raises."""
    parts = []
    for literal, name, *_ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in values:
                raise KeyError(name)
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def environments(spark: SparkSession, text: str) -> DataFrame:
    """(name, data_source, n_envs, max_turns): the list ``envs`` of a YAML document."""
    import yaml  # optional dependency

    rows = [(e.get("name"), e.get("data_source"), e.get("n_envs"), e.get("max_turns")) for e in yaml.safe_load(text).get("envs", [])]
    return spark.createDataFrame(rows, "name string, data_source string, n_envs int, max_turns int")


def expanded_seeds(specs: DataFrame) -> DataFrame:
    """(name, seed): specs (name, n_envs, seed array) with one seed repeated, a range from two, a stepped range from
    three; at most ``n_envs`` each."""
    s, n = F.col("seed"), F.col("n_envs")
    seeds = (
        F.when(F.size(s) == 1, F.array_repeat(F.get(s, 0), n))
        .when(F.size(s) == 2, F.sequence(F.get(s, 0), F.get(s, 1) - 1))
        .when(F.size(s) == 3, F.sequence(F.get(s, 0), F.get(s, 1) - 1, F.get(s, 2)))
    )
    return specs.select("name", F.explode(F.slice(seeds, F.lit(1), n)).alias("seed"))


def cache_key(path: str) -> str:
    """Name of a local copy of a remote path."""
    import hashlib

    return hashlib.md5(path.encode()).hexdigest() + "/" + path.rstrip("/").rsplit("/", 1)[-1]


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct columns opened, recursively, into columns ``a/b``; other columns stay."""
    out = []

    def walk(column: Column, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f"{name}{sep}{f.name}", f.dataType)
        else:
            out.append(column.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out)


class Retrieval:
    """Batch client for a search service. ``post`` takes a list of queries and returns a list of results; it is called
    per Arrow batch, with ``retries`` further tries after errors and a growing pause; a batch that fails gives nulls."""

    def __init__(self, post, retries: int = 3, pause: float = 0.5):
        self.post, self.retries, self.pause = post, retries, pause

    def __call__(self, df: DataFrame, query: str) -> DataFrame:
        import time

        def run(batches):
            for b in batches:
                found = None
                for k in range(self.retries + 1):
                    try:
                        found = self.post(b[query].tolist())
                        break
                    except OSError:
                        time.sleep(self.pause * (k + 1))
                yield b.assign(result=found if found is not None else [None] * len(b))

        schema = T.StructType([*df.schema.fields, T.StructField("result", T.StringType())])
        return df.mapInPandas(run, schema)
