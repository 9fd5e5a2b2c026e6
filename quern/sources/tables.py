"""Scans and sinks: CSV, JSON maps, column aliases, file lookup, caches, manifests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.sources.shared import cut

ID_ALIASES = ["ID", "new_id", "new id", "id", "trapp_id"]
TEXT_ALIASES = ["Target", "text", "label"]
#: What reads as missing in a CSV cell.
MISSING = ["", "NA", "N/A", "NULL", "NaN", "None", "nan", "null"]

#: Rows of a JSON object of a fold cache; a fold has some thousands.
JSON_ENTRIES = 100_000


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a declared schema; the usual missing-value words read as null."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(
        *[F.when(~F.col(f"`{n}`").isin(*MISSING), F.col(f"`{n}`")).alias(n) if kind == "string" else F.col(f"`{n}`") for n, kind in df.dtypes]
    )


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """id, pred of JSON objects of texts, one a file or one a line."""
    whole = spark.read.text(path, wholetext=True)
    objects = whole.select(F.explode(F.split("value", r"(?<=\})\r?\n(?=\{)")).alias("value"))
    return objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "pred"))


def write_json_map(df: DataFrame, path: str, id_: str, text: str, entries: int = JSON_ENTRIES) -> None:
    """Objects of id and stripped text (a fold cache): one if all rows fit into ``entries``, else files of about so many rows each."""
    parts = -(-df.count() // entries) or 1
    rows = df.select(
        F.pmod(F.xxhash64(id_), F.lit(parts)).alias("part"),
        F.struct(F.col(id_).cast("string"), strip(F.coalesce(text, F.lit("")))).alias("entry"),
    )
    objects = rows.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list("entry"))).alias("value"))
    (objects.coalesce(1) if parts == 1 else objects.repartition(parts, "part")).select("value").write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, json_path: str, csv_path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A fold's id, pred: from its JSON cache, else its CSV, else computed and cached."""
    if exists(spark, json_path):
        return read_json_map(spark, json_path)
    if exists(spark, csv_path):
        return read_csv(spark, csv_path, "ID string, Target string").select(F.col("ID").alias("id"), F.coalesce("Target", F.lit("")).alias("pred"))
    write_json_map(compute(), json_path, "id", "pred")
    return read_json_map(spark, json_path)


def resumed(spark: SparkSession, folder: str, compute: dict[int, Callable[[], DataFrame]]) -> DataFrame:
    """fold, id, pred of several folds: those that left a cache or a CSV in ``folder`` are read, and only the others are computed, and cached."""
    every = None
    for fold, run in sorted(compute.items()):
        one = cached(spark, f"{folder}/fold_{fold}_predictions.json", f"{folder}/fold_{fold}.csv", run).select(F.lit(fold).alias("fold"), "id", "pred")
        every = one if every is None else every.union(one)
    return every


def resolve(df: DataFrame) -> DataFrame:
    """id, target under whichever of the known names is there first; blank and "nan" targets are null."""
    pick = lambda names: next(F.col(f"`{n}`") for n in names if n in df.columns)
    text = F.trim(pick(TEXT_ALIASES))
    return df.select(pick(ID_ALIASES).cast("string").alias("id"), F.when((text != "") & (F.lower(text) != "nan"), text).alias("target"))


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def existing(df: DataFrame, name: str, files: DataFrame) -> DataFrame:
    """Rows whose file is listed."""
    return df.join(files.select(F.col("file").alias(name)).distinct(), name, "left_semi")


def resolve_files(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, file of rows (key, name): the file of that very name, else the first in order that begins with it, else null; null names have none.

    Names and files stand in one order, dealt by ranges: the first file at or after a name is the one that begins with it, if any does. Where a range
    holds none after a name, the first file of a later range is carried over; no two rows need a common head to meet.
    """
    part, at, file, kind = "part", "at", "file", "kind"
    both = df.where("name is not null").select(F.col("name").alias(at), F.lit(0).alias(kind)).distinct()
    both = both.union(files.where("file is not null").select(F.col("file").alias(at), F.lit(1).alias(kind)).distinct())
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(both.repartitionByRange(n, at).withColumn(part, F.spark_partition_id()))
    own = F.when(F.col(kind) == 1, F.col(at))
    firsts = dealt.groupBy(part).agg(F.min(own).alias("first"))  # one row a range
    later = firsts.select(part, F.min("first").over(Window.orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    # from the last row back, as a frame that ends with its range is worked out anew for every row
    back = Window.partitionBy(part).orderBy(F.desc(at), F.desc(kind)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.last(own, ignorenulls=True).over(back)
    near = dealt.withColumn("after", after).where(F.col(kind) == 0).join(F.broadcast(later), part)
    near = near.select(at, F.coalesce("after", "later").alias(file)).where(F.col(file).startswith(F.col(at)))
    return df.select(key, F.col("name").alias(at)).join(near, at, "left").select(key, file)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """path, name, modificationTime, newest first; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime").orderBy(F.desc("modificationTime"))


def manifest(df: DataFrame, most: int) -> DataFrame:
    """Lines of a training manifest, at most ``most`` (the sink's own cap), in order of id."""
    return df.where("target is not null").orderBy("id").limit(most).select(F.concat_ws("\t", F.concat("id", F.lit(".png")), "target").alias("value"))


def label_files(df: DataFrame, folder: str, most: int | None = None) -> DataFrame:
    """One text file a row (id, target), named by the id without its suffixes, at most ``most`` in order of id; returns path, id of those written.

    Tasks write through pyarrow's file systems, each file under its own final name, so that a task run again writes the same.
    """
    rows = df.where("id is not null and target is not null and target <> ''")
    rows = rows.orderBy("id").limit(most) if most else rows

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths.append(f"{folder}/{name.split('.')[0]}.gt.txt")
                with system.open_output_stream(f"{base}/{name.split('.')[0]}.gt.txt") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column(0)], ["path", "id"])

    return rows.select(F.col("id").cast("string"), "target").mapInArrow(written, "path string, id string")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Texts (name, text) as files of those names, folders in them included; returns the names written."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield batch.select([0])

    return rows.select("name", "text").mapInArrow(written, "name string")


def read_label_files(spark: SparkSession, folder: str) -> DataFrame:
    """stem, target of the label files of a folder."""
    whole = spark.read.option("pathGlobFilter", "*.gt.txt").text(folder, wholetext=True)
    return whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.gt\.txt$", 1).alias("stem"), F.col("value").alias("target"))


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error that names it if it has no row."""
    if df.isEmpty():
        raise RuntimeError(f"{what} is empty")
    return df


def parse_yaml(text: str) -> dict:
    """Nested maps and lists of scalars by indentation: what configurations are made of. With PyYAML installed, any YAML."""
    try:
        import yaml
    except ImportError:
        return _parsed([(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")])
    return yaml.safe_load(text)


def _parsed(lines: list[tuple[int, str]]):
    if lines and lines[0][1].startswith("- "):
        return [_scalar(x[2:]) for _, x in lines]
    out: dict = {}
    i = 0
    while i < len(lines):
        depth, line = lines[i]
        name, _, value = line.partition(":")
        end = i + 1
        while end < len(lines) and (lines[end][0] > depth or (lines[end][0] == depth and lines[end][1].startswith("- "))):
            end += 1
        out[name.strip()] = _parsed(lines[i + 1 : end]) if end > i + 1 else _scalar(value)
        i = end
    return out


def _scalar(text: str):
    import json

    text = re.sub(r"\s+#.*$", "", text).strip()
    if text[:1] in "\"'" and text[:1] == text[-1:] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    words = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in words:
        return words[text.lower()]
    try:
        return json.loads(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


def flattened(found: object, at: str = "") -> list[tuple[str, str]]:
    """Paths of names joined by points, and the values there as JSON, in order."""
    import json

    if not isinstance(found, dict):
        return [(at[:-1], json.dumps(found))]
    return [pair for name, value in found.items() for pair in flattened(value, f"{at}{name}.")]


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """run, name, value of every run under ``folder``: of its ``<run>.yaml`` (or ``.json``), else of its newest ``<run>/summary*.json``, at the top level there
    or under ``config``. Files are read and parsed where they are found, one row a file; a text that is no configuration raises."""
    import json

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,json}").load(folder)
    path = F.col("path")
    summary = path.rlike(r"/summary[^/]*\.json$")
    run = F.when(summary, F.element_at(F.split(path, "/"), -2)).otherwise(F.regexp_extract(path, r"([^/]+)\.[a-z]+$", 1))
    order = F.struct((~summary).alias("own"), "modificationTime", "path")
    newest = found.groupBy(run.alias("run")).agg(F.max_by(F.struct("path", "content"), order).alias("file"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = file["content"].decode()
                said = json.loads(text) if file["path"].endswith(".json") else parse_yaml(text)
                said = said.get("config", said) if re.search(r"/summary[^/]*\.json$", file["path"]) else said
                rows += [(name, *pair) for pair in flattened(said)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["run", "name", "value"])

    return newest.mapInArrow(parsed, "run string, name string, value string")


def configuration(spark: SparkSession, path: str, folder: str) -> dict:
    """The configuration at ``path`` (YAML or JSON), else that of the newest summary under ``folder``."""
    import json

    if exists(spark, path):
        text = spark.read.text(path, wholetext=True).first()[0]
        return json.loads(text) if path.endswith(".json") else parse_yaml(text)
    return latest_summary(spark, folder)


def latest_summary(spark: SparkSession, folder: str) -> dict:
    """The configuration of the newest summary file, at its top level or under ``config``."""
    import json

    newest = spark.read.format("binaryFile").option("pathGlobFilter", "summary*.json").option("recursiveFileLookup", True).load(folder).orderBy(
        F.desc("modificationTime"),
        F.desc("path"),
    ).limit(1).collect()
    if not newest:
        raise FileNotFoundError(folder)
    found = json.loads(bytes(newest[0].content))
    return found.get("config", found)
