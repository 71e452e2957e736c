"""Readers and writers: JSON arrays and lines (plain or gzip), journals, Parquet, digest-keyed tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

#: Seconds after which a lock is of a driver that died.
STALE = 86_400.0
MEMORY = "struct<memory_id:string,memory_text:string,gold_policy:string,gold_score:double>"
SAMPLE = f"source string, sample_id string, query string, context string, memories array<{MEMORY}>, metadata map<string,string>"
PREDICTION = "uid string, sample_id string, memory_id string, split string, coefficient double, policy string"
JOURNAL = "key string, sample_id string, kind string, memory_id string, status string, judge_result string, raw string, time double"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines, or arrays that begin with '[', which are read in splits as lines are; .gz by suffix. The first
    non-blank character decides; an empty file has no rows; a bad record is an error."""
    if arrays.is_array(spark, path):
        return arrays.read_array(spark, path, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """uids of finished rows; blank and broken lines are passed over, and where nothing is written yet there are none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "uid string")
    rows = spark.read.schema("uid string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("uid is not null").select("uid").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (1..), value of the lines that aren't empty. Files are read in splits: a line's number is its place
    in its split and the lines of the file's splits before that."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_at")
    lines = spark.read.text(path).select(place, "value").withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_at.file").orderBy("_at.start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.join(starts, "_at").withColumn("line", (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int"))
    return numbered.where("value <> ''").select(F.col("_at.file").alias("file"), "line", "value")


def read_journal(spark: SparkSession, path: str, skipped: DataFrame | None = None, schema: str = JOURNAL, strict: bool = False) -> DataFrame:
    """Journal rows with their line numbers, without the skipped lines, recovery markers and broken lines.
    skipped: (file, line), or (line) for a journal of one file. With strict a broken line is an error, unless
    it is the last one of its file: that one may be torn."""
    rows = numbered_lines(spark, path)
    if skipped is not None:
        if "file" not in skipped.columns and rows.select("file").distinct().limit(2).count() > 1:
            raise ValueError("lines to skip in several files need the file's name")
        rows = rows.join(skipped, [c for c in ("file", "line") if c in skipped.columns], "left_anti")
    bad = "_bad string"
    parsed = rows.withColumn("r", F.from_json("value", f"{schema}, _journal_recovery boolean, {bad}", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    kept = F.expr("r._bad is null and r.key is not null and not coalesce(r._journal_recovery, false)")
    if strict:  # one condition, so that no part of it is tried before the other
        last = rows.groupBy("file").agg(F.max("line").alias("_last"))
        fault = F.raise_error(F.concat(F.lit("broken line "), F.col("line").cast("string"))).cast("boolean")
        parsed = parsed.join(last, "file")
        kept = F.when(F.col("r._bad").isNotNull() & (F.col("line") < F.col("_last")), fault).otherwise(kept)
    return parsed.where(kept).select("line", "r.*").drop("_journal_recovery", "_bad")


def torn_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line of the last lines that are no JSON: what a recovery sidecar has to name."""
    rows = numbered_lines(spark, path)
    last = rows.groupBy("file").agg(F.max_by(F.struct("line", "value"), "line").alias("x")).select("file", "x.*")
    return last.where(F.try_parse_json("value").isNull()).select("file", "line")


def read_predictions(flat: DataFrame, nested: DataFrame) -> DataFrame:
    """Flat rows and exploded nested rows (sample_id, predictions); of equal uids the later one stays."""
    more = nested.select("sample_id", F.explode("predictions").alias("p")).select("sample_id", "p.memory_id", "p.policy")
    both = flat.select("sample_id", "memory_id", "policy", F.lit(0).alias("turn")).unionByName(more.withColumn("turn", F.lit(1)))
    return both.groupBy("sample_id", "memory_id").agg(F.max_by("policy", "turn").alias("policy")).withColumn("uid", F.concat_ws("::", "sample_id", "memory_id"))


def read_benchmark(spark: SparkSession, path: str, schema: str, kind: str, kept: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """A JSON object whose field `kind` is a list: rows with ids made of a prefix, the kind and the position."""
    out = arrays.read_field(spark, path, kind, schema).select(F.format_string(f"{prefix}{kind}_%04d", "pos").alias("sample_id"), "pos", "r.*")
    return out if kept is None else out.join(kept, "sample_id", "left_semi")


def instruction_pool(config: DataFrame, fallback: DataFrame) -> DataFrame:
    """level, instructions: the non-blank ones of a config (level, instructions), else the fallback's."""
    own = config.select("level", F.filter("instructions", lambda x: F.trim(x) != "").alias("own"))
    both = fallback.select("level", F.col("instructions").alias("other")).join(own, "level", "full")
    return both.select("level", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("other")).alias("instructions"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Appends files to a folder; the commit protocol leaves no torn tail."""
    df.write.mode("append").json(path)


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    return hashlib.sha256(str(tuple(df.agg(F.count("*"), half(1), half(13), half(25)).first())).encode()).hexdigest()


def write_once(df: DataFrame, path: str, spark: SparkSession) -> bool:
    """Writes a new table; the same rows again are no change; other rows are an error."""
    if exists(spark, path):
        if content_digest(spark.read.parquet(path)) != content_digest(df):
            raise ValueError(f"{path} holds other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def contract_digest(contract: dict) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, contract: dict, make, stale: float = STALE) -> DataFrame:
    """make() as a table under the contract's digest: made once, read afterwards.

    A lock file that only one writer can create guards the work; the table is written aside and renamed when it is
    whole, the contract beside it, which is compared on reading. The lock names its owner and the time; one older than
    stale seconds is of a driver that died, and whoever renames it away takes its place."""
    path = f"{folder}/{contract_digest(contract)}"
    fs, at = _hadoop(spark, path)
    if not fs.exists(at(path)):
        _lock(spark, f"{path}.lock", stale)
        try:
            if not fs.exists(at(path)):
                aside = f"{path}.{uuid.uuid4().hex}"
                make().write.parquet(f"{aside}/rows")
                spark.createDataFrame([(json.dumps(contract, sort_keys=True, ensure_ascii=False),)], "contract string").coalesce(1).write.json(f"{aside}/contract")
                if not fs.rename(at(aside), at(path)):
                    raise OSError(f"{path} can't be put in place")
        finally:
            fs.delete(at(f"{path}.lock"), False)
    held = spark.read.schema("contract string").json(f"{path}/contract").first()
    if held is None or json.loads(held["contract"]) != json.loads(json.dumps(contract)):
        raise ValueError(f"{path} was made under another contract")
    return spark.read.parquet(f"{path}/rows")


def _hadoop(spark: SparkSession, path: str):
    """The file system of path, and what makes a path of a text."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with text; False if it is there already. Of several writers one succeeds."""
    fs, at = _hadoop(spark, path)
    try:
        out = fs.create(at(path), False)
    except Exception as e:  # a Java exception
        if fs.exists(at(path)):
            return False
        raise OSError(f"{path} can't be created") from e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _lock(spark: SparkSession, path: str, stale: float) -> None:
    """Takes the lock or raises."""
    fs, at = _hadoop(spark, path)
    owner = json.dumps({"owner": spark.sparkContext.applicationId, "since": time.time()})
    for _ in range(2):
        if _create(spark, path, owner):
            return
        age = time.time() - fs.getFileStatus(at(path)).getModificationTime() / 1000
        if age < stale or not fs.rename(at(path), at(f"{path}.{uuid.uuid4().hex}")):
            break
    raise OSError(f"{path} is held by {_content(spark, path) if fs.exists(at(path)) else 'another writer'}")


def require_contract(spark: SparkSession, path: str, contract: dict) -> None:
    """Records the contract of a run under path, or compares it with the one recorded: another is an error."""
    write_once(spark.createDataFrame([(contract_digest(contract),)], "digest string"), f"{path}.contract", spark)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of each version of a table, the newest last. A pointer file without a name is of a writer that
    died in between, and counts for nothing."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at(f"{path}/_pointers")):
        return []
    found = []
    for status in fs.listStatus(at(f"{path}/_pointers")):
        name = status.getPath().getName()
        if name.isdigit() and (folder := _content(spark, f"{path}/_pointers/{name}").strip()):
            found.append((int(name), f"{path}/{folder}"))
    return sorted(found)


def publish(df: DataFrame, path: str, spark: SparkSession, keep: int = 2) -> None:
    """Puts df in the place of a table that read_published reads. It is written whole as a new version, then a
    pointer file of the next number, which only one writer can create, names it: before that all readers see the old
    rows, after it the new ones, and nothing is lost where a step fails. Of two writers at once the slower one gets an error. Versions
    but the newest `keep` are deleted afterwards, so that plans made before still find their files."""
    had = versions(spark, path)
    folder = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    number = max([n for n, _ in had] + _numbers(spark, path), default=0) + 1
    if not _create(spark, f"{path}/_pointers/{number:010d}", folder):
        raise OSError(f"{path} was replaced by another writer")
    fs, at = _hadoop(spark, path)
    for n, old in had[: max(0, len(had) + 1 - keep)]:
        fs.delete(at(f"{path}/_pointers/{n:010d}"), False)
        fs.delete(at(old), True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all pointers, those without a name as well."""
    fs, at = _hadoop(spark, path)
    return [int(s.getPath().getName()) for s in fs.listStatus(at(f"{path}/_pointers")) if s.getPath().getName().isdigit()] if fs.exists(at(f"{path}/_pointers")) else []


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that publish wrote."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(found[-1][1])


def replace(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Puts df in the place of a plain folder that any Parquet reader reads. It is written aside; the old folder is renamed
    away, the new one renamed into its place, and only then the old one deleted. A rename that fails is an error, and the
    old rows are back in place. Between the two renames there is no folder: where readers mustn't see that, publish."""
    fs, at = _hadoop(spark, path)
    aside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        fs.delete(at(aside), True)
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(at(aside), at(path)):
        if had and not fs.rename(at(old), at(path)):
            raise OSError(f"{path} can't be put in place; its rows are in {old}")
        fs.delete(at(aside), True)
        raise OSError(f"{path} can't be put in place")
    if had:
        fs.delete(at(old), True)


def resume(todo: DataFrame, spark: SparkSession, path: str, key: str, make, contract: dict | None = None) -> DataFrame:
    """Rows of todo not yet under path are made and appended; all are read back. With a contract, a run under
    another one is an error."""
    if contract is not None:
        require_contract(spark, path, contract)
    try:
        done = spark.read.parquet(path).select(key)
        todo = todo.join(done, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def predictions_by_layer(rows: DataFrame) -> DataFrame:
    """One row per item with its predictions in order of layers."""
    return rows.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "prediction"))), lambda x: x["prediction"]).alias("predictions"))


def report(df: DataFrame, **protocol) -> Column:
    """A row as a JSON object, beside the protocol it was made under."""
    return F.to_json(F.struct(*df.columns, *[F.lit(v).alias(k) for k, v in protocol.items()]))


def curve_tables(predictions: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """What the plots draw: macro recall per layer, recall per class and layer, and per layer the mean, least and
    most over resamples (by holds layer and resample)."""
    from ..operators import metrics, readout

    scores = readout.class_metrics(predictions, by)
    return {"curves": scores, "class_recall": readout.class_recalls(predictions, by), "stability": metrics.band(scores, ["layer"], "macro_recall")}


def sample_schema() -> T.StructType:
    return T._parse_datatype_string(SAMPLE)
