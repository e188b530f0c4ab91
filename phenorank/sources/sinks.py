"""Sinks: review sheets, chat records, and model artifacts with a manifest of hashes."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_review_csv(sheet: DataFrame, path: str) -> None:
    """One folder of CSV parts with a header; an existing folder isn't overwritten."""
    sheet.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_review_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    return df


def chat_records(mentions: DataFrame, system: str) -> DataFrame:
    """``(value)``: one chat record per report as JSON: the mentions' texts as user turn, their statuses as answer; no term ids."""
    rows = mentions.where("mention_text is not null and report_id is not null").groupBy("report_id").agg(F.array_sort(F.collect_set(F.struct("span_start", "mention_text", "assertion"))).alias("m"))
    answer = F.to_json(F.transform("m", lambda x: F.struct(x["mention_text"].alias("mention"), x["assertion"].alias("assertion"))))
    user = F.array_join(F.transform("m", lambda x: x["mention_text"]), "\n")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer)).alias("messages"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def digest(df: DataFrame) -> str:
    """A hash of a table's content whatever the order of its rows: row hashes summed, with their number."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    sums = df.agg(F.count("*").alias("n"), *parts).collect()[0]
    return hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()


def _file(folder: str, name: str):
    """Hadoop's path and file system of a file, so that artifacts can lie wherever Spark reads and writes."""
    spark = SparkSession.active()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(folder: str, name: str, text: str) -> None:
    """Written under another name and then renamed, so that no reader meets half a file."""
    (part, fs), (path, _) = _file(folder, f".{name}.part"), _file(folder, name)
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, path):
        raise OSError(f"{name} can't be put in place")


def _get(folder: str, name: str) -> str:
    path, fs = _file(folder, name)
    if not fs.exists(path):
        return ""
    try:
        return SparkSession.active().read.text(path.toString(), wholetext=True).collect()[0][0]
    except (Py4JError, PySparkException) as error:  # the file system's own checksum
        raise ValueError(f"{name} was changed") from error


def save_artifact(folder: str, files: dict[str, dict]) -> str:
    """Write JSON files with a manifest of their hashes to any folder Spark can write; the manifest's hash is returned. An existing folder is refused."""
    path, fs = _file(folder, ".")
    if fs.exists(path):
        raise FileExistsError(folder)
    manifest = {}
    for name, content in sorted(files.items()):
        text = json.dumps(content, sort_keys=True, allow_nan=False)
        _put(folder, f"{name}.json", text)
        manifest[name] = hashlib.sha256(text.encode()).hexdigest()
    text = json.dumps(manifest, sort_keys=True)
    _put(folder, "manifest.json", text)  # last: without it there is no artifact
    return hashlib.sha256(text.encode()).hexdigest()


def load_artifact(folder: str, expected: str | None = None) -> dict[str, dict]:
    """The files of an artifact; fails where one, or the manifest's ``expected`` hash, doesn't agree."""
    text = _get(folder, "manifest.json")
    if not text or expected is not None and hashlib.sha256(text.encode()).hexdigest() != expected:
        raise ValueError("the manifest isn't the expected one")
    out = {}
    for name, want in json.loads(text).items():
        content = _get(folder, f"{name}.json")
        if hashlib.sha256(content.encode()).hexdigest() != want:
            raise ValueError(f"{name} was changed")
        out[name] = json.loads(content)
    return out
