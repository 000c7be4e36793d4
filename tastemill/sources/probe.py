"""Media probes: an external program per file, and what its JSON says."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.media import frame_rate, round2

PROBE = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,avg_frame_rate:string>>,broken:string>"
COMMAND = ("ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams")


def run_program(path: str) -> str:
    """The program's output for a file; an error where it fails."""
    done = subprocess.run([*COMMAND, path], capture_output=True, timeout=60, check=False)
    if done.returncode:
        raise OSError(done.stderr.decode(errors="replace")[:200])
    return done.stdout.decode()


def probe(files: DataFrame, call: Callable[[str], str] = run_program) -> DataFrame:
    """path, size, json, error: ``call`` for each file, one of json and error null."""

    def run(batches):
        for batch in batches:
            out, bad = [], []
            for path in batch.column(0).to_pylist():
                try:
                    out.append(call(path))
                    bad.append(None)
                except Exception as e:  # a file that can't be probed is a row of its own
                    out.append(None)
                    bad.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(bad, pa.string())], ["path", "size", "json", "error"])

    return files.select("path", F.col("size").cast("long").alias("size")).mapInArrow(run, "path string, size long, json string, error string")


def extract(probed: DataFrame) -> DataFrame:
    """path, media, reason: features from the JSON of the first video and audio stream; reason says why there are none."""
    x = probed.withColumn("p", F.from_json("json", PROBE, {"columnNameOfCorruptRecord": "broken"}))
    first = lambda kind: F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    x = x.withColumn("video", first("video")).withColumn("audio", first("audio"))
    text = F.col("p.format.duration")
    seconds = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("p").isNull() | F.col("p.broken").isNotNull(), "bad JSON")
        .when(F.col("video").isNull(), "no video stream")
        .when(F.col("video.width").isNull() | F.col("video.height").isNull(), "no size")
        .when(text.isNull(), "no duration")
        .when(seconds.isNull(), "bad duration")
    )
    media = F.struct(
        F.col("video.width").alias("w"), F.col("video.height").alias("h"), F.col("size").alias("s"), F.coalesce("video.codec_name", F.lit("")).alias("vc"),
        F.coalesce("audio.codec_name", F.lit("")).alias("ac"), round2(seconds).alias("d"), round2(frame_rate(F.col("video.avg_frame_rate"))).alias("fps"),
    )
    return x.select("path", F.when(reason.isNull(), media).alias("media"), reason.alias("reason"))
