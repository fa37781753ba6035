"""Sources and sinks of event patches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: "2023-01-01 00:00:55.0000 UTC" and the like.
_WHEN = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:\.\d{1,6})?)\d*\s*(?:UTC|Z)?$"


def values(blocks: Iterable[str]) -> Iterator[str]:
    """Each JSON object of a text of concatenated ones, however they are laid out and wherever blocks of the text
    end; what isn't JSON is skipped up to the next brace."""
    decoder, text, source, more = json.JSONDecoder(), "", iter(blocks), True
    while True:
        at = text.find("{")
        if at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError as e:
                # what breaks off at the text's end may go on in the next block
                if more and (getattr(e, "pos", len(text)) >= len(text) - 8 or "Unterminated" in str(e)):
                    at = -2
                else:
                    text = text[at + 1 :]
                    continue
            else:
                yield json.dumps(value, ensure_ascii=False)
                text = text[end:]
                continue
        block = next(source, None) if more else None
        more = block is not None
        if more:
            text = (text if at == -2 else "") + block
        elif at == -1:
            return


def blocks(path: str, size: int = 1 << 22) -> Iterator[str]:
    """A local file's text, a block at a time."""
    with open(path, encoding="utf-8", errors="replace") as f:
        while block := f.read(size):
            yield block


def json_events(spark: SparkSession, path: str, schema: StructType, ts: str = "timestamp", lines: bool = False) -> DataFrame:
    """Patches of the given schema (undeclared keys ignored, records that don't fit dropped), with ts as a timestamp and seq, their order.

    lines: one object a line, which Spark can split; else whole files are read, of 2 GB at most
    each, and objects may span lines; normalise() makes lines of larger ones. A record without a time is dropped, too.
    """
    if lines:
        raw = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("seq"))
    else:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for text in b.column(0):
                    found = list(values([text.as_py()]))
                    for lo in range(0, len(found), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 10_000], pa.string())], names=["value"])

        raw = spark.read.text(path, wholetext=True).mapInArrow(split, "value string").withColumn("seq", F.monotonically_increasing_id())
    bad = "_corrupt_record"
    parsed = raw.select("seq", F.from_json("value", StructType([*schema.fields, StructField(bad, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    rows = parsed.where(F.col(f"r.{bad}").isNull()).select("seq", "r.*").drop(bad)
    time = F.regexp_extract(F.col(ts), _WHEN, 1) if dict(rows.dtypes)[ts] == "string" else F.col(ts)
    return rows.withColumn(ts, time.try_cast("timestamp")).where(F.col(ts).isNotNull())


def normalise(path: str, out: str) -> int:
    """Write a file of concatenated objects, of any size, as one object a line; how many there were."""
    n = 0
    with open(out, "w", encoding="utf-8") as f:
        for n, value in enumerate(values(blocks(path)), 1):
            f.write(value + "\n")
    return n


def write_json(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, nulls left out."""
    df.write.mode("overwrite").json(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
