"""Labelled flow and security-log CSV files as events.

Files are read as lines, so a quote only toggles quoting and is dropped, which Spark's CSV reader
cannot be told. Each file's columns are found by its own header; files may differ.

Lines have no ids of their own. `numbered` counts the lines of each split of a file once and gives every line its place
among all files by name, which `to_events` makes the event id and the order in time, so events of files can go
through `detect`. Reruns give the same numbers, however the files are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators.salted import checked
from ..operators.sliced import newest_per_key, running_sums
from ..params import FLAG_ACK, FLAG_FIN, FLAG_RST, FLAG_SYN
from ..session import cut

# Header names and the field each fills; the last column to match a field wins.
HEADER_FIELDS = {
    "src_ip": "src_ip", "source_ip": "src_ip", "dst_ip": "dst_ip", "dest_ip": "dst_ip",
    "src_port": "src_port", "dst_port": "dst_port", "protocol": "protocol",
    "label": "label", "Label": "label", "threat_label": "threat_label",
    "bytes_rate": "bytes_rate", "packets_rate": "packets_rate",
    "total_payload_bytes": "total_bytes", "bytes_transferred": "bytes_transferred",
    "duration": "duration", "action": "action", "log_type": "log_type",
    "packets_count": "packets_total", "fwd_packets_count": "packets_fwd", "bwd_packets_count": "packets_bwd",
    "fwd_total_payload_bytes": "bytes_fwd", "bwd_total_payload_bytes": "bytes_bwd",
    "payload_bytes_mean": "packet_size_mean", "payload_bytes_std": "packet_size_std",
    "payload_bytes_max": "packet_size_max", "payload_bytes_min": "packet_size_min",
    "packets_IAT_mean": "iat_mean", "packet_IAT_std": "iat_std",
    "packet_IAT_max": "iat_max", "packet_IAT_min": "iat_min",
    "syn_flag_counts": "syn_count", "fin_flag_counts": "fin_count",
    "ack_flag_counts": "ack_count", "rst_flag_counts": "rst_count",
    "down_up_rate": "down_up_ratio", "fwd_init_win_bytes": "fwd_init_win", "bwd_init_win_bytes": "bwd_init_win",
}
FIELDS = list(dict.fromkeys(HEADER_FIELDS.values()))
COUNTS = ("packets_total", "packets_fwd", "packets_bwd", "bytes_fwd", "bytes_bwd",
          "syn_count", "fin_count", "ack_count", "rst_count", "fwd_init_win", "bwd_init_win")
MEASURES = ("packet_size_mean", "packet_size_std", "packet_size_max", "packet_size_min",
            "iat_mean", "iat_std", "iat_max", "iat_min", "down_up_ratio", "duration")
FLAG_COUNTS = {"syn_count": FLAG_SYN, "fin_count": FLAG_FIN, "rst_count": FLAG_RST, "ack_count": FLAG_ACK}
MIN_COLUMNS = 5


def detect_format(header: Column) -> Column:
    """FlowCSV, CyberLog or Unknown from a header line."""
    return (
        F.when(header.startswith("flow_id,") & header.contains(",label"), "FlowCSV")
        .when(header.startswith("timestamp,source_ip,"), "CyberLog").otherwise("Unknown")
    )


def split_line(line: Column) -> Column:
    """Fields of a line: commas count outside quotes, quotes are dropped."""
    outside = F.transform(
        F.split(line, '"'), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(","), F.lit("\u0001"))).otherwise(part))
    return F.when(line.contains('"'), F.split(F.array_join(outside, ""), "\u0001")).otherwise(F.split(line, ","))


def _lines(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_block_length").alias("_length"),
        F.rtrim(F.col("value"), F.lit("\r\n")).alias("line"))
    return raw.filter(F.col("line") != "")


def line_index(lines: DataFrame) -> DataFrame:
    """One row per split of a file: its first line, the place of that line in its task, and how many lines lie before the split.

    One pass over the lines, combined within tasks; as small as the list of splits.
    """
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "_block", "_length").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.min_by("line", "_at").alias("_line"))
    counted = running_sums(cut(splits), [], {"_through": F.col("_n")}, ("file", "_block"))
    return cut(counted.withColumn("_before", F.col("_through") - F.col("_n")).drop("_through", "_n"))


def numbered(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Add `line_no`, counted from 0 over all files in order of name and place; `lines` is the frame that was indexed.

    Both passes must see the same splits; the job fails where the cluster cut the files anew in between.
    """
    places = checked(index.select("file", "_block", "_length", "_first", "_before"))
    moved = F.raise_error(F.lit("the splits of the files changed between two passes; read them again")).cast("long")
    at = F.col("_at") - F.col("_first") + F.col("_before")
    return lines.withColumn("_at", F.monotonically_increasing_id()).join(places, ["file", "_block", "_length"], "left").withColumn(
        "line_no", F.when(F.col("_first").isNull(), moved).otherwise(at)).drop("_at", "_first", "_before")


def _positions(header: Column) -> list[Column]:
    """For each field the index of the last header column that fills it, or null."""
    names = F.transform(split_line(header), lambda n: F.regexp_replace(n, r"^ +|[ \r]+$", ""))
    return [
        F.array_max(F.filter(
            F.transform(names, lambda n, i: F.when(n.isin(*[h for h, g in HEADER_FIELDS.items() if g == f]), i)),
            lambda i: i.isNotNull())).alias(f)
        for f in FIELDS
    ]


def parse_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Field columns (text), `format`, `file` and `present` fields of every data line.

    `headers` is one row per file (file, header): as small as the file list. Lines that repeat
    their file's header are no data; other lines that look like a header are.
    """
    known = cut(headers.select("file", "header", detect_format(F.col("header")).alias("format"), F.struct(*_positions(F.col("header"))).alias("_at")))
    body = lines.join(checked(known), "file").filter((F.col("format") != "Unknown") & (F.col("line") != F.col("header")))
    body = body.withColumn("_cols", split_line(F.col("line"))).filter(F.size("_cols") >= MIN_COLUMNS)
    return body.select(
        "file", "format", *_kept(lines), *[F.get("_cols", F.col(f"_at.{f}")).alias(f) for f in FIELDS],
        F.filter(F.array(*[F.when(F.col(f"_at.{f}").isNotNull(), F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull()).alias("present"),
    )


def _kept(lines: DataFrame) -> list[str]:
    return ["line_no"] if "line_no" in lines.columns else []


def headers_of(lines: DataFrame) -> DataFrame:
    """The first line of each file; a task reads the lines of a file's first block in order."""
    first = lines.filter(F.col("_block") == 0).withColumn("_no", F.monotonically_increasing_id())
    return first.groupBy("file").agg(F.min_by("line", "_no").alias("header"))


def read_flow_csv(spark: SparkSession, paths: str | list[str], header: str | None = None, number: bool = False) -> DataFrame:
    """Scan one or many files. With `header` given, all files share it and one pass is enough; `number` adds `line_no`,
    whose counting pass also finds the headers.
    """
    lines = _lines(spark, paths)
    if number:
        index = line_index(lines)
        lines = numbered(lines, index)
        if header is None:
            return parse_lines(lines, index.filter(F.col("_block") == 0).select("file", F.col("_line").alias("header")))
    if header is None:
        return parse_lines(lines, headers_of(lines))
    return _with_header(lines, header)


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    kind = spark_format(header)
    at = {f: None for f in FIELDS}
    for i, name in enumerate(header.rstrip("\r\n").replace('"', "").split(",")):
        field = HEADER_FIELDS.get(name.strip(" ").rstrip("\r"))
        if field:
            at[field] = i
    body = lines.filter(F.col("line") != F.lit(header.rstrip("\r\n"))).withColumn("_cols", split_line(F.col("line")))
    text = lambda f: F.lit(None).cast("string") if at[f] is None else F.get("_cols", F.lit(at[f]))
    return body.filter(F.size("_cols") >= MIN_COLUMNS).select(
        "file", F.lit(kind).alias("format"), *_kept(lines), *[text(f).alias(f) for f in FIELDS],
        F.array(*[F.lit(f) for f in FIELDS if at[f] is not None]).alias("present"))


def spark_format(header: str) -> str:
    """`detect_format` for a header already at hand."""
    if header.startswith("flow_id,") and ",label" in header:
        return "FlowCSV"
    return "CyberLog" if header.startswith("timestamp,source_ip,") else "Unknown"


def stream_flow_csv(spark: SparkSession, folder: str, header: str, files_per_trigger: int = 1) -> DataFrame:
    """Replay a folder of files with a common header as a stream; an unknown header yields
    constant placeholder events, as many as there are lines.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.rtrim(F.col("value"), F.lit("\r\n")).alias("line")).filter(F.col("line") != "")
    if spark_format(header) == "Unknown":
        whole = lines.filter(F.col("line") != F.lit(header)).filter(F.size(split_line(F.col("line"))) >= MIN_COLUMNS)
        return whole.select(
            "file", F.lit("replay").alias("source"), F.lit("target").alias("destination"), F.lit("net").alias("type"),
            F.lit(100).cast("long").alias("bytes_in"), F.lit(0.3).alias("entropy"), F.lit(1.0).alias("rate_hz"))
    return to_events(with_label(_with_header(lines, header)))


def with_label(df: DataFrame) -> DataFrame:
    """Ground truth: the label column of flow files; threat label, else action, of log files."""
    log = F.when(F.array_contains("present", "threat_label"), F.col("threat_label")).otherwise(F.col("action"))
    text = F.when(F.col("format") == "FlowCSV", F.col("label")).otherwise(log)
    return df.withColumn("label", F.coalesce(text, F.lit("")))


def to_events(df: DataFrame, start_us: int = 0, step_us: int = 1, tenant: str = "default") -> DataFrame:
    """Typed flow events. Numbers may carry trailing text; anything unreadable is the default.

    Numbered lines also get what `detect` needs: `event_id` (the line's number), `ts_us` (files are replayed from
    `start_us`, a line every `step_us`), `tenant`, `bytes_out` (files have none: 0) and `flags` (those counted at least once).
    """
    num = lambda f, d=0.0: scores.numeric_prefix(F.coalesce(F.col(f), F.lit("")), d)
    has = lambda f: F.array_contains("present", f)
    whole = lambda f: num(f).try_cast("long")
    port = lambda f: F.pmod(F.coalesce(F.regexp_extract(F.coalesce(F.col(f), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0)), F.lit(65536)).cast("int")
    proto = F.when(has("protocol"), F.coalesce("protocol", F.lit("UDP"))).otherwise("UDP")
    seconds = F.greatest(num("duration", 1.0), F.lit(0.001))
    rate = (
        F.when(has("bytes_rate"), num("bytes_rate"))
        .when(has("bytes_transferred"), num("bytes_transferred") / seconds)
        .when(has("total_bytes"), num("total_bytes") / seconds).otherwise(0.0)
    )
    mean, std = num("packet_size_mean"), num("packet_size_std")
    entropy = F.when(mean > 0, scores.clamp(std / (mean + 1) * 0.5 + 0.3, 0.0, 1.0)).otherwise(0.3)
    keep = [c for c in ("file", "format", "label") if c in df.columns]
    flags = F.lit(0)
    for count, bit in FLAG_COUNTS.items():
        flags = flags + F.when(F.coalesce(whole(count), F.lit(0)) > 0, bit).otherwise(0)
    replayed = [
        F.col("line_no").alias("event_id"), (F.lit(start_us) + F.col("line_no") * step_us).alias("ts_us"), F.lit(tenant).alias("tenant"),
        F.lit(0).cast("long").alias("bytes_out"), flags.alias("flags")] if "line_no" in df.columns else []
    return df.select(
        *keep, *replayed, F.coalesce("src_ip", F.lit("unknown")).alias("source"), F.coalesce("dst_ip", F.lit("unknown")).alias("destination"),
        F.lit("net").alias("type"), port("src_port").alias("port_src"), port("dst_port").alias("port_dst"),
        F.when(proto.contains("TCP"), 6).when(proto.contains("UDP"), 17).otherwise(0).alias("protocol"),
        rate.alias("rate_hz"), F.coalesce(whole("packets_rate"), F.lit(0)).alias("bytes_in"), entropy.alias("entropy"),
        *[F.coalesce(whole(c), F.lit(0)).alias(c) for c in COUNTS], *[num(c).alias(c) for c in MEASURES],
    )


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows, benign and attack rows per file, and for all files (file = null), from one job."""
    df = with_label(read_flow_csv(spark, paths))
    benign = scores.is_benign(F.col("label"))
    return df.rollup("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(benign).alias("benign"), F.count_if(~benign).alias("attack"))


def cap_rows(df: DataFrame, n: int, by: list[str], order: list[str], spread: str) -> DataFrame:
    """At most the first `n` rows per file."""
    return newest_per_key(df, by, n, [F.col(c) for c in order], F.col(spread))
