"""Transfer syntaxes as a table: what can be read, written and converted into what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifier, codec, compression, pixel encoding, decoder and encoder of the standard's transfer syntaxes.
SYNTAXES = (
    ("1.2.840.10008.1.2", "native", "none", "native", "supported", "supported"),
    ("1.2.840.10008.1.2.1", "native", "none", "native", "supported", "supported"),
    ("1.2.840.10008.1.2.1.99", "deflate", "lossless", "native", "supported", "supported"),
    ("1.2.840.10008.1.2.2", "native", "none", "native", "supported", "supported"),
    ("1.2.840.10008.1.2.4.50", "jpegBaseline", "lossy", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.51", "jpegExtended", "lossy", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.57", "jpegLossless", "lossless", "encapsulated", "supported", "unavailable"),
    ("1.2.840.10008.1.2.4.70", "jpegLossless", "lossless", "encapsulated", "supported", "unavailable"),
    ("1.2.840.10008.1.2.4.80", "jpegLS", "lossless", "encapsulated", "best-effort", "best-effort"),
    ("1.2.840.10008.1.2.4.81", "jpegLS", "near-lossless", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.90", "jpeg2000", "lossless", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.91", "jpeg2000", "lossy", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.92", "jpeg2000Part2", "lossless", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.93", "jpeg2000Part2", "lossy", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.94", "jpip", "none", "referenced", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.95", "jpip", "lossless", "referenced", "best-effort", "unavailable"),
    *((f"1.2.840.10008.1.2.4.{n}{part}", codec, "lossy", "encapsulated", "best-effort", "best-effort") for codec, numbers in (("mpeg2", (100, 101)), ("h264", (102, 103, 104, 105, 106))) for n in numbers for part in ("", ".1")),
    ("1.2.840.10008.1.2.4.107", "hevc", "lossy", "encapsulated", "best-effort", "best-effort"),
    ("1.2.840.10008.1.2.4.108", "hevc", "lossy", "encapsulated", "best-effort", "best-effort"),
    ("1.2.840.10008.1.2.4.201", "htj2k", "lossless", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.202", "htj2k", "lossless", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.4.203", "htj2k", "lossy", "encapsulated", "best-effort", "unavailable"),
    ("1.2.840.10008.1.2.5", "rle", "lossless", "encapsulated", "supported", "unavailable"),
)
#: What becomes of compressed pixels by codec.
PIXELS = {"deflate": "out-of-scope", "jpegLossless": "decoded", "rle": "decoded", "jpegExtended": "decoded", "jpegBaseline": "delegated", "jpegLS": "delegated", "jpeg2000": "delegated", "jpeg2000Part2": "delegated", "htj2k": "delegated", "jpip": "streamed-only", "mpeg2": "streamed-only", "h264": "streamed-only", "hevc": "streamed-only"}
#: How data sets are written by pixel encoding; deflated ones apart.
WRITING = {"native": "native-dataset", "encapsulated": "encapsulated-pass-through", "referenced": "referenced-dataset"}
COLUMNS = ("uid", "codec", "compression", "encoding", "decoder", "encoder")


def registry(spark: SparkSession) -> DataFrame:
    """One row per syntax, with ``pixel_support`` (null where pixels are not compressed) and ``write_support``."""
    rows = spark.createDataFrame(SYNTAXES, ", ".join(f"{c} string" for c in COLUMNS))
    named = lambda table, key: F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), F.col(key))
    compressed = (F.col("compression") != "none") | (F.col("encoding") == "referenced")
    return rows.withColumns({"pixel_support": F.when(compressed, named(PIXELS, "codec")), "write_support": F.when(F.col("codec") == "deflate", "deflated-dataset").otherwise(named(WRITING, "encoding"))})


def same_syntax(left: Column, right: Column) -> Column:
    """Identifiers that name one syntax, padding aside."""
    bare = lambda c: F.regexp_replace(c, r"[\s\x00]+$", "")
    return bare(left) == bare(right)


def with_plans(files: DataFrame, spark: SparkSession, source: str, wanted: str) -> DataFrame:
    """``files`` with ``route``, ``status`` and ``can_transcode`` from their syntax to the wanted one; unknown syntaxes have nulls.

    The registry has 36 rows and is broadcast.
    """
    known = registry(spark).select("uid", "compression", "encoding", "decoder", "encoder")
    side = lambda p: F.broadcast(known.select(*(F.col(c).alias(f"__{p}_{c}") for c in known.columns)))
    both = files.join(side("s"), F.col(source) == F.col("__s_uid"), "left").join(side("d"), F.col(wanted) == F.col("__d_uid"), "left")
    packed = lambda p: F.col(f"__{p}_compression") != "none"
    route = (
        F.when(F.col("__s_uid").isNull() | F.col("__d_uid").isNull(), None).when(F.col("__s_uid") == F.col("__d_uid"), "pass-through")
        .when((F.col("__s_encoding") == "referenced") | (F.col("__d_encoding") == "referenced"), "reference")
        .when(~packed("s") & ~packed("d"), "rewrite-native").when(packed("s") & ~packed("d"), "decompress").when(~packed("s"), "compress").otherwise("recompress")
    )
    needs = F.array_compact(F.array(F.when(packed("s"), F.col("__s_decoder")), F.col("__d_encoder")))
    by_codec = F.when(F.array_contains(needs, "unavailable"), "unsupported").when(F.array_contains(needs, "best-effort"), "ambiguous").otherwise("supported")
    status = F.when(route == "reference", "unsupported").when(route.isin("pass-through", "rewrite-native"), "supported").when(route.isNotNull(), by_codec)
    return both.select(*files.columns, route.alias("route"), status.alias("status"), (status == "supported").alias("can_transcode"))
