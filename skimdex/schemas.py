"""Column layouts of the tables in an index."""

from __future__ import annotations

from pyspark.sql import types as T

#: one row per image or text chunk
VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
    ]
)

#: one row per indexed file
META = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)

#: EXIF strings kept for an image
EXIF = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "camera_make",
            "camera_model",
            "iso",
            "aperture",
            "shutter_speed",
            "focal_length",
            "date_taken",
            "gps_latitude",
            "gps_longitude",
        )
    ]
)

#: what ``vectors.metadata`` holds as JSON; image rows leave the text fields null and vice versa
METADATA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("modified_at", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("thumbnail_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("exif", EXIF),
    ]
)

#: one file as the scanner reports it
SNAPSHOT = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("modified_at", T.LongType()),
        T.StructField("file_hash", T.StringType()),
    ]
)
