"""File planning, image metadata and cached artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.functions import paths as P

# --- fixed values: image sizes and qualities ---
EMBED_EDGE = 1920
THUMBNAIL_EDGE = 300
WEBP_QUALITY = 80
HEIC_QUALITY = 90
# --- end of fixed values ---


def classify_files(files: DataFrame) -> DataFrame:
    """Add file_type, extension and file_name; files of other types are dropped."""
    path = F.col("file_path")
    return files.select(
        "*",
        P.file_type(path).alias("file_type"),
        P.extension(path).alias("extension"),
        P.base_name(path).alias("file_name"),
    ).where(F.col("file_type").isNotNull())


def file_catalog(
    files: DataFrame,
    images: DataFrame | None = None,
    native: tuple[str, ...] = P.NATIVE_EXTENSIONS,
    threshold_mb: float = P.TRANSCODE_THRESHOLD_MB,
    max_edge: int = EMBED_EDGE,
) -> DataFrame:
    """All planning columns for every indexable file; ``images`` (origin, width, height) adds sizes."""
    path, size = F.col("file_path"), F.col("file_size")
    out = classify_files(files)
    is_image = F.col("file_type") == "image"
    out = out.withColumns(
        {
            "size_label": P.size_label(size),
            "mime_type": F.when(is_image, P.mime_type(path)),
            "needs_transcode": F.when(
                is_image, P.needs_transcode(path, size, native, threshold_mb)
            ),
        }
    )
    quality = F.when(F.col("extension").isin("heic", "heif"), HEIC_QUALITY).otherwise(WEBP_QUALITY)
    out = out.withColumn("webp_quality", F.when(F.col("needs_transcode"), quality))
    if images is None:
        return out
    dims = images.select(F.col("origin").alias("file_path"), "width", "height")
    plan = P.fit_dimensions(F.col("width"), F.col("height"), max_edge)
    return (
        out.join(dims, "file_path", "left")
        .withColumn("_fit", F.when(F.col("width").isNotNull(), plan))
        .withColumn("fit_width", F.col("_fit.width"))
        .withColumn("fit_height", F.col("_fit.height"))
        .drop("_fit")
    )


def exif_fields(tagged: DataFrame) -> DataFrame:
    """Project the nine EXIF strings out of ``tags``, a JSON object of tag names."""
    tags = F.from_json(
        "tags",
        "Make string, Model string, ISOSpeedRatings string, FNumber string, ApertureValue string, "
        "ExposureTime string, FocalLength string, DateTimeOriginal string, "
        "GPSLatitude double, GPSLongitude double",
    )

    def hemisphere(name: str, positive: str, negative: str):
        value = F.col(name)
        side = F.when(value >= 0, positive).otherwise(negative)
        # plain decimals, no exponent and no trailing zeros; numbers too large for any angle give null
        number = F.regexp_replace(F.abs(value).try_cast("decimal(20,16)").cast("string"), r"\.?0+$", "")
        return F.when(value.isNotNull(), F.concat(number, F.lit(" "), side))

    return tagged.withColumn("_t", tags).select(
        "file_path",
        F.col("_t.Make").alias("camera_make"),
        F.col("_t.Model").alias("camera_model"),
        F.col("_t.ISOSpeedRatings").alias("iso"),
        F.coalesce("_t.FNumber", "_t.ApertureValue").alias("aperture"),
        F.col("_t.ExposureTime").alias("shutter_speed"),
        F.col("_t.FocalLength").alias("focal_length"),
        F.col("_t.DateTimeOriginal").alias("date_taken"),
        hemisphere("_t.GPSLatitude", "N", "S").alias("gps_latitude"),
        hemisphere("_t.GPSLongitude", "E", "W").alias("gps_longitude"),
    )


def expired_artifacts(artifacts: DataFrame, meta: DataFrame) -> DataFrame:
    """Cached ``.webp`` files named after a hash that no indexed file has."""
    path = F.col("artifact_path")
    cached = artifacts.where(F.endswith(path, F.lit(".webp")))
    named = cached.withColumn("hash", P.file_stem(path))
    valid = meta.select(F.col("file_hash").alias("hash")).distinct()
    return named.join(valid, "hash", "left_anti").select(*artifacts.columns, "hash")


def expired_summary(artifacts: DataFrame, meta: DataFrame) -> DataFrame:
    """Number of cached ``.webp`` files and how many of them are expired."""
    path = F.col("artifact_path")
    named = artifacts.where(F.endswith(path, F.lit(".webp"))).select(P.file_stem(path).alias("hash"))
    valid = meta.select(F.col("file_hash").alias("hash")).distinct().withColumn("known", F.lit(1))
    return named.join(valid, "hash", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("known").isNull()).alias("deleted")
    )


def clear_artifacts_summary(artifacts: DataFrame) -> DataFrame:
    """Number of files a full clear removes."""
    return artifacts.agg(F.count(F.lit(1)).alias("deleted"))
