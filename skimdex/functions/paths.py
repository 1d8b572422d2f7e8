"""Columns derived from a file path, size or content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that decide which files are indexed and how they are labelled ---
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif")
TEXT_EXTENSIONS = ("txt", "md")
NATIVE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "ico")
TRANSCODE_THRESHOLD_MB = 4.0
MIME_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "dib": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "ico": "image/x-icon",
    "icns": "image/icns",
    "sgi": "image/sgi",
    "gif": "image/gif",
    "heic": "image/heic",
    "heif": "image/heic",
}
# --- end of fixed values ---


def base_name(path: Column) -> Column:
    """Last path component."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot belongs to the stem."""
    return F.regexp_extract(base_name(path), r"^(.+?)(?:\.[^.]*)?$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension, empty when there is none; a dot file has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def file_type(path: Column) -> Column:
    """``image``, ``text`` or null for files that are not indexed."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*TEXT_EXTENSIONS), "text")


def mime_type(path: Column) -> Column:
    """Image MIME type; no extension counts as jpeg, an unknown one names itself."""
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.when(ext == "", "image/jpeg").otherwise(
        F.coalesce(F.try_element_at(known, ext), F.concat(F.lit("image/"), ext))
    )


def data_url(path: Column, content: Column) -> Column:
    """``data:`` URL of the bytes; some Spark versions wrap base64 lines, so breaks are removed."""
    packed = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), packed)


def needs_transcode(
    path: Column,
    size: Column,
    native: tuple[str, ...] = NATIVE_EXTENSIONS,
    threshold_mb: float = TRANSCODE_THRESHOLD_MB,
) -> Column:
    """True when the model cannot take the format as it is, or the file is too large."""
    limit = int(threshold_mb * 1024 * 1024)
    return ~extension(path).isin(*native) | (size > F.lit(limit))


def size_label(size: Column) -> Column:
    """Bytes as ``B``, ``KB``/``MB`` with one decimal, ``GB`` with two; halves round up, in doubles."""
    kb, mb, gb = 1024, 1024**2, 1024**3

    def rounded(unit: int, steps: int) -> Column:
        return F.floor(size / F.lit(float(unit)) * steps + 0.5) / F.lit(float(steps))

    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mb, F.format_string("%.1f KB", rounded(kb, 10)))
        .when(size < gb, F.format_string("%.1f MB", rounded(mb, 10)))
        .otherwise(F.format_string("%.2f GB", rounded(gb, 100)))
    )


def content_hash(content: Column) -> Column:
    """Hex digest of the whole content; used only to compare contents for equality."""
    return F.sha2(content, 256)


def fit_dimensions(width: Column, height: Column, max_edge: int) -> Column:
    """Struct of the size whose long edge is at most ``max_edge``, ratio kept, at least 1x1."""
    edge = F.lit(int(max_edge))

    def shrink(side: Column, long_side: Column) -> Column:
        scaled = side.cast("double") * (edge.cast("double") / long_side.cast("double"))
        return F.floor(F.greatest(scaled, F.lit(1.0))).cast("int")

    fits = (width <= edge) & (height <= edge)
    wide = width > height
    return F.struct(
        F.when(fits, F.greatest(width, F.lit(1)))
        .when(wide, edge)
        .otherwise(shrink(width, height))
        .cast("int")
        .alias("width"),
        F.when(fits, F.greatest(height, F.lit(1)))
        .when(wide, shrink(height, width))
        .otherwise(edge)
        .cast("int")
        .alias("height"),
    )
