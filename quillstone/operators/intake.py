"""Upload intake: routing, camera payloads, recognition language, image planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import OCR_LANGUAGE_SHORTHAND
from ..functions.text import or_default

MAX_BYTES = 10 * 1024 * 1024
MAX_WIDTH = 2000


def intake_route(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``accepted, reject_reason, route`` to a ``filename, length`` table."""
    name = F.coalesce(F.col("filename"), F.lit(""))
    reason = F.when(name == "", "No selected file").when(
        F.col("length") > max_bytes, "File too large (max 10MB)")
    return files.withColumns({
        "reject_reason": reason,
        "accepted": reason.isNull(),
        "route": F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("image"),
    })


def decode_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``img_bytes, handwriting, error`` decoded from a JSON camera payload.

    Everything up to the first comma of the image is dropped (the data-URL
    header); characters outside the base64 alphabet are ignored.
    """
    staged = df.withColumn("_p", F.from_json(payload, "image string, handwriting boolean"))
    image = F.coalesce(F.col("_p.image"), F.lit(""))
    staged = staged.withColumn("_image", image)
    body = F.regexp_replace(F.regexp_replace("_image", r"(?s)\A[^,]*,", ""), "[^A-Za-z0-9+/=]", "")
    staged = staged.withColumn("_bytes", F.when(
        F.length(body) % 4 == 0, F.try_to_binary(body, F.lit("base64"))))
    missing = F.col("_image") == ""
    return staged.withColumns({
        "img_bytes": F.when(~missing, F.col("_bytes")),
        "handwriting": F.coalesce(F.col("_p.handwriting"), F.lit(False)),
        "error": F.when(missing, "No image data provided").when(
            F.col("_bytes").isNull(), "Invalid base64 image data"),
    }).drop("_p", "_image", "_bytes")


def ocr_language(lang: Column, route: Column, endpoint: Column) -> Column:
    """Recognition-language argument for an upload.

    Shorthands gain the Latin script, except for PDFs sent to the general
    upload, which pass the code on as it is.
    """
    pairs = [F.lit(v) for pair in OCR_LANGUAGE_SHORTHAND.items() for v in pair]
    mapped = F.coalesce(F.try_element_at(F.create_map(*pairs), lang), lang)
    return F.when((route == "pdf") & (endpoint == "upload"), lang).otherwise(mapped)


def plan_images(images: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """Add ``ok, target_w, target_h``: sizes after scaling down to the width cap."""
    w, h = F.col("width"), F.col("height")
    scale = F.lit(float(max_width)) / w
    wide = w > max_width
    ok = (w > 0) & (h > 0)
    return images.withColumns({
        "ok": ok,
        "target_w": F.when(ok & wide, (w * scale).cast("int")).when(ok, w),
        "target_h": F.when(ok & wide, (h * scale).cast("int")).when(ok, h),
    })


def with_display_defaults(df: DataFrame) -> DataFrame:
    """Fallback texts for empty or missing result fields."""
    return df.withColumns({
        "raw_text": or_default(F.col("raw_text"), "(no text detected)"),
        "corrected_text": or_default(F.col("corrected_text"), "(no text)"),
        "language": or_default(F.col("language"), "–"),
    })
