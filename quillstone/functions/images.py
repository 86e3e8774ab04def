"""Image sizes from file headers, without decoding a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

PNG_SIGNATURE = "89504E470D0A1A0A"
JPEG_START = "FFD8"
# Frame headers; the other codes of this range are tables.
END = 1 << 30  # beyond any file
JPEG_FRAME = "^FFC[0-35-79-BD-F]$"
JPEG_SEGMENTS = 600  # steps of the first walk; files it leaves undecided are walked to their end


def _number(content: Column, at: Column | int, size: int) -> Column:
    """The big-endian whole number of ``size`` bytes from a 1-based position; NULL beyond the end."""
    part = F.substring(content, F.lit(at) if isinstance(at, int) else at, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def _size(height: Column, width: Column) -> Column:
    return F.struct(height.cast("bigint").alias("height"), width.cast("bigint").alias("width"))


def _jpeg(content: Column) -> Column:
    """Walk the segments from one to the next until a frame header gives the size."""
    begin = F.struct(F.lit(3).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("height"),
                     F.lit(None).cast("bigint").alias("width"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"].cast("int")
        code = F.hex(F.substring(content, at, F.lit(2)))
        frame, fill = code.rlike(JPEG_FRAME), code == "FFFF"
        seek = state["height"].isNull() & code.startswith("FF")
        return F.struct(
            F.when(seek & fill, state["at"] + 1)
            .when(seek & ~frame, state["at"] + 2 + F.coalesce(_number(content, at + 2, 2), F.lit(END)))
            .otherwise(state["at"]).cast("bigint").alias("at"),
            F.when(seek & frame, _number(content, at + 5, 2)).otherwise(state["height"]).alias("height"),
            F.when(seek & frame, _number(content, at + 7, 2)).otherwise(state["width"]).alias("width"))

    def walk(state: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), steps), state, step)

    def decided(state: Column) -> Column:
        code = F.hex(F.substring(content, state["at"].cast("int"), F.lit(2)))
        return state["height"].isNotNull() | ~F.coalesce(code.startswith("FF"), F.lit(False))

    # A step moves on by a byte at least, so a file has no more steps than bytes.
    walked = let(walk(begin, F.lit(JPEG_SEGMENTS)), lambda state: F.when(decided(state), state).otherwise(
        walk(state, F.octet_length(content))))
    return let(walked, lambda state: _size(state["height"], state["width"]))


def image_size(content: Column) -> Column:
    """``struct<height, width>`` of a PNG or JPEG file, NULL fields for anything else or a broken header."""
    png = F.hex(F.substring(content, F.lit(1), F.lit(8))) == PNG_SIGNATURE
    jpeg = F.hex(F.substring(content, F.lit(1), F.lit(2))) == JPEG_START
    unknown = F.lit(None).cast("bigint")
    return F.when(png, _size(_number(content, 21, 4), _number(content, 17, 4))).when(
        jpeg, _jpeg(content)).otherwise(_size(unknown, unknown))
