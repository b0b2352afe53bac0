"""How many frames of a video are looked at, how large, and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Frames for videos of up to so many seconds, and for longer ones.
STEPS = ((10, 4), (30, 8), (60, 12), (120, 20))
LONGEST, UNKNOWN = 32, 12


def frame_plan(duration: Column, is_video: Column, ceiling: int = 32) -> Column:
    planned = F.lit(LONGEST)
    for seconds, n in reversed(STEPS):
        planned = F.when(duration <= seconds, n).otherwise(planned)
    planned = F.when(F.coalesce(duration, F.lit(0.0)) <= 0, UNKNOWN).otherwise(planned)
    return F.when(~is_video, 1).otherwise(F.least(planned, F.lit(max(1, ceiling))))


def tokens_per_frame(side: Column) -> Column:
    """What a 16:9 frame costs the model: its squares of 32 x 32 pixels, rounded half to even."""
    wide = F.greatest(F.lit(32), side).cast("double")
    return F.rint((wide / 32) * (wide * 9 / 16 / 32)).cast("long")


def fit_plan(plans: DataFrame, overhead: int = 3500) -> DataFrame:
    """plans (count, side, context) with fit_count and fit_side: the side is made smaller by 128 down to 512, then frames fewer down to 3, until they fit."""
    steps = F.greatest(F.lit(0), F.ceil((F.col("side") - 512) / 128)).cast("int")
    sides = F.transform(F.sequence(F.lit(0), steps), lambda i: F.when(i == 0, F.col("side")).otherwise(F.greatest(F.lit(512), F.col("side") - 128 * i)))
    last, room = F.element_at(sides, -1), F.col("context") - overhead
    fits = F.filter(sides, lambda s: F.col("count") * tokens_per_frame(s) <= room)
    plans = plans.withColumn("_side", F.get(fits, F.lit(0))).withColumn("_any", F.size(fits) > 0)
    # of the smallest side as many frames as there is room for, which a division tells
    most = F.coalesce(F.call_function("div", room.cast("long"), tokens_per_frame(last)), F.lit(0))
    fewer = F.when(F.col("count") > 3, F.greatest(F.lit(3), F.least(F.col("count") - 1, most)).cast("int")).otherwise(F.col("count"))
    return plans.withColumn("fit_count", F.when(F.col("_any"), F.col("count")).otherwise(fewer)).withColumn("fit_side", F.when(F.col("_any"), F.col("_side")).otherwise(last)).drop("_side", "_any")


def even_positions(total: Column, count: Column) -> Column:
    """Frame numbers from 0, evenly spread; 6 % of each end left out of more than 30."""
    first = F.when(total > 30, 0.06).otherwise(0.0)
    step = (F.lit(1.0) - 2 * first) / (count - 1)
    many = F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda i: F.floor(total * (first + step * i)).cast("long"))
    many = F.transform(many, lambda p: F.greatest(F.lit(0).cast("long"), F.least(total.cast("long") - 1, p)))
    one = F.array(F.floor(total * 0.5).cast("long"))
    return F.when((total <= 0) | (count <= 0), F.array().cast("array<bigint>")).when(count == 1, one).otherwise(many)


def frame_hash(pixels: Column, width: int, height: int) -> Column:
    """difference_hash() of a whole frame in a row: pixels has its brightness as bytes, line by line. Null has none; a frame of another size is an error."""
    if width < 9 or height < 8:
        raise ValueError("a frame has 9 x 8 points at least")
    across, down = [-(-width * c // 9) for c in range(9)], [-(-height * c // 8) for c in range(8)]
    points = np.diff([*down, height])[:, None] * np.diff([*across, width])

    @F.arrow_udf(LongType())
    def hashed(frames: pa.Array) -> pa.Array:
        there, made = frames.drop_null(), []
        for at in range(0, len(there), 256):
            part = there[at : at + 256].to_pylist()
            if any(len(x) != width * height for x in part):
                raise ValueError(f"a frame isn't of {width} x {height} points")
            lines = np.add.reduceat(np.frombuffer(b"".join(part), np.uint8).reshape(-1, height, width), down, axis=1, dtype=np.int32)
            cells = np.add.reduceat(lines, across, axis=2) / points
            made.append(np.packbits((cells[:, :, 1:] > cells[:, :, :-1]).reshape(-1, 64), axis=1).view(">i8").ravel().astype(np.int64))
        out = np.zeros(len(frames), np.int64)
        out[~np.asarray(frames.is_null())] = np.concatenate(made) if made else []
        return pa.array(out, pa.int64(), mask=np.asarray(frames.is_null()))

    return hashed(pixels)


def difference_hash(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """media_pk, frame_no, hash: brightness of a 9 x 8 grid; a bit for each cell brighter than its left neighbour, row by row.

    For tables with a row for each point; frames that come whole are for frame_hash(), which has no shuffle.
    """
    cell_x, cell_y = F.floor(F.col("x") * 9 / width).cast("int"), F.floor(F.col("y") * 8 / height).cast("int")
    grid = pixels.groupBy("media_pk", "frame_no", cell_y.alias("cy"), cell_x.alias("cx")).agg(F.avg("luma").alias("luma"))
    left = F.lag("luma").over(Window.partitionBy("media_pk", "frame_no", "cy").orderBy("cx"))
    bits = grid.withColumn("left", left).where("left is not null")
    place = 63 - (F.col("cy") * 8 + F.col("cx") - 1)
    value = F.when(F.col("luma") > F.col("left"), F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))).otherwise(F.lit(0).cast("long"))
    return bits.groupBy("media_pk", "frame_no").agg(F.bit_or(value).alias("hash"))
