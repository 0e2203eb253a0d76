"""Fit, frame and caption geometry as integer and double expressions; no pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    a = a.cast("bigint")
    return F.when(a < 0, -F.floor(-a / b)).otherwise(F.floor(a / b)).cast("bigint")


def shorter(w: Column, h: Column) -> Column:
    return F.least(w, h)


def percent_px(side: Column, percent: Column) -> Column:
    """trunc(side * percent / 100), multiplied before it is divided."""
    return (side.cast("double") * percent.cast("double") / F.lit(100.0)).cast("bigint")


def frame_px(w: Column, h: Column, percent: Column) -> Column:
    return percent_px(shorter(w, h), percent)


def fitted(side: Column, scale: Column) -> Column:
    """A side at a scale, rounded, at least 1; null where there is no scale."""
    return F.when(scale.isNotNull(), F.greatest(F.lit(1).cast("bigint"), F.floor(side.cast("double") * scale + F.lit(0.5)).cast("bigint")))


def fit(w: Column, h: Column, box_w: Column, box_h: Column) -> tuple[Column, Column, Column]:
    """(scale, width, height) of an image that fills a box on one axis; it may grow. Rounding is to the nearest."""
    scale = F.least(box_w.cast("double") / w.cast("double"), box_h.cast("double") / h.cast("double"))
    return scale, fitted(w, scale), fitted(h, scale)


def expand(rows: DataFrame, w: str, h: str, out_w: str, out_h: str, frame: str) -> DataFrame:
    """Adds where an image stands that is centred on a canvas of exactly out_w x out_h, at least a frame from its edges: width, height, left,
    top, right, bottom, image_bottom, canvas_width, canvas_height, error. Each step is a column, so no expression grows by those before it."""
    sides = {"width": w, "height": h}
    box_w, box_h = F.col(out_w) - 2 * F.col(frame), F.col(out_h) - 2 * F.col(frame)
    rows = rows.withColumn("_ok", (box_w > 0) & (box_h > 0)).withColumn("_scale", F.when(F.col("_ok"), fit(F.col(w), F.col(h), box_w, box_h)[0]))
    rows = rows.withColumns({n: fitted(F.col(c), F.col("_scale")) for n, c in sides.items()})
    rows = rows.withColumns({"left": _div(F.col(out_w) - F.col("width"), 2), "top": _div(F.col(out_h) - F.col("height"), 2)})
    rest = {"right": F.col(out_w) - F.col("width") - F.col("left"), "bottom": F.col(out_h) - F.col("height") - F.col("top"), "image_bottom": F.col("top") + F.col("height")}
    canvas = {"canvas_width": F.when(F.col("_ok"), F.col(out_w).cast("bigint")), "canvas_height": F.when(F.col("_ok"), F.col(out_h).cast("bigint"))}
    error = {"error": F.when(~F.col("_ok"), F.lit("frame too large for output size"))}
    return rows.withColumns(rest | canvas | error).drop("_ok", "_scale")


def wrap(w: Column, h: Column, out_w: Column, out_h: Column, frame: Column) -> Column:
    """The image fitted to the whole output size, with the frame around it."""
    _, rw, rh = fit(w, h, out_w, out_h)
    cols = {"width": rw, "height": rh, "left": frame, "top": frame, "right": frame, "bottom": frame, "image_bottom": frame + rh, "canvas_width": rw + 2 * frame, "canvas_height": rh + 2 * frame}
    return F.struct(*[c.cast("bigint").alias(n) for n, c in cols.items()], F.lit(None).cast("string").alias("error"))


def framed(w: Column, h: Column, top: Column, right: Column, bottom: Column, left: Column) -> Column:
    return F.struct((w + left + right).alias("canvas_width"), (h + top + bottom).alias("canvas_height"))


def font_px(w: Column, h: Column, percent: Column) -> Column:
    return F.greatest(F.lit(8).cast("bigint"), percent_px(shorter(w, h), percent))


def text_extent(text: Column, font: Column) -> tuple[Column, Column]:
    """(width, height) estimated from bytes, not characters."""
    return (F.octet_length(text).cast("double") * font.cast("double") * F.lit(0.6)).cast("bigint"), (font.cast("double") * F.lit(1.35)).cast("bigint")


def label_box(text: Column, font: Column, canvas_w: Column, canvas_h: Column, left: Column, image_bottom: Column, padding: Column) -> Column:
    """The caption's box and where its text starts; sizes are cut at the far edges and may be 0 or less (drawable tells)."""
    tw, th = text_extent(text, font)
    pad = _div(font, 3)
    zero = F.lit(0).cast("bigint")
    top, x = F.greatest(zero, image_bottom + padding), F.greatest(zero, left - _div(pad, 2))
    bw, bh = tw + 2 * pad, th + pad
    bw, bh = F.when(x + bw > canvas_w, canvas_w - x).otherwise(bw), F.when(top + bh > canvas_h, canvas_h - top).otherwise(bh)
    cols = {"box_left": x, "box_top": top, "box_width": bw, "box_height": bh, "text_left": x + _div(pad, 2), "text_top": top + _div(pad, 2)}
    return F.struct(*[c.cast("bigint").alias(n) for n, c in cols.items()], ((bw > 0) & (bh > 0)).alias("drawable"))
