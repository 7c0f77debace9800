"""Scalar functions on numbers, rates and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Usual frame rates and display aspects, with the tolerances of their labels.
COMMON_FPS = [15.0, 23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0, 90.0, 120.0, 240.0]
ASPECTS = [("16:9", 16 / 9), ("4:3", 4 / 3), ("3:2", 3 / 2), ("1:1", 1.0), ("9:16", 9 / 16), ("3:4", 3 / 4)]
ASPECT_TOLERANCE = 0.015


def finite(c: Column) -> Column:
    """The value as a double, or null where it is NaN or infinite; averages skip nulls, but not NaN."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def to_finite(c: Column) -> Column:
    """A finite double from text, else null."""
    return finite(c.try_cast("double"))


def rate(c: Column) -> Column:
    """``a/b`` as a quotient; a plain number as it is; null where either is no number or b is 0."""
    parts = F.split(c, "/")
    top, low = to_finite(F.try_element_at(parts, F.lit(1))), to_finite(F.try_element_at(parts, F.lit(2)))
    return F.when(F.size(parts) == 2, F.try_divide(top, low)).when(F.size(parts) == 1, top)


def ratio(c: Column) -> Column:
    """``a:b`` as a quotient of positive numbers, else null."""
    parts = F.split(c, ":")
    top, low = to_finite(F.try_element_at(parts, F.lit(1))), to_finite(F.try_element_at(parts, F.lit(2)))
    return F.when((F.size(parts) == 2) & (top > 0) & (low > 0), top / low)


def nearest(c: Column, values: list[float]) -> Column:
    """The nearest of fixed values; on ties the smaller one."""
    gaps = F.array(*[F.struct(F.abs(c - F.lit(v)).alias("gap"), F.lit(v).alias("v")) for v in sorted(values)])
    return F.when(c.isNotNull(), F.array_min(gaps)["v"])


def fps_label(c: Column) -> Column:
    near = nearest(c, COMMON_FPS)
    text = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.3f", v), "0+$", ""), r"\.$", "")
    snapped = F.when(F.abs(c - near) <= F.greatest(F.lit(0.02), near * 0.001), near).otherwise(F.bround(c, 2))
    return F.when(c.isNull(), "unknown").otherwise(text(snapped))


def aspect_label(c: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, value in reversed(ASPECTS):
        label = F.when(F.abs(c - F.lit(value)) <= ASPECT_TOLERANCE, name).otherwise(label)
    return F.when(c.isNull(), "unknown").otherwise(F.coalesce(label, F.format_string("%.2f", F.bround(c, 2))))


def orientation(width: Column, height: Column) -> Column:
    r = F.try_divide(width.cast("double"), height.cast("double"))
    return F.when(r.isNull(), "unknown").when(r.between(0.98, 1.02), "square").when(r > 1, "landscape").otherwise("portrait")


def right_angle(c: Column) -> Column:
    """Rotation snapped to 0, 90, 180 or 270 degrees."""
    return F.pmod(F.bround(c / 90) * 90, F.lit(360)).cast("int")


def sigmoid(c: Column) -> Column:
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def round_half_up_count(total: Column, fraction: Column) -> Column:
    """How many of ``total`` a fraction keeps: rounded half up, at least one for a positive fraction, at most all."""
    return F.when((fraction <= 0) | (total <= 0), F.lit(0)).otherwise(F.least(total, F.greatest(F.lit(1), F.floor(total * fraction + 0.5)))).cast("long")


def duration_label(c: Column) -> Column:
    """Whole seconds as 45s, 60s, 2m, 1m20s, 60m, 2h, 2h2m1s."""
    s = c.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    short = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.when(r > 0, F.concat(r.cast("string"), F.lit("s"))).otherwise(""))
    long = F.concat(h.cast("string"), F.lit("h"), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(""), F.when(r > 0, F.concat(r.cast("string"), F.lit("s"))).otherwise(""))
    return F.when(s <= 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, short).when(s == 3600, "60m").otherwise(long)


def clock(c: Column) -> Column:
    """HH:MM:SS of seconds, rounded half to even."""
    s = F.bround(c).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def focal_to_fov(size: Column, focal: Column) -> Column:
    return 2 * F.atan(size / (2 * focal))


def fov_to_focal(size: Column, fov: Column) -> Column:
    return size / (2 * F.tan(fov / 2))


#: Resolutions by aspect, from large to small.
RESOLUTIONS = {
    (16, 9): [(3840, 2160), (2560, 1440), (1920, 1080), (1280, 720), (854, 480), (640, 360), (426, 240), (320, 180)],
    (4, 3): [(2560, 1920), (1920, 1440), (1600, 1200), (1440, 1080), (1280, 960), (1024, 768), (800, 600), (640, 480), (512, 384)],
    (16, 10): [(1920, 1200), (1680, 1050), (1440, 900), (1280, 800), (640, 400)],
    (5, 4): [(1920, 1536), (1280, 1024), (960, 768)],
    (21, 9): [(2560, 1080), (1920, 800), (1280, 540)],
    (8, 3): [(2880, 1080), (1920, 720), (1280, 480), (640, 240)],
    (2, 1): [(5760, 2880), (2880, 1440), (1920, 960), (1280, 640)],
    (1, 1): [(1080, 1080), (720, 720), (480, 480)],
    (9, 16): [(2160, 3840), (1080, 1920), (720, 1280), (480, 854), (360, 640)],
    (3, 4): [(1200, 1600), (960, 1280), (768, 1024), (600, 800), (480, 640)],
    (9, 21): [(1080, 2560), (800, 1920)],
    (1, 2): [(1440, 2880), (720, 1440), (640, 1280), (360, 720)],
}


def pick_resolution(w: Column, h: Column, max_w: int, max_h: int, tolerance: float = 0.05) -> Column:
    """Struct ``w, h``: of the bucket of the nearest aspect, the largest size that neither enlarges nor exceeds the
    budget, else the smallest that doesn't enlarge; without such a bucket, the source scaled into the budget, even."""
    r = w / h
    size = lambda x, y: F.struct(F.lit(x * y).cast("long").alias("area"), F.lit(x).cast("int").alias("w"), F.lit(y).cast("int").alias("h"))
    buckets = F.array(*[F.struct(F.abs(F.lit(a / b) / r - 1).alias("off"), F.lit(i).alias("i"), F.array(*[size(*x) for x in sizes]).alias("sizes")) for i, ((a, b), sizes) in enumerate(RESOLUTIONS.items())])
    best = F.array_min(F.transform(buckets, lambda x: F.struct(x["off"], x["i"])))
    of = F.element_at(buckets, best["i"] + 1)["sizes"]
    fit = F.filter(of, lambda x: x["area"] <= (w * h).cast("long"))
    within = F.filter(fit, lambda x: x["area"] <= max_w * max_h)
    picked = F.when(F.size(within) > 0, F.array_max(within)).when(F.size(fit) > 0, F.array_min(fit))
    scale = F.least(F.lit(max_w) / w, F.lit(max_h) / h, F.lit(1.0))
    even = lambda v: F.greatest(F.lit(2), (F.floor(F.floor(v * scale) / 2) * 2).cast("int"))
    scaled = F.struct((F.lit(0).cast("long")).alias("area"), even(w).alias("w"), even(h).alias("h"))
    chosen = F.when(best["off"] <= tolerance, F.coalesce(picked, scaled)).otherwise(scaled)
    return F.struct(chosen["w"].alias("w"), chosen["h"].alias("h"))


def target_resolution(w: Column, h: Column, max_w: int, max_h: int, mode: str) -> Column:
    """Struct ``w, h, content_w, content_h`` of the modes that always give the target size: ``pad`` scales the content into
    it without enlarging, in even numbers, and fills the rest; ``resize`` stretches the content to it."""
    if mode not in ("pad", "resize"):
        raise ValueError(f"{mode} is neither pad nor resize")
    scale = F.least(F.lit(max_w) / w, F.lit(max_h) / h, F.lit(1.0))
    even = lambda v: F.greatest(F.lit(2), (F.floor(F.floor(v * scale + 1e-9) / 2) * 2).cast("int"))
    content = (even(w), even(h)) if mode == "pad" else (F.lit(max_w), F.lit(max_h))
    return F.struct(F.lit(max_w).alias("w"), F.lit(max_h).alias("h"), content[0].alias("content_w"), content[1].alias("content_h"))
