"""Text rules of media tools: rational numbers, pixel formats, presets, escaping, argument lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixel formats to fall back on, in order of preference (fixed values).
FALLBACKS = {
    "yuv444p12le": ["yuv444p10le", "yuv422p10le", "yuv420p10le", "yuv444p", "yuv420p"],
    "yuv422p12le": ["yuv422p10le", "yuv420p10le", "yuv422p", "yuv420p"],
    "yuv420p12le": ["yuv420p10le", "yuv420p"],
    "yuv444p10le": ["yuv422p10le", "yuv420p10le", "yuv444p", "yuv420p"],
    "yuv422p10le": ["yuv420p10le", "yuv422p", "yuv420p"],
    "yuv420p10le": ["yuv420p"],
    "p010le": ["yuv420p10le", "yuv420p"],
    "yuv444p": ["yuv422p", "yuv420p"],
    "yuv422p": ["yuv420p"],
    "yuvj420p": ["yuv420p"],
    "yuvj422p": ["yuv422p", "yuv420p"],
    "yuvj444p": ["yuv444p", "yuv420p"],
    "gbrp": ["yuv444p", "yuv420p"],
    "nv12": ["yuv420p"],
    "yuva420p": ["yuv420p"],
}
DEFAULT_FORMAT = "yuv420p"
#: Named presets of the AV1 encoder and their numbers (fixed values).
PRESETS = {"placebo": 0, "veryslow": 1, "slower": 2, "slow": 4, "medium": 6, "fast": 8, "faster": 9, "veryfast": 10, "superfast": 12, "ultrafast": 13}


def rational(text: Column, default: float = 0.0) -> Column:
    """The value of "30000/1001" or "25"; default where it is none or divides by zero."""
    top, bottom = F.split(text, "/").getItem(0), F.when(F.instr(text, "/") > 0, F.regexp_extract(text, "/(.*)$", 1)).otherwise("1")
    value = lambda c: c.try_cast("double")
    return F.coalesce(F.try_divide(value(top), value(bottom)), F.lit(default))


def positive(x: Column) -> Column:
    """x, or null where it is 0: for the next in a chain of fallbacks."""
    return F.nullif(x, F.lit(0.0))


def pixel_format(requested: Column, source: Column, supported: Column) -> Column:
    """The format to encode with: as asked, else the source's, else the nearest that is supported."""
    table = F.create_map(*[x for k, v in FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    near = F.try_element_at(F.filter(F.try_element_at(table, source), lambda f: F.array_contains(supported, f)), F.lit(1))
    return (
        F.when((requested != "") & (requested != "auto"), requested)
        .when((source == "") | (source == "unknown") | source.isNull(), DEFAULT_FORMAT)
        .when(F.size(supported) == 0, source)
        .when(F.array_contains(supported, source), source)
        .otherwise(F.coalesce(near, F.when(F.array_contains(supported, F.lit(DEFAULT_FORMAT)), DEFAULT_FORMAT), F.array_min(supported)))
    )


def preset_number(preset: Column) -> Column:
    """The number of a named or numbered preset; an error outside -2 to 13."""
    key = F.lower(F.trim(preset))
    named = F.try_element_at(F.create_map(*[x for k, v in PRESETS.items() for x in (F.lit(k), F.lit(v))]), key)
    n = F.coalesce(named, key.try_cast("int"))
    return F.when(n.between(-2, 13), n).otherwise(F.raise_error(F.concat(F.lit("preset must be a name or -2..13: "), preset)).cast("int"))


def container(encoder: Column) -> Column:
    return F.when(F.contains(encoder, F.lit("av1")), "mkv").otherwise("mp4")


def keyint(fps: Column, seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.when(fps > 0, fps).otherwise(30.0) * seconds, 0).cast("int"))


def escape_filter_path(path: Column) -> Column:
    for old, new in (("\\", "\\\\"), (":", "\\\\:"), ("'", "\\'"), ("[", "\\["), ("]", "\\]")):
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def concat_line(path: Column) -> Column:
    """A line of a concat list; a quote within the path is closed, escaped and opened again."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))
