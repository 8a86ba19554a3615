"""Encoder parameters: rounding, keys, projection into a space, the unit cube."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(x: Column) -> Column:
    """A number without needless digits: 28.0 is 28."""
    text = x.cast("string")
    return F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)


def rounded_crf(crf: Column) -> Column:
    return F.bround(crf, 1)


def rounded_strength(strength: Column) -> Column:
    return F.bround(strength, 2)


def quickly(rounding, x: Column, digits: int) -> Column:
    """rounding (round or bround) of a double to some digits. Both go by way of decimal text, which only matters near ties and for large
    numbers: elsewhere the nearest whole number of units is the same, and its quotient the same double."""
    y = x * F.lit(10.0**digits)
    near = F.rint(y)
    clear = (F.abs(F.abs(y - near) - 0.5) > 1e-6) & (F.abs(y) < 2e9)
    return F.when(clear, near / F.lit(10.0**digits) + 0.0).otherwise(rounding(x, digits))


def params_key(crf: Column, mode: Column, strength: Column) -> Column:
    crf, strength = quickly(F.bround, crf.cast("double"), 1), quickly(F.bround, strength.cast("double"), 2)
    return F.concat(F.lit("crf="), short(crf), F.lit(",aq_mode="), mode.cast("string"), F.lit(",aq_strength="), short(strength))


def trial_key(segment: Column, encoder: Column, params: Column, model: Column, subsample: Column) -> Column:
    return F.concat_ws("|", segment, encoder, params, model, subsample.cast("string"))


def nearest_mode(modes: Column, mode: Column) -> Column:
    """The mode nearest to mode; of two as near the first."""
    nearest = F.array_min(F.transform(modes, lambda m, i: F.struct(F.abs(m - mode).alias("d"), i.alias("i"), m.alias("m"))))["m"]
    return F.when(F.array_contains(modes, mode), mode).otherwise(nearest)


def clamp(crf: Column, mode: Column, strength: Column, space: dict[str, Column]) -> dict[str, Column]:
    """The parameters moved into the space and rounded."""
    inside = F.least(F.greatest(strength, space["strength_min"]), space["strength_max"])
    return {
        "crf": quickly(F.bround, F.least(F.greatest(crf, space["crf_min"]), space["crf_max"]), 1),
        "aq_mode": nearest_mode(space["aq_modes"], F.rint(mode.cast("double")).cast("int")),
        "aq_strength": quickly(F.bround, F.when(space["integer_strength"], F.rint(inside)).otherwise(inside), 2),
    }


def space_columns(alias: str = "") -> dict[str, Column]:
    return {c: F.col(f"{alias}{c}") for c in ("crf_min", "crf_max", "aq_modes", "strength_min", "strength_max", "integer_strength")}


def to_unit(crf: Column, mode: Column, strength: Column, space: dict[str, Column]) -> dict[str, Column]:
    """Parameters of the space as a point of the unit cube; a mode is the middle of its share."""
    place = F.array_position(space["aq_modes"], mode.cast("int")) - 1
    return {
        "crf_u": (crf - space["crf_min"]) / F.greatest(space["crf_max"] - space["crf_min"], F.lit(1e-9)),
        "mode_u": (place + 0.5) / F.size(space["aq_modes"]),
        "strength_u": (strength - space["strength_min"]) / F.greatest(space["strength_max"] - space["strength_min"], F.lit(1e-9)),
    }


def from_unit(crf_u: Column, mode_u: Column, strength_u: Column, space: dict[str, Column]) -> dict[str, Column]:
    inside = lambda u: F.least(F.greatest(u, F.lit(0.0)), F.lit(0.999999))
    n = F.size(space["aq_modes"])
    mode = F.element_at(space["aq_modes"], F.least(n, F.floor(inside(mode_u) * n).cast("int") + 1))
    crf = space["crf_min"] + inside(crf_u) * (space["crf_max"] - space["crf_min"])
    strength = space["strength_min"] + inside(strength_u) * (space["strength_max"] - space["strength_min"])
    return clamp(crf, mode, strength, space)


def even_subsample(items: Column, keep: int) -> Column:
    """keep items at even distances, the first and the last among them; all if there are no more than that, the first if keep is 1."""
    places = F.sequence(F.lit(0), F.lit(max(1, keep) - 1))
    picked = F.transform(places, lambda i: F.get(items, F.bround(i * (F.size(items) - 1) / F.lit(float(max(1, keep - 1))), 0).cast("int")))
    return F.when(F.size(items) <= max(1, keep), items).otherwise(picked)


def midpoint(space: dict[str, Column]) -> dict[str, Column]:
    """The middle of a space: a guess where nothing is known."""
    modes = space["aq_modes"]
    return clamp((space["crf_min"] + space["crf_max"]) / 2.0, F.element_at(modes, F.floor(F.size(modes) / F.lit(2)).cast("int") + 1), (space["strength_min"] + space["strength_max"]) / 2.0, space)


def safe(crf: Column, space: dict[str, Column]) -> dict[str, Column]:
    """What to try again with after a failure: a lower crf, the first mode, the least strength."""
    return clamp(F.greatest(space["crf_min"], crf - 4.0), F.element_at(space["aq_modes"], 1), space["strength_min"], space)


def space_json(space: dict[str, Column]) -> Column:
    """A space as JSON, its keys in order."""
    names = {"aq_modes": "aq_modes", "aq_strength_is_integer": "integer_strength", "aq_strength_max": "strength_max", "aq_strength_min": "strength_min", "crf_max": "crf_max", "crf_min": "crf_min"}
    return F.to_json(F.struct(*[space[v].alias(k) for k, v in names.items()]))


#: Levels of compression and the quality that each aims at (fixed values).
LEVELS = {1: 85.0, 2: 89.0, 3: 93.0}


def level_target(level: Column) -> Column:
    """The target of a level; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)]), level.cast("int"))


def strength_grid(space: dict[str, Column], steps: int = 5) -> Column:
    """Every whole strength, or steps (2 at least) even ones."""
    n = max(2, steps)
    lo, span = space["strength_min"], space["strength_max"] - space["strength_min"]
    even = F.when(span > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + span * i / F.lit(n - 1))).otherwise(F.array(lo))
    whole = F.transform(F.sequence(F.bround(lo, 0).cast("int"), F.bround(space["strength_max"], 0).cast("int")), lambda i: i.cast("double"))
    return F.when(space["integer_strength"], whole).otherwise(even)


def interior_crfs(space: dict[str, Column], n: int) -> Column:
    """n even crf values strictly inside the range."""
    lo, hi, n = space["crf_min"], space["crf_max"], max(1, n)
    return F.when((hi <= lo) | F.lit(n == 1), F.array(0.5 * (lo + hi))).otherwise(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: lo + (hi - lo) * i / F.lit(n + 1)))
