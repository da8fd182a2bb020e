"""Scalar functions as column expressions: everything stays in generated code, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of booleans, and month names by their first three letters.
TRUE_WORDS = ("t", "true", "y", "yes", "1")
FALSE_WORDS = ("f", "false", "n", "no", "0", "")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def alphanumeric(s: Column) -> Column:
    """Letters and digits of any script; the rest and underscores go."""
    return F.regexp_replace(s, r"(?U)[\W_]+", "")


def month_to_int(s: Column) -> Column:
    """Month number of a header, 0 if it names none.

    A digit among the first two alphanumeric characters makes it a number (1 to 12, else 0) of all its digits;
    otherwise the first three letters count.
    """
    plain = F.lower(alphanumeric(s))
    digits = F.try_to_number(F.regexp_replace(plain, "[^0-9]", ""), F.lit("999999999")).cast("int")
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(plain, 1, 3)).cast("int")
    return F.when(F.substring(plain, 1, 2).rlike("[0-9]"), F.coalesce(F.when(digits.between(1, 12), digits), F.lit(0))).otherwise(named)


def str_to_bool(s: Column) -> Column:
    word = F.lower(F.trim(s))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def is_int(s: Column) -> Column:
    return s.try_cast("long").isNotNull()


def round_to_scale(value: Column, scale: list[float], direction: str = "nearest") -> Column:
    """Snap to an ascending scale: down, up or nearest (of two equally near, the lower); its ends hold beyond it.

    Without a scale, to a whole number: cut off, up, or nearest (half to even).
    """
    if not scale:
        whole = {"down": F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)), "up": F.ceil(value), "nearest": F.bround(value)}
        return whole[direction].cast("double")
    steps = F.array(*(F.lit(float(s)) for s in sorted(scale)))
    low = F.coalesce(F.array_max(F.filter(steps, lambda s: s <= value)), F.array_min(steps))
    high = F.coalesce(F.array_min(F.filter(steps, lambda s: s >= value)), F.array_max(steps))
    if direction == "down":
        return low
    if direction == "up":
        return high
    return F.when(value - low <= high - value, low).otherwise(high)


def round_list_to(values: Column, scale: list[float], direction: str = "nearest") -> Column:
    """An array with every element snapped."""
    return F.transform(values, lambda v: round_to_scale(v, scale, direction))


def gaussian(distance: Column, sigma: float = 4.0) -> Column:
    return F.exp(-distance * distance / (2 * sigma * sigma))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def monomials(columns: list[Column], degree: int) -> list[Column]:
    """All products of at most `degree` of the columns, the constant first, in multiset order."""
    from itertools import combinations_with_replacement

    out = []
    for pick in combinations_with_replacement([F.lit(1.0), *columns], degree):
        product = pick[0] if pick else F.lit(1.0)
        for c in pick[1:]:
            product = product * c
        out.append(product)
    return out


def evaluate_polynomial(coefficients: Column, columns: list[Column], degree: int) -> Column:
    terms = F.array(*monomials(columns, degree))
    return F.aggregate(F.zip_with(coefficients, terms, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def region_level(code: Column) -> Column:
    """1 for `a`, 2 for `a.b`, 3 for `a.b.c`."""
    return F.length(code) - F.length(F.replace(code, F.lit("."), F.lit(""))) + 1


def parent_region(code: Column) -> Column:
    return F.regexp_replace(code, r"\.[^.]+$", "")


def intensity(value: Column, low: Column | float, high: Column | float) -> Column:
    """Linear scaling to 0..255, clipped, cut off to a whole number."""
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    return F.try_divide(255 * (F.least(F.greatest(value, low), high) - low), high - low).cast("int")


def abbreviation(label: Column) -> Column:
    """First two letters of each word of a label of several words, joined by `. `; one word stays."""
    words = F.split(label, r"\s+")
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.left(w, F.lit(2))), ". ")).otherwise(label)


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.rtrim(path, F.lit("/")), F.lit(suffix))


def run_suffix(month: Column, level_up: Column, buffer_m: Column, pca: Column, validate: Column, seed: Column) -> Column:
    """month{m}[-LvlUp][-{b}meter][-PCA][-{v-1:.2f}_{seed}]."""
    return F.concat(
        F.format_string("month%d", month),
        F.when(level_up, F.lit("-LvlUp")).otherwise(""),
        F.when(buffer_m > 0, F.format_string("-%dmeter", buffer_m)).otherwise(""),
        F.when(pca, F.lit("-PCA")).otherwise(""),
        F.when((validate >= 1) & (validate < 2), F.format_string("-%.2f_%d", validate - 1, seed)).otherwise(""),
    )


def metric_line(line: Column) -> list[Column]:
    """Parts of `value,.../year/month{m}-.../RegType_Region/predictions/Method.csv`."""
    path = F.split(F.substring_index(line, ",", -1), "/")
    part = lambda k: F.element_at(path, k)
    return [
        F.substring_index(line, ",", 1).cast("double").alias("value"),
        part(-5).cast("int").alias("year"),
        F.regexp_replace(F.substring_index(part(-4), "-", 1), "[a-zA-Z]", "").cast("int").alias("month"),
        F.substring_index(part(-3), "_", 1).alias("reg_type"),
        F.regexp_replace(part(-3), "^[^_]*_", "").alias("region"),
        F.regexp_replace(part(-1), r"\.csv$", "").alias("method"),
    ]


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def strip_label(s: Column) -> Column:
    """The text before the first bar, without blanks at its end."""
    return F.rtrim(F.substring_index(s, "|", 1))


def last_day(year: Column, month: Column) -> Column:
    """The number of days of a month."""
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def date_sequence(first: Column, last: Column, step: str = "1 day") -> Column:
    """All dates from first to last by a step of days or months, as an array; empty if last is before first."""
    return F.when(last >= first, F.sequence(first, last, F.expr(f"interval {step}"))).otherwise(F.array().cast("array<date>"))


def zero_padded(number: Column, width: int = 4) -> Column:
    """A whole number with zeros before it; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def label_with_abbreviation(short: Column, label: Column) -> Column:
    return F.concat_ws(" : ", short, label)


# The names that terrain features have in files, and the abbreviations of their names.
FEATURE_NAMES = {
    "Hillshading": "Hillshading",
    "Aspect": "Aspect",
    "Channel Network Base Level": "Channel Network Base Level",
    "Channel Network Distance": "Channel Network Distance",
    "Closed Depressions": "Closed Depressions",
    "Convergence Index": "Convergence Index",
    "Elevation": "Elevation",
    "LS Factor": "LS Factor",
    "Plan Curvature": "Plan Curvature",
    "Profile Curvature": "Profile Curvature",
    "Relative Slope Position": "Relative Slope Position",
    "Slope": "Slope",
    "TWI": "TWI",
    "Total Catchment Area": "Total Catchment Area",
    "Valley Depth": "Valley Depth",
    "CONUS_DEM1km": "Elevation",
    "Analytical_Hillshading": "Hillshading",
    "Channel_Network_Base_Level": "Channel Network Base Level",
    "Closed_Depressions": "Closed Depressions",
    "Convergence_Index": "Convergence Index",
    "Cross-Sectional_Curvature": "Plan Curvature",
    "Flow_Accumulation": "Total Catchment Area",
    "Longitudinal_Curvature": "Profile Curvature",
    "LS_Factor": "LS Factor",
    "Relative_Slope_Position": "Relative Slope Position",
    "Topographic_Wetness_Index": "TWI",
    "Valley_Depth": "Valley Depth",
    "Vertical_Distance_to_Channel_Network": "Channel Network Distance",
}
FEATURE_SHORT = {
    "Hillshading": "Hill",
    "Aspect": "Asp",
    "Channel Network Base Level": "CNBL",
    "Channel Network Distance": "CND",
    "Closed Depressions": "CD",
    "Convergence Index": "CI",
    "Elevation": "Ele",
    "LS Factor": "LSF",
    "Plan Curvature": "PlCu",
    "Profile Curvature": "PrCu",
    "Relative Slope Position": "RSP",
    "Slope": "Slo",
    "TWI": "TWI",
    "Total Catchment Area": "TCA",
    "Valley Depth": "VD",
}


def _looked_up(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def feature_name(raw: Column) -> Column:
    """The name of a feature; null of one that is not known."""
    return _looked_up(FEATURE_NAMES, raw)


def feature_short(raw: Column) -> Column:
    return _looked_up(FEATURE_SHORT, feature_name(raw))
