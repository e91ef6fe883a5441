"""Column functions for measures, validation results and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nist import bound

# Histogram bounds of the measures with ten bins.
BOUNDS = {
    "FDA": (0.268, 0.304, 0.33, 0.355, 0.38, 0.407, 0.44, 0.50, 1.0),
    "LCS": (0.0, 0.70, 0.74, 0.77, 0.79, 0.81, 0.83, 0.85, 0.87),
    "OCL": (0.337, 0.479, 0.579, 0.655, 0.716, 0.766, 0.81, 0.852, 0.898),
    "OF": (0.01715, 0.035, 0.0557, 0.081, 0.115, 0.1718, 0.2569, 0.4758, 0.748),
    "RVUP": (0.5, 0.667, 0.8, 1.0, 1.25, 1.5, 2.0, 24.0, 30.0),
}
# Measures by the range that maps them to quality blocks.
RANGES = {
    (0.0, 255.0): ("Mu", "MMB", "ImgProcROIArea_Mean"),
    (0.0, 1.0): ("FJFXPos_OCL_MinutiaeQuality_80", "OrientationMap_ROIFilter_CoherenceRel", "FJFXPos_Mu_MinutiaeQuality_2", "FDA_Bin10_Mean", "LCS_Bin10_Mean", "OCL_Bin10_Mean", "FDA_Bin10_StdDev", "LCS_Bin10_StdDev", "OCL_Bin10_StdDev", "OF_Bin10_StdDev"),
    (0.0, 3150.0): ("OrientationMap_ROIFilter_CoherenceSum",),
    (-4 / 86, 176 / 86): ("OF_Bin10_Mean",),
}
COUNTS = ("FingerJetFX_MinutiaeCount", "FingerJetFX_MinCount_COMMinRect200x200")
SIGMOIDS = ("RVUP_Bin10_Mean", "RVUP_Bin10_StdDev")
# Tolerances of measures by the start of their names; others have 0.001.
TOLERANCES = {"FDA_Bin10_": 0.1, "LCS_Bin10_": 0.1, "RVUP_Bin10_": 0.1, "OCL_Bin10_": 0.02, "OF_Bin10_": 0.02, "ImgProcROIArea_Mean": 0.02, "OrientationMap_ROIFilter_Coherence": 0.5, "SufficientFingerprintForeground": 100.0}


def _block_value(name: Column, value: Column) -> Column:
    out = F.when(name.isin(*COUNTS), F.floor(F.least(value, F.lit(100.0))))
    for (low, high), names in RANGES.items():
        out = out.when(name.isin(*names), F.floor(101.0 * ((value - low) / (high - low))))
    return out.when(name.isin(*SIGMOIDS), F.floor(100.0 / (1.0 + F.exp((1.0 - value) / 0.5)) + 0.5))


def quality_block(name: Column, value: Column) -> Column:
    """Quality-block value of a measure, null for other names or beyond a byte (see ``block_overflow``)."""
    out = _block_value(name, value)
    return F.when((out >= 0) & (out <= 255), out).cast("int")


def block_overflow(name: Column, value: Column) -> Column:
    """Whether a measure's quality-block value is no byte, which the format cannot hold."""
    out = _block_value(name, value)
    return F.coalesce((out < 0) | (out > 255), F.lit(False))


def tolerance(name: Column) -> Column:
    out = F.lit(0.001)
    for start, width in TOLERANCES.items():
        out = F.when(F.startswith(name, F.lit(start)), width).otherwise(out)
    return out


def feedback(sigma: Column, mean: Column, minutiae: Column, roi_pixels: Column) -> Column:
    """Map of the four actionable measures."""
    pairs = {"UniformImage": sigma, "EmptyImageOrContrastTooLow": mean, "FingerprintImageWithMinutiae": minutiae, "SufficientFingerprintForeground": roi_pixels}
    return F.create_map(*(x for name, value in pairs.items() for x in (F.lit(name), value.cast("double"))))


def shown(measures: Column, limit: int) -> Column:
    """The first ``limit`` entries (label, value) of a measure map by name; nulls left out, numbers as text."""
    kept = F.slice(F.array_sort(F.filter(F.map_entries(measures), lambda e: e["value"].isNotNull())), 1, limit)

    def fixed(v: Column, places: int) -> Column:
        # Rounds the exact binary value; exact ties go away from zero.
        eighths = v * (2 << places)
        tie = (eighths == F.floor(eighths)) & (F.pmod(eighths, F.lit(2.0)) == 1)
        return F.replace(F.format_number(F.when(tie, v + F.signum(v) * 10.0 ** -(places + 1)).otherwise(v), places), F.lit(","), F.lit(""))

    def text(v: Column) -> Column:
        places = F.when(F.abs(v) >= 10, fixed(v, 2)).otherwise(fixed(v, 3))
        return F.when(F.isnan(v), "Unavailable").when(v == F.floor(v), v.cast("long").cast("string")).otherwise(places)

    return F.transform(kept, lambda e: F.struct(e["key"].alias("label"), text(e["value"]).alias("value")))


def errors(*rules: tuple[Column, int]) -> Column:
    """Codes of all rules that are broken, in order; a rule is (broken, code)."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(code)) for broken, code in rules)))


def raster_errors(width: Column, height: Column, depth: Column, ppi: Column, size: Column) -> Column:
    """1 width, 2 height, 3 depth is not 8, 4 resolution is not 500, 5 byte count; all that apply."""
    right = F.when((width > 0) & (height > 0), width.cast("long") * height).otherwise(-1)
    return errors((width <= 0, 1), (height <= 0, 2), (depth != 8, 3), (ppi != 500, 4), (size != right, 5))


def encode_errors(width: Column, height: Column, depth: Column, rate: Column, encoder: Column, software: Column, size: Column) -> Column:
    """1 width, 2 height, 3 depth, 4 bit rate, 5 encoder number, 6 software number; 7 byte count if all else is right."""
    found = errors((width <= 0, 1), (height <= 0, 2), (depth != 8, 3), (rate <= 0, 4), (~encoder.between(0, 255), 5), (software.isNotNull() & ~software.between(0, 65535), 6))
    return F.when((F.size(found) == 0) & (size != width.cast("long") * height), F.array(F.lit(7))).otherwise(found)


def message(subject: str, texts: Column, empty: str | None = None) -> Column:
    """One message for an array of them: itself, or a headed list."""
    head = F.format_string(f"{subject} validation failed with %d issues:", F.size(texts))
    many = F.concat(head, F.lit("\n- "), F.array_join(texts, "\n- "))
    return F.when(F.size(texts) == 0, F.lit(empty or f"{subject} validation failed.")).when(F.size(texts) == 1, F.get(texts, 0)).otherwise(many)


def documentation(base: str, code: Column) -> Column:
    return F.concat(F.lit(base), F.lower(code))


def scaled(value: Column, top: int = 65535) -> Column:
    """Struct (raw, scale) with value = raw / 10^scale, as fine as ``top`` allows; null if too large."""
    made = lambda r, s: F.struct(r.cast("long").alias("raw"), s.cast("int").alias("scale"))

    def whole(v: Column) -> Column:
        reaches = lambda s: v * F.pow(F.lit(10.0), s) >= top
        # The logarithm is off by one step at most.
        near = F.ceil(F.log10(top / F.when((v > 0) & (v < top), v)))
        least = bound(near, lambda s: F.when((s > 0) & reaches(s - 1), s - 1).when(reaches(s), s).otherwise(s + 1))
        fine = bound(least - 1, lambda s: F.when(s < 40, made(F.floor(v * F.pow(F.lit(10.0), s) + 0.5), s)))
        return F.when(v == 0, made(F.lit(0), F.lit(0))).when((v > 0) & (v < top), fine)

    return bound(value, whole)


def comment(width: Column, height: Column, depth: Column, ppi: Column, rate: Column) -> Column:
    """NIST_COM text of an encoded image; an unknown resolution is -1."""
    value = lambda c: c.cast("string")
    lines = [F.lit("NIST_COM 9"), F.concat(F.lit("PIX_WIDTH "), value(width)), F.concat(F.lit("PIX_HEIGHT "), value(height)), F.concat(F.lit("PIX_DEPTH "), value(depth)), F.concat(F.lit("PPI "), value(F.when(ppi > 0, ppi).otherwise(-1))), F.lit("LOSSY 1"), F.lit("COLORSPACE GRAY"), F.lit("COMPRESSION WSQ"), F.concat(F.lit("WSQ_BITRATE "), F.format_string("%.6f", rate.cast("double")))]
    return F.concat_ws("\n", *lines)


def first_mismatch(a: Column, b: Column) -> Column:
    """First 0-based place where two arrays differ, -1 if they are equal; a missing end differs."""
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)))
    differs = F.filter(places, lambda i: ((i < F.size(a)) != (i < F.size(b))) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.coalesce(F.get(differs, 0), F.lit(-1)).cast("int")
