"""Filters, gates and rule checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import cosine

# Transfer functions that mark a video as HDR.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
SDR_COLORS = {"primaries": "bt709", "transfer": "bt709", "space": "bt709", "range": "tv"}


def min_score(df: DataFrame, threshold: float, column: str = "det_score") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit(0.0)) >= threshold)


def with_similarity(df: DataFrame, reference: Column, column: str = "embedding", name: str = "similarity"):
    return df.withColumn(name, cosine(F.col(column), reference))


def min_similarity(
    df: DataFrame, reference: Column, threshold: float, *, column: str = "embedding", name: str = "similarity"
) -> DataFrame:
    """Keep rows with an embedding at least ``threshold`` similar to ``reference``."""
    usable = df.filter(F.col(column).isNotNull())
    return with_similarity(usable, reference, column, name).filter(F.col(name) >= threshold)


def sample_every(df: DataFrame, every: int, index: str = "frame_index") -> DataFrame:
    """The reference's sampling interval: one row in ``every`` by index."""
    return df.filter(F.col(index) % max(1, int(every)) == 0)


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(transfer.isin(*HDR_TRANSFERS), F.lit(False))


def hdr_policy(df: DataFrame, policy: str, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Resolve output colours; under ``reject`` an HDR row becomes a violation."""
    if policy not in ("reject", "tonemap", "passthrough"):
        raise ValueError("policy must be reject, tonemap or passthrough")
    hdr = is_hdr(F.col("color_transfer"))
    settings = settings or {}
    resolved = []
    for part, fixed in SDR_COLORS.items():
        source = F.col(f"color_{part}") if f"color_{part}" in df.columns else F.lit(None).cast("string")
        value = F.coalesce(F.lit(settings.get(part)).cast("string"), source)
        if policy == "tonemap":
            value = F.when(hdr, F.lit(fixed)).otherwise(value)
        resolved.append(value.alias(f"out_{part}"))
    violation = F.when(hdr, F.lit("hdr_rejected")) if policy == "reject" else F.lit(None).cast("string")
    return df.select("*", hdr.alias("hdr"), *resolved, violation.alias("violation"))


def track_gate(
    summary: DataFrame, *, min_coverage: float = 0.05, max_ambiguous: float = 0.15, strict: bool = False
) -> DataFrame:
    """Add ``violation``; in strict mode a violation fails the query instead."""
    reason = F.when(F.col("coverage") < min_coverage, F.lit("low_coverage")).when(
        F.col("ambiguous_ratio") > max_ambiguous, F.lit("too_ambiguous")
    )
    if strict:
        message = F.concat(F.lit("track gate failed: "), reason)
        reason = F.when(reason.isNotNull(), F.raise_error(message).cast("string"))
    return summary.withColumn("violation", reason)


def check_rules(df: DataFrame, keys: list[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule. A rule is a condition that must hold; null counts as broken."""
    broken = F.array_compact(
        F.array(
            *(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())
        )
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


# Enumerations accepted in a profile.
PROFILE_ENUMS = {
    "variant": ("faster", "dwpose", "mediapipe"),
    "sample_solver": ("unipc", "dpm++"),
    "seed_mode": ("absolute_frame", "fixed"),
    "hdr_policy": ("tonemap", "reject", "passthrough"),
    "cleanup_mode": ("adaptive", "always", "never"),
    "interpolation": ("linear", "cubic", "lanczos"),
    "decoder": ("auto", "opencv", "ffmpeg", "ffmpeg_cuda"),
    "vae_dtype": ("auto", "bfloat16", "float16", "float32"),
}
PROFILE_SIZES = ("832*480", "1280*720")


def profile_rules(columns: list[str]) -> dict[str, Column]:
    """The rules for the columns a profiles table has.

    A rule applies where all its columns are there; ``max_target_faces`` alone is held against the default of one
    face. Columns without a rule are not checked.
    """
    c = F.col
    if "max_target_faces" in columns and "max_faces" not in columns:
        most = F.lit(1)
    else:
        most = c("max_faces")
    rules = {
        "frame_num": (c("frame_num") >= 5) & (c("frame_num") % 4 == 1),
        "sample_fps": c("sample_fps") > 0,
        "sample_steps": c("sample_steps") > 0,
        "overlap": (c("overlap") >= 0) & (c("overlap") < c("frame_num")),
        "ambiguity_margin": c("ambiguity_margin") >= 0,
        "min_coverage": c("min_coverage").between(0, 1),
        "max_ambiguous": c("max_ambiguous").between(0, 1),
        "cleanup_ratio": (c("cleanup_ratio") > 0) & (c("cleanup_ratio") <= 1),
        "max_target_faces": c("max_target_faces") <= most,
        "size": F.trim("size").isin(*PROFILE_SIZES),
    }
    rules.update({name: F.lower(F.trim(c(name))).isin(*values) for name, values in PROFILE_ENUMS.items()})
    needs = {"overlap": ("overlap", "frame_num")}
    return {name: rule for name, rule in rules.items() if all(x in columns for x in needs.get(name, (name,)))}


def skip_zero_opacity(df: DataFrame, opacity: str = "opacity") -> DataFrame:
    return df.filter(F.col(opacity) > 0)


def opacity_counts(df: DataFrame, keys: list[str], opacity: str = "opacity") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.when(F.col(opacity) > 0, 1)).alias("kept"),
        F.count(F.when(F.col(opacity) <= 0, 1)).alias("skipped"),
    )


def validate_videos(df: DataFrame) -> DataFrame:
    """Add ``valid``: fps, width and height must be positive."""
    positive = (F.col("fps") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    return df.withColumn("valid", F.coalesce(positive, F.lit(False)))
