"""A recipe as the text of a processing profile, and colour tables as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATOR = "gallerist"


def _three(c: Column) -> Column:
    finite = F.when(F.isnan(c) | F.abs(c).isin(float("inf")), F.lit(0.0)).otherwise(c)
    return F.format_string("%.3f", F.coalesce(finite, F.lit(0.0)).cast("double"))


def _percent(c: Column) -> Column:
    """Whole hundredths; noise far behind them doesn't tell which way a half goes."""
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6) * 100).cast("int").cast("string")


def _section(name: str, *lines: Column | str) -> Column:
    return F.concat(F.lit(f"\n[{name}]\n"), *[F.concat(x if isinstance(x, Column) else F.lit(x), F.lit("\n")) for x in lines])


def profile_text(recipe: Column, generator: str = GENERATOR) -> Column:
    """The profile: sections in a fixed order, those without effect switched off, the lens section left out."""
    # The sections and keys that the renderer reads.
    r = recipe
    off = F.lit("Enabled=false")
    on = lambda name, test, *lines: F.when(test, _section(name, "Enabled=true", *lines)).otherwise(_section(name, off))
    return F.concat(
        F.lit(f"# One photo's settings, made by {generator} to go over the neutral profile; the next run writes them anew.\n"),
        _section("Exposure", "Auto=false", F.concat(F.lit("Compensation="), _three(r["exposure_ev"]))),
        on("HLRecovery", r["highlight_recovery"] > 0, F.when(r["highlight_recovery"] < 0.5, "Method=Blend").otherwise("Method=Coloropp")),
        on("Shadows & Highlights", r["shadow_lift"] > 0, F.concat(F.lit("Shadows="), _percent(r["shadow_lift"])), "Highlights=0"),
        _section("White Balance", "Enabled=true", "Setting=Camera"),
        on(
            "Directional Pyramid Denoising", (r["denoise_luma"] > 0) | (r["denoise_chroma"] > 0), "Method=Lab", "CMethod=MAN",
            F.concat(F.lit("Luma="), _percent(r["denoise_luma"])), F.concat(F.lit("Chroma="), _percent(r["denoise_chroma"])),
        ),
        on(
            "PostDemosaicSharpening", r["sharpen_amount"] > 0, "AutoContrast=false", "AutoRadius=false",
            F.concat(F.lit("Contrast="), _percent(r["sharpen_amount"])), "DeconvRadius=0.750",
        ),
        F.when(r["lens_correct"], _section("LensProfile", "LcMode=lfauto", "UseDistortion=true", "UseVignette=true", "UseCA=false")).otherwise(F.lit("")),
    )
