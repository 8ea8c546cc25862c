"""From measured positions and metadata to a clean sample table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions import labels as L
from wavecohort.operators import cleaning as C
from wavecohort.plans.recipes import PP1, PP2


def clean_metadata(meta: DataFrame, grade: str, sex: str, subtype: str) -> DataFrame:
    """Canonical grade, sex and subtype."""
    return meta.withColumns({
        "grade": L.norm_grade(F.col(grade)), "sex": L.norm_sex(F.col(sex)), "subtype": L.map_subtype(F.col(subtype)),
    }).drop(*[c for c in (grade, sex, subtype) if c not in ("grade", "sex", "subtype")])


def prepare_signals(positions: DataFrame, meta: DataFrame, probe: str, position: str, source_file: str, sample: str,
                    meta_key: str, spectra: str = "spectra", presets: bool = True) -> DataFrame:
    """Deduplicate, attach metadata and give one row per signal with its two processed forms.

    Signals stay in rows from here on; per-sample arrays are never built.
    """
    unique = C.dedup_lowest_session(positions, probe, position, source_file, [sample])
    joined = C.join_metadata(unique, meta, probe, meta_key)
    keep = [c for c in joined.columns if c != spectra]
    rows = C.explode_signals(joined, spectra, keep).withColumnRenamed("features", "raw")
    return rows.withColumns({"pp1": PP1.apply(F.col("raw")), "pp2": PP2.apply(F.col("raw"))}) if presets else rows
