"""Cell ids and sensor aliases of the time-series tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeflow.functions.topics import as_col

# Sensor aliases and the subtopic each one stands for.
SENSOR_ALIASES = {
    "glucose mM": "glucose_mM",
    "glucose": "glucose_mM",
    "pH": "pH",
    "o2 percent": "o2_percent",
    "oxygen": "o2_percent",
    "pressure mbar": "pressure_mbar",
    "pressure": "pressure_mbar",
    "flow uL min": "flow_uL_min",
    "flow": "flow_uL_min",
    "viability percent": "hcs_viability_pct",
    "viability": "hcs_viability_pct",
    "cell count": "qpi_cell_count",
    "confluence": "qpi_confluence_pct",
    "dry mass": "qpi_dry_mass_pg",
    "ROS AU": "hcs_ROS_AU",
    "ROS IU": "hcs_ROS_IU",
    "Ca ratio": "hcs_Ca_ratio",
    "tumor proliferation": "tumor_prolif_index",
    "tumor EMT": "tumor_EMT_index",
    "aptamer IL6": "aptamer_IL6_nM",
    "aptamer TNFa": "aptamer_TNFa_nM",
    "barrier impedance": "barrier_impedance_kOhm",
}


def normalize_cell_id(text) -> Column:
    """``cell 2``, ``cell2`` and ``2`` become ``cell_2``; anything without a digit stays."""
    joined = F.replace(F.trim(as_col(text)), F.lit(" "), F.lit("_"))
    digits = F.regexp_extract(joined, r"\d+", 0)
    return F.when(joined.startswith("cell_") | (digits == ""), joined).otherwise(F.concat(F.lit("cell_"), digits))


def normalize_cell_list(text) -> Column:
    """Comma separated cell ids as an array of normalized ids."""
    return F.transform(F.split(as_col(text), ","), normalize_cell_id)


def resolve_sensor(alias, aliases: dict[str, str] | None = None) -> Column:
    """Subtopic of a sensor alias; an unknown alias passes through."""
    table = SENSOR_ALIASES if aliases is None else aliases
    alias = as_col(alias)
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), alias), alias)
