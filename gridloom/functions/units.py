"""Unit conversions as columns: each multiplies or divides by one constant, or adds one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Definitions of the units.
FT2_PER_ACRE = 43560.0
FT3_PER_BBL = 5.614583333333333
DEGR_AT_0_DEGF = 459.67
M_PER_FT = 0.3048
M3_PER_BBL = 0.158987294928
BAR_PER_PSI = 0.0689475729316836
M2_PER_MD = 9.869233e-16
M3_PER_MCM = 1e6
SM3_PER_MSM3 = 1e6
SM3_PER_BCM = 1e9
SCF_PER_SM3 = 35.31466672148859
M2_PER_KM2 = 1e6

#: name -> (factor to multiply with, divisor).
FACTORS = {
    "acres_to_ft2": (FT2_PER_ACRE, 1.0),
    "acre_ft_to_ft3": (FT2_PER_ACRE, 1.0),
    "ft3_to_acre_ft": (1.0, FT2_PER_ACRE),
    "ft3_to_rb": (1.0, FT3_PER_BBL),
    "rb_to_ft3": (FT3_PER_BBL, 1.0),
    "ft_to_m": (M_PER_FT, 1.0),
    "m_to_ft": (1.0, M_PER_FT),
    "m3_to_bbl": (1.0, M3_PER_BBL),
    "bbl_to_m3": (M3_PER_BBL, 1.0),
    "psi_to_bar": (BAR_PER_PSI, 1.0),
    "bar_to_psi": (1.0, BAR_PER_PSI),
    "md_to_m2": (M2_PER_MD, 1.0),
    "m2_to_md": (1.0, M2_PER_MD),
    "m3_to_mcm": (1.0, M3_PER_MCM),
    "mcm_to_m3": (M3_PER_MCM, 1.0),
    "m3_to_msm3": (1.0, SM3_PER_MSM3),
    "msm3_to_m3": (SM3_PER_MSM3, 1.0),
    "m3_to_bcm": (1.0, SM3_PER_BCM),
    "bcm_to_m3": (SM3_PER_BCM, 1.0),
    "scf_to_sm3": (1.0, SCF_PER_SM3),
    "sm3_to_scf": (SCF_PER_SM3, 1.0),
    "stb_to_sm3": (M3_PER_BBL, 1.0),
    "sm3_to_stb": (1.0, M3_PER_BBL),
    "km2_to_m2": (M2_PER_KM2, 1.0),
    "m2_to_km2": (1.0, M2_PER_KM2),
}


def convert(name: str, x: Column) -> Column:
    if name == "degf_to_degr":
        return degf_to_degr(x)
    times, over = FACTORS[name]
    return x * F.lit(times) if over == 1.0 else x / F.lit(over)


def degf_to_degr(x: Column) -> Column:
    return x + F.lit(DEGR_AT_0_DEGF)


def _named(name: str):
    def f(x: Column) -> Column:
        return convert(name, x)

    f.__name__, f.__doc__ = name, f"{name.replace('_to_', ' to ')}."
    return f


globals().update({name: _named(name) for name in FACTORS})


def format_volume(m3: Column) -> Column:
    """Cubic metres as text with one decimal: bcm from 1e9, mcm from 1e6, else m³."""
    size = F.abs(m3)
    return (
        F.when(size >= SM3_PER_BCM, F.format_string("%.1f bcm", m3 / SM3_PER_BCM))
        .when(size >= M3_PER_MCM, F.format_string("%.1f mcm", m3 / M3_PER_MCM))
        .otherwise(F.format_string("%.1f m³", m3))
    )
