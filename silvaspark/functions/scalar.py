"""Scalar functions and registries: wavelengths, spectral indices, band metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Index name -> formula and the wavelength in nm of each variable.
INDICES: dict[str, tuple[str, dict[str, float]]] = {"NDVI": ("try_divide(nir - red, nir + red)", {"nir": 850.0, "red": 650.0})}


#: Fixed value: the pattern of a wavelength in a band's name.
WAVELENGTH = r"(?i)(\d+(?:\.\d+)?)\s*(?:nm|nanometers?)"


def register_index(name: str, formula: str, wavelengths: dict[str, float]) -> None:
    INDICES[name.upper()] = (formula, dict(wavelengths))


def get_index(name: str) -> tuple[str, dict[str, float]]:
    try:
        return INDICES[name.upper()]
    except KeyError:
        raise ValueError(f"{name} is none of {sorted(INDICES)}") from None


def wavelength(name: Column) -> Column:
    """Number in front of nm or nanometer(s) in a band's name, any case, whatever follows; -1 without."""
    found = F.regexp_extract(name, WAVELENGTH, 1)
    return F.coalesce(F.when(found != "", found.cast("double")), F.lit(-1.0))


def band_names(description: Column, number: Column) -> Column:
    """A band's name: its description, or ``Band_`` and its number."""
    return F.coalesce(F.when(F.trim(description) != "", description), F.concat(F.lit("Band_"), number.cast("string")))


def map_wavelengths(bands: DataFrame, wanted: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """``variable, band, distance``: the band nearest to each wanted wavelength, the first on ties.

    ``bands`` are the few rows of one raster's header, which are grouped to one array; ``wanted`` a formula's
    variables. A variable that no band meets within ``tolerance`` has a NULL band.
    """
    every = bands.agg(F.array_sort(F.collect_list(F.struct("band", "wavelength"))).alias("a")).scalar()
    wanted = wanted.withColumn("every", every)
    ranked = F.array_min(F.transform("every", lambda b: F.struct(F.abs(b["wavelength"] - F.col("target")).alias("d"), b["band"].alias("b"))))
    out = wanted.select("variable", "target", ranked.alias("m"))
    return out.select("variable", F.when(F.col("m.d") <= tolerance, F.col("m.b")).alias("band"), F.col("m.d").alias("distance"))


def check_mapped(mapped: DataFrame) -> dict[str, int]:
    """The mapping of a formula's variables as a dict; ValueError if one has no band."""
    rows = {r.variable: r.band for r in mapped.collect()}
    if missing := sorted(k for k, v in rows.items() if v is None):
        raise ValueError(f"no band near the wavelength of {', '.join(missing)}")
    return rows
