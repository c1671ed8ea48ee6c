"""Domain constants, as one frozen value that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Settings:
    """Fixed values of the domain: distances in metres, angles in degrees."""

    merge_radius_m: float = 600.0
    wide_radius_m: float = 2500.0
    block_cell_deg: float = 0.03
    name_similarity: float = 0.82
    min_name_length: int = 5
    stop_names: tuple[str, ...] = ("gaza", "israel", "palestine", "west bank", "jerusalem", "area c", "area a")
    coverage_cell_m: float = 100.0
    metres_per_degree: float = 111_320.0
    reference_latitude: float = 31.9
    reference_longitude: float = 35.2
    context_tolerance_deg: float = 1e-4
    municipal_tolerance_deg: float = 5e-5
    coordinate_digits: int = 6
    plausible_from: date = date(1967, 1, 1)
    withheld_prefix: str = "pom-"


SETTINGS = Settings()

# Closed vocabularies.
TYPE_MAP = {
    "settlement": "settlement",
    "outpost": "outpost",
    "ouptost": "outpost",
    "התנחלות": "settlement",
    "industrial area": "industrial_zone",
    "tourism": "industrial_zone",
    "touristic site": "industrial_zone",
    "planned": "settlement",
    "other": "settlement",
}
CATEGORY_KEYWORDS = {
    "demolition": ("demolition", "demolish", "razed", "bulldoz"),
    "forced_transfer": ("forced transfer", "forcible transfer", "displace", "eviction", "evict"),
    "settler_violence": ("settler attack", "settler violence", "settlers attack", "arson", "pogrom"),
    "land_confiscation": ("confiscat", "seizure", "seized", "expropriat", "land grab"),
    "settlement_expansion": ("settlement expansion", "outpost", "new settlement", "annexation"),
    "movement_restriction": ("checkpoint", "closure", "road block", "movement restriction"),
    "detention": ("arrest", "detention", "detainee", "administrative detention"),
    "killing": ("killed", "killing", "shot dead", "extrajudicial"),
    "property_damage": ("uprooted", "olive tree", "crops", "property damage", "vandal"),
    "water_access": ("water", "cistern", "well", "spring"),
}
RESOURCE_KEYWORDS = {
    "water": ("water", "well", "wells", "cistern", "irrigation", "water tank", "water pipe", "spring"),
    "agriculture": ("farmland", "crop", "irrigation", "harvest", "tree", "olive", "vineyard", "grove", "plough", "grazing", "pasture"),
    "livestock": ("livestock", "animal shelter", "chicken", "coop", "sheep", "goat", "dairy", "herd"),
    "home": ("home", "house", "residential", "dwelling", "toilet", "tent"),
    "property": ("car", "vehicle", "tractor", "camera", "fence", "wall", "gate", "household", "solar", "generator", "equipment", "smartphone"),
}
TRANSLITERATIONS = {
    "bayt": "beit", "bet": "beit", "dayr": "deir", "der": "deir", "ayn": "ein", "ain": "ein", "khirbat": "khirbet", "kharbat": "khirbet",
    "khurbat": "khirbet", "shaykh": "sheikh", "shikh": "sheikh", "om": "umm", "um": "umm", "qaryat": "qariat", "nazlat": "nazlet", "jabal": "jabel",
}
ARTICLES = ("al", "el", "as", "ash", "ad", "at", "az", "ar", "an", "ain", "ayn")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
STAGES = (1, 2, 3, 4, 5, 6, 7)
STAGE_LABELS = ("Land declared / seized", "Plan deposited", "Plan approved", "Tenders published", "Ground works", "Construction started", "Populated")
MECHANISM_LABELS = {
    "depopulation_1948": "Depopulated in 1948",
    "settlement_post_1967": "Israeli settlement (post-1967)",
    "land_transfer_mandate": "Mandate-era land transfer",
    "closed_military_area": "Closed military area",
    "barrier_severance": "Severed by the Barrier",
}
ENTITY_TYPES = ("settlement", "outpost", "ej_settlement", "industrial_zone")
CONFIDENCE_LEVELS = ("exact", "matched", "ambiguous", "unresolved")
