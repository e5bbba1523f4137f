"""Multilingual sector labels and their canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.functions.parse import normal_text

# Raw sector label (lower case) to canonical name.
SECTOR_MAP = {
    "food security": "food security",
    "nutrition": "nutrition",
    "health": "health",
    "education": "education",
    "agriculture": "agriculture",
    "logistics": "logistics",
    "protection": "protection",
    "child protection": "protection - child protection",
    "protection - child protection": "protection - child protection",
    "gender-based violence (gbv)": "protection - gender-based violence",
    "protection - gender-based violence": "protection - gender-based violence",
    "mine action": "protection - mine action",
    "protection - mine action": "protection - mine action",
    "water, sanitation and hygiene": "wash",
    "water sanitation hygiene": "wash",
    "wash": "wash",
    "emergency shelter and nfi": "shelter and nfi",
    "shelter and nfi": "shelter and nfi",
    "shelter and non-food items": "shelter and nfi",
    "shelter and nfis": "shelter and nfi",
    "multipurpose cash": "multipurpose cash",
    "multi-purpose cash": "multipurpose cash",
    "emergency telecommunications": "emergency telecommunications",
    "camp coordination / management": "cccm",
    "camp coordination and camp management": "cccm",
    "cccm": "cccm",
    "housing, land and property": "protection - housing, land and property",
    "protection - housing, land and property": "protection - housing, land and property",
    "early recovery": "early recovery",
    "coordination": "coordination",
    "coordination and support services": "coordination",
    "refugee response": "refugee response",
    "general protection": "protection",
    "protection (overall)": "protection",
    "santé": "health",
    "éducation": "education",
    "logistique": "logistics",
    "sécurité alimentaire": "food security",
    "eau, hygiène et assainissement": "wash",
    "eau, hygiene et assainissement": "wash",
    "abris et biens non-alimentaires": "shelter and nfi",
    "abris": "shelter and nfi",
    "abris&nfi": "shelter and nfi",
    "protection de l'enfant": "protection - child protection",
    "violence basée sur le genre (vbg)": "protection - gender-based violence",
    "lutte antimines": "protection - mine action",
    "logement, terres et propriété": "protection - housing, land and property",
    "réponse aux réfugiés": "refugee response",
    "protection générale": "protection",
    "coordination et organisation de camp": "cccm",
    "cash à usage multiple caseload": "multipurpose cash",
    "tranferts monetaires a usage multiples": "multipurpose cash",
    "transfert en espèce à usage multiple": "multipurpose cash",
    "cash a usage multiple": "multipurpose cash",
    "articles ménagers essentiels": "shelter and nfi",
    "récupération rapide": "early recovery",
    "récupération précoce": "early recovery",
    "salud": "health",
    "educación": "education",
    "educación en emergencias": "education",
    "seguridad alimentaria y nutrición": "food security",
    "seguridad alimentaria": "food security",
    "agua, saneamiento e higiene": "wash",
    "albergue y artículos no alimentarios": "shelter and nfi",
    "protección de la infancia": "protection - child protection",
    "violencia de género (vdg)": "protection - gender-based violence",
    "acción contra minas": "protection - mine action",
    "protección (total)": "protection",
    "protección": "protection",
    "protección general": "protection",
    "coordinación y gestión de campamentos": "cccm",
    "coordinación y gestión de albergues": "cccm",
    "recuperación temprana": "early recovery",
    "nutrición": "nutrition",
    "food security and livelihoods": "food security",
    "food security conflict response": "food security",
    "food security natural disasters response": "food security",
    "health conflict response": "health",
    "water, sanitation and hygiene conflict response": "wash",
    "shelter/nfis conflict response": "shelter and nfi",
    "total - snfi": "shelter and nfi",
    "camp coordination and camp management conflict response": "cccm",
    "camp coordination and camp management natural disaster response": "cccm",
    "child protection natural disaster": "protection - child protection",
    "gender based violence natural disaster": "protection - gender-based violence",
    "general protection natural disaster": "protection",
    "education natural disasters response": "education",
    "anticipatory - food security": "food security",
    "readiness - food security": "food security",
    "anticipatory - wash": "wash",
    "readiness - wash": "wash",
    "total - wash": "wash",
    "anticipatory - nutrition": "nutrition",
    "total - nutrition": "nutrition",
    "anticipatory - education": "education",
    "readiness - education": "education",
    "total - education": "education",
    "anticipatory - cccm": "cccm",
    "readiness - cccm": "cccm",
    "total - cccm": "cccm",
    "anticipatory - snfi": "shelter and nfi",
    "anticipatory - protection (overall)": "protection",
    "readiness - early recovery": "early recovery",
    "total - early recovery": "early recovery",
    "mpc caseload": "multipurpose cash",
}


def with_canonical_label(
    df: DataFrame, source: str, target: str, mapping: dict[str, str] | None = None
) -> DataFrame:
    """Add ``target``: the canonical name of raw label ``source``, null where the map has none.

    A hash lookup by join; how the map travels is left to adaptive execution.
    """
    pairs = SECTOR_MAP if mapping is None else mapping
    known = df.sparkSession.createDataFrame(list(pairs.items()), "_label string, _canonical string")
    label = normal_text(F.col(f"`{source}`"))
    joined = df.join(known, label == F.col("_label"), "left")
    return joined.withColumn(target, F.col("_canonical")).drop("_label", "_canonical")
