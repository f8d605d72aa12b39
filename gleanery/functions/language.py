"""Language tags as the engine names them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import let

# Tags of the two Chinese scripts and the selectable targets.
SIMPLIFIED = ["zh", "zh-cn", "zh-sg", "zh-hans"]
TRADITIONAL = ["zh-tw", "zh-hk", "zh-mo", "zh-hant"]
TARGETS = ["zh", "zh-Hant", "en", "ja", "ko", "fr", "de", "es"]


def _any_prefix(tags: list[str]) -> str:
    return rf"^(?:{'|'.join(tags)})(?:-|\z)"


def api_tag(tag: Column) -> Column:
    """Chinese by script, every other tag by its primary subtag."""
    return let(
        F.lower(tag),
        lambda t: F.when(t == "zh", "zh")
        .when(t.rlike(_any_prefix(TRADITIONAL)), "zh-Hant")
        .when(t.rlike(_any_prefix(SIMPLIFIED)), "zh")
        .otherwise(F.get(F.split(t, "-"), F.lit(0))),
    )


def pick_target(explicit: Column, setting: Column, always: Column, supported: Column, interface: Column) -> Column:
    """Explicit target, else the configured one when always on and supported."""
    chosen = F.trim(explicit)
    configured = F.when(setting != "auto", setting).otherwise(F.when(interface == "zh", "zh").otherwise("en"))
    return F.when(chosen != "", chosen).when(always & supported, configured)
