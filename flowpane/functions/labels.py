"""Column expressions over label and category text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowpane.functions import vocabulary as V


def canonical_label(c: Column) -> Column:
    """Trim; the upper-case spelling of benign becomes the canonical one."""
    t = F.trim(c)
    return F.when(t == "BENIGN", V.BENIGN).otherwise(t)


def label_from_category(category: Column, flag: Column) -> Column:
    """A label from an attack-category column that is blank or null for normal flows, and a 0/1 flag that wins."""
    t = F.coalesce(F.trim(category), F.lit(""))
    renamed = t
    for old, new in V.CATEGORY_RENAMES.items():
        renamed = F.when(t == old, new).otherwise(renamed)
    normal = t.isin(*V.MISSING_CATEGORIES, "Normal") | F.coalesce(flag == 0, F.lit(False))
    return F.when(normal, V.BENIGN).otherwise(renamed)


def normalise_attack(c: Column) -> Column:
    """Attack name, or null where the text is blank or says benign."""
    t = F.trim(c)
    renamed = t
    for old, new in V.ATTACK_RENAMES.items():
        renamed = F.when(t == old, new).otherwise(renamed)
    return F.when((t == "") | t.isin(*V.BENIGN_SPELLINGS), None).otherwise(renamed)


def ascii_label(c: Column, fallback: Column | None = None) -> Column:
    """Plain-ASCII text: dash variants and arrows are spelled out, the rest of the non-ASCII range is dropped."""
    t = F.translate(c, V.DASHES, "-" * len(V.DASHES))
    for arrow, text in V.ARROWS.items():
        t = F.replace(t, F.lit(arrow), F.lit(text))
    t = F.regexp_replace(t, r"[^\x00-\x7F]", "")
    return t if fallback is None else F.when(F.trim(t) == "", fallback).otherwise(t)


def is_malicious(c: Column, benign: str = V.BENIGN) -> Column:
    """1 for any label but benign; a missing label is not benign."""
    return F.coalesce(c != benign, F.lit(True)).cast("int")
