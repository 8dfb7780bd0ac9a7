"""Canonical spelling of ids and names, as column expressions that stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The account name that stands for an unknown account.
DELETED = "[deleted]"


def canonical_id(col: Column | str) -> Column:
    """Blanks (spaces, tabs) at both ends removed, lower case; null and blank give null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t"))), F.lit(""))


def canonical_name(col: Column | str) -> Column:
    """As canonical_id, then one leading ``r/`` removed."""
    return F.nullif(F.regexp_replace(canonical_id(col), r"^r/", ""), F.lit(""))


def known_account(col: Column | str) -> Column:
    """canonical_id, with the unknown account as null."""
    return F.nullif(canonical_id(col), F.lit(DELETED))
