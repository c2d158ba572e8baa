"""Versions of three numbers: their order, and what a recorded one says of an installation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The states of an installation, and of one that another is put over.
NOT_INSTALLED, INVALID, MISSING, CURRENT, OUTDATED, MISMATCH = "not_installed", "metadata_invalid", "metadata_missing", "current", "outdated", "version_mismatch"
NEW, UNTRACKED, SAME, UPDATED, NEWER, DIFFERENT = "new_install", "replaced_untracked_install", "reinstalled_same_version", "updated_outdated_install", "replaced_newer_install", "replaced_different_version"


def version_triple(x: Column) -> Column:
    """The three numbers before any "-" or "+"; null unless there are exactly three. Structs of them order as versions do."""
    parts = F.split(F.regexp_extract(x, "^[^-+]*", 0), r"\.", -1)
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,20}\z"))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("decimal(20,0)")
    return F.when(whole, F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch")))


#: Fixed values of the standard of semantic versions: a number, and an identifier of a tail.
NUMBER, IDENTIFIER = "(?:0|[1-9][0-9]*)", "[0-9A-Za-z-]+"


def well_formed(x: Column) -> Column:
    """Whether x is a semantic version: three numbers without leading zeros, then a pre-release and a build, each if any."""
    tail = lambda sign: rf"(?:{sign}{IDENTIFIER}(?:\.{IDENTIFIER})*)?"
    return x.rlike("^" + r"\.".join([NUMBER] * 3) + tail("-") + tail(r"\+") + r"\z")


def version_order(a: Column, b: Column) -> Column:
    """older, same or newer: what a is to b; unknown where either is no version."""
    x, y = version_triple(a), version_triple(b)
    return F.when(x.isNull() | y.isNull(), "unknown").when(x < y, "older").when(x == y, "same").otherwise("newer")


def installed_status(exists: Column, readable: Column, recorded: Column, running: Column) -> Column:
    """What the recorded version of what is there (exists; its record readable, null for none) is to the running one."""
    return (
        F.when(~exists, NOT_INSTALLED)
        .when(~readable, INVALID)
        .when(recorded.isNull(), MISSING)
        .when(recorded == running, CURRENT)
        .when(version_order(recorded, running) == "older", OUTDATED)
        .otherwise(MISMATCH)
    )


def replaced_status(existed: Column, recorded: Column, new: Column) -> Column:
    """What putting the version new over a recorded one amounts to."""
    order = version_order(recorded, new)
    return F.when(~existed, NEW).when(recorded.isNull(), UNTRACKED).when(recorded == new, SAME).when(order == "older", UPDATED).when(order == "newer", NEWER).otherwise(DIFFERENT)
