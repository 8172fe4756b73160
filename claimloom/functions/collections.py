"""Arrays and maps as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import nz


def known_sources(source_ids: Column, source: Column, matched: Column) -> Column:
    """All ids of sources that a sighting is known from, distinct and sorted; null and empty ones left out."""
    empty = F.array().cast("array<string>")
    ids = F.concat(F.coalesce(source_ids, empty), F.array(source), F.coalesce(matched, empty))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != ""))))


def overlay(old: Column, new: Column) -> Column:
    """The map ``old`` with the values of ``new`` that aren't empty laid over it."""
    return F.map_zip_with(_map(old), _map(new), lambda k, o, n: F.coalesce(nz(n), o))


def fill_first(old: Column, new: Column) -> Column:
    """The map ``old`` with its gaps filled from ``new``."""
    return F.map_zip_with(_map(old), _map(new), lambda k, o, n: F.coalesce(nz(o), n))


def _map(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast("map<string,string>"))


def first_filled(value: Column, order: Column) -> Column:
    """Aggregate: the first value in ``order`` that isn't null or empty."""
    return F.min_by(F.when(nz(value.cast("string")).isNotNull(), value), F.when(nz(value.cast("string")).isNotNull(), order))
