"""Features in schema-free JSON: what a document of unknown kind has to offer, by VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AREAS = ("Polygon", "MultiPolygon")


def _is_area(kind: Column) -> Column:
    return F.coalesce(kind.isin(*AREAS), F.lit(False))


def chosen_feature(text: Column) -> Column:
    """struct(kind, geometry, properties) of the boundary that a document has: a Feature is taken as it is, of a collection the
    first feature with an area, a bare area becomes a feature without properties. Null where there is none, and for texts that
    are no JSON; geometry and properties are VARIANT."""
    v = F.try_parse_json(text)
    at = lambda x, path, kind: F.try_variant_get(x, path, kind)
    kind = at(v, "$.type", "string")
    areas = F.filter(at(v, "$.features", "array<variant>"), lambda f: _is_area(at(f, "$.geometry.type", "string")))
    told = lambda name, geometry, properties: F.struct(F.lit(name).alias("kind"), geometry.alias("geometry"), properties.alias("properties"))
    none = F.lit(None).cast("variant")
    own = told("Feature", at(v, "$.geometry", "variant"), at(v, "$.properties", "variant"))
    first = F.get(areas, F.lit(0))
    of_many = F.when(first.isNotNull(), told("FeatureCollection", at(first, "$.geometry", "variant"), at(first, "$.properties", "variant")))
    return F.when(kind == "Feature", own).when(kind == "FeatureCollection", of_many).when(_is_area(kind), told("geometry", v, none))


def rings_of(geometry: Column) -> Column:
    """The rings of an area, of all its parts, as arrays of (lon, lat); null for other geometries."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    one = F.try_variant_get(geometry, "$.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.try_variant_get(geometry, "$.coordinates", "array<array<array<array<double>>>>"))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
