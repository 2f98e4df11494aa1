"""Elements to GeoJSON geometries and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"


def _turned(dx: Column, dy: Column) -> Column:
    """A corner about the centre, turned by ``rotation`` if the element has one."""
    return F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))


def corners() -> Column:
    """The closed ring of a rectangle, or of the square around a circle."""
    w, h = F.col("width") / 2, F.col("height") / 2
    return F.array(*[_turned(a * w, b * h) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])


def geometry() -> Column:
    """struct(type, ring): a point, or the ring of a polygon."""
    point = F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))
    is_point = F.col("type") == "point"
    return F.struct(F.when(is_point, "Point").otherwise("Polygon").alias("type"), F.when(is_point, point).otherwise(corners()).alias("ring"))


def feature() -> Column:
    """The JSON text of a polygon feature."""
    ring = F.transform(corners(), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))


def rectangle(json: Column) -> Column:
    """Centre, sides and rotation of a polygon feature with four corners."""
    ring = F.from_json(json, POINT)["geometry"]["coordinates"][0]
    side = lambda a, b: F.sqrt(F.pow(ring[b][0] - ring[a][0], 2) + F.pow(ring[b][1] - ring[a][1], 2))
    mean = lambda k: (ring[0][k] + ring[1][k] + ring[2][k] + ring[3][k]) / 4
    return F.struct(mean(0).alias("x"), mean(1).alias("y"), side(0, 1).alias("width"), side(1, 2).alias("height"), F.atan2(ring[1][1] - ring[0][1], ring[1][0] - ring[0][0]).alias("rotation"))


FEATURE = "struct<type:string,properties:struct<type:string,radius:double,width:double,height:double,rotation:double>,geometry:struct<type:string,coordinates:string>>"
_POINT, _LINE, _LINES, _SURFACES = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


def is_feature(json: Column) -> Column:
    """Whether a text is a GeoJSON feature, feature collection or geometry."""
    kinds = ("Feature", "FeatureCollection", "GeometryCollection", "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    return F.coalesce(F.get_json_object(json, "$.type").isin(*kinds), F.lit(False))


def features(json: Column) -> Column:
    """The features of a collection as JSON texts; of a single one itself."""
    many = F.from_json(F.get_json_object(json, "$.features"), "array<string>")
    return F.when(F.get_json_object(json, "$.type") == "FeatureCollection", many).otherwise(F.array(json))


def elements(json: Column) -> Column:
    """array of struct(type, closed, points, holes, radius, width, height, rotation): the elements of a feature.

    Multiple geometries give one for each part.  Circles, ellipses and rectangles are told by ``properties.type``: a point
    or a polygon, of which they take the centre, with the sizes that the properties state.  A polygon's further rings are holes.
    """
    f = F.from_json(json, FEATURE)
    kind, text = f["geometry"]["type"], f["geometry"]["coordinates"]
    shape = f["properties"]["type"]
    xy = lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))
    line = lambda ps: F.transform(ps, xy)
    # A ring's last point repeats the first.
    ring = lambda ps: F.transform(F.slice(ps, 1, F.greatest(F.size(ps) - 1, F.lit(0))), xy)
    none = F.lit(None).cast("double")
    no_holes = F.array().cast("array<array<struct<x:double,y:double>>>")

    def element(name, closed, points, holes=no_holes, sized=False):
        sizes = [(f["properties"][c] if sized else none).alias(c) for c in ("radius", "width", "height", "rotation")]
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("type"), F.lit(closed).cast("boolean").alias("closed"), points.alias("points"), holes.alias("holes"), *sizes)

    def polygon(rings):
        return element("polyline", True, ring(rings[0]), F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), ring))

    point, points, lines, surfaces = (F.from_json(text, t) for t in (_POINT, _LINE, _LINES, _SURFACES))
    outline = ring(lines[0])
    centre = lambda ps: F.array(F.struct(*[(F.aggregate(ps, F.lit(0.0), lambda a, p: a + p[c]) / F.size(ps)).alias(c) for c in "xy"]))
    sized = shape.isin("circle", "ellipse", "rectangle")
    return (
        F.when(sized & (kind == "Point"), F.array(element(shape, None, F.array(xy(point)), sized=True)))
        .when(sized & (kind == "Polygon"), F.array(element(shape, None, centre(outline), sized=True)))
        .when(kind == "Point", F.array(element("point", None, F.array(xy(point)))))
        .when(kind == "MultiPoint", F.transform(points, lambda p: element("point", None, F.array(xy(p)))))
        .when(kind == "LineString", F.array(element("polyline", False, line(points))))
        .when(kind == "MultiLineString", F.transform(lines, lambda ps: element("polyline", False, line(ps))))
        .when(kind == "Polygon", F.array(polygon(lines)))
        .when(kind == "MultiPolygon", F.transform(surfaces, polygon))
    )


def sample_feature(kind: Column) -> Column:
    """A feature around an element's centre, as JSON: of a named kind, with a second part 100 to the right for multiple ones."""
    w, h = F.col("width") / 2, F.col("height") / 2
    at = lambda dx, dy, k=0: F.array(F.col("cx") + k * 100.0 + dx, F.col("cy") + dy)
    zero = F.lit(0.0)
    path = lambda k=0: F.array(at(-w, -h, k), at(w, -h, k), at(w, h, k))
    ring = lambda k=0: F.array(F.array(at(-w, -h, k), at(w, -h, k), at(w, h, k), at(-w, h, k), at(-w, -h, k)))
    shapes = {
        "point": ("Point", at(zero, zero)), "multipoint": ("MultiPoint", F.array(at(zero, zero), at(zero, zero, 1))), "polyline": ("LineString", path()), "multipolyline": ("MultiLineString", F.array(path(), path(1))),
        "polygon": ("Polygon", ring()), "multipolygon": ("MultiPolygon", F.array(ring(), ring(1))), "circle": ("Polygon", ring()), "ellipse": ("Polygon", ring()), "rectangle": ("Point", at(zero, zero)),
    }
    out = None
    for name, (geometry, coordinates) in shapes.items():
        properties = F.struct(F.lit(name).alias("type"), w.alias("radius"), F.col("width").alias("width"), F.col("height").alias("height"))
        text = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry")))
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out
