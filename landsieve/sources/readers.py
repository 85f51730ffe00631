"""Readers of feature collections, CSV tables, layers and small JSON answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve.functions import geometry as G

FEATURE_T = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


class SourceError(RuntimeError):
    """A source is missing, broken or empty where it must not be."""


# --- geometry text -----------------------------------------------------------

def _points(raw: Column) -> Column:
    return F.transform(raw, lambda p: G.point(p[0], p[1]))


def _rings(raw: Column) -> Column:
    return F.transform(raw, _points)


def parse_polygon(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon coordinates text -> parts; other kinds NULL."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return (
        F.when(kind == "Polygon", F.array(F.struct(_rings(one).alias("rings"))))
        .when(kind == "MultiPolygon", F.transform(many, lambda p: F.struct(_rings(p).alias("rings")))))


def parse_lines(kind: Column, coordinates: Column) -> Column:
    """LineString or MultiLineString -> array of lines."""
    return (
        F.when(kind == "LineString", F.array(_points(F.from_json(coordinates, "array<array<double>>"))))
        .when(kind == "MultiLineString", _rings(F.from_json(coordinates, "array<array<array<double>>>"))))


def parse_point(kind: Column, coordinates: Column) -> Column:
    xy = F.from_json(coordinates, "array<double>")
    return F.when(kind == "Point", G.point(xy[0], xy[1]))


def format_polygon(parts: Column, digits: int | None = 6) -> Column:
    """GeoJSON text of a polygon; one part gives Polygon, several MultiPolygon."""
    def num(v):
        return F.round(v, digits) if digits is not None else v

    coords = F.transform(parts, lambda p: F.transform(p["rings"], lambda r: F.transform(
        r, lambda v: F.array(num(v["x"]), num(v["y"])))))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.when(F.size(parts) == 0, F.lit(None).cast("string")).when(F.size(parts) == 1, single).otherwise(multi)


def format_point(x: Column, y: Column, digits: int = 6) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(x, digits), F.round(y, digits)).alias("coordinates")))


def format_line(line: Column, digits: int = 6) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(
        line, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))).alias("coordinates")))


# --- feature collections ------------------------------------------------------

def collection_features(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per feature of each collection text: other columns, pos, properties, kind, coordinates."""
    parsed = F.from_json(F.col(body), f"features array<{FEATURE_T}>")
    rest = [c for c in docs.columns if c != body]
    return docs.select(*rest, F.posexplode(parsed["features"]).alias("pos", "f")).select(
        *rest, "pos", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"))


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Feature-collection files, one collection per file; many files read in parallel."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("source_file"))
    return collection_features(docs)


def read_feature_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Line-delimited features: splittable, for layers of any size; the same columns as ``read_features``.

    ``pos`` numbers the features over all files; it is the same at every
    reading while files and split sizes stay, so write the layer before joining
    it with itself under other settings. A line that is no feature fails the read.
    """
    lines = spark.read.schema("value string").text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("_row"))
    f = F.from_json("value", FEATURE_T)
    whole = F.when(f["geometry"].isNull() & f["properties"].isNull(), F.raise_error(
        F.concat(F.lit("not a feature: "), F.substring("value", 1, 80)))).otherwise(f)
    return lines.filter(F.trim("value") != "").select("source_file", F.col("_row").alias("pos"), whole.alias("f")).select(
        "source_file", "pos", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"))


def property_columns(features: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Turn the properties map into columns.

    Without ``names`` the distinct property names are listed first; their
    number is the width of the layer's attribute table. Names that differ only
    in case give one column, filled from the first that has a value. A name
    that the feature's own columns use gets a ``property_`` in front.
    """
    if names is None:
        names = [r[0] for r in features.select(F.explode(F.map_keys("properties"))).distinct().collect()]
    rest = [c for c in features.columns if c != "properties"]
    taken, alike = {c.lower() for c in rest}, {}
    for n in sorted(names):
        alike.setdefault(n.lower(), []).append(n)
    cols = [F.coalesce(*[F.col("properties")[n] for n in same]).alias(("property_" if low in taken else "") + same[0])
            for low, same in alike.items()]
    return features.select(*rest, *cols)


MORE_T = "exceededTransferLimit:string"
PAGE_T = f"struct<error:string,properties:struct<{MORE_T}>,{MORE_T},features:array<{FEATURE_T}>>"


def page_report(pages: DataFrame, page_size: int, body: str = "body") -> DataFrame:
    """Per page: feature count ``n``, error text, ``more`` and ``used``.

    A page promises more when it says so (transfer limit flag, at the top or in
    the properties) or is full. The layer ends at the first page that does not.
    A body without readable features carries the error ``unreadable``.
    """
    p = F.from_json(F.col(body), PAGE_T)
    flag = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    n = F.coalesce(F.size(p["features"]), F.lit(0))
    error = F.coalesce(p["error"], F.when(p["features"].isNull(), F.lit("unreadable")))
    rep = pages.select("page", n.alias("n"), error.alias("error"), (
        (n > 0) & ((n >= page_size) | flag(p["exceededTransferLimit"]) | flag(p["properties"]["exceededTransferLimit"]))
    ).alias("more"))
    ends = rep.filter(~F.col("more") & F.col("error").isNull()).agg(F.min("page").alias("end"))
    return rep.crossJoin(F.broadcast(ends)).withColumn("used", F.coalesce(F.col("page") <= F.col("end"), F.lit(True))).drop("end")


def read_feature_pages(pages: DataFrame, page_size: int, expected: int | None = None, body: str = "body") -> DataFrame:
    """Features of all pages of one layer (columns page, body); nothing is left out in silence.

    The read fails on a page with an error or an unreadable body, a missing or
    repeated page number, features after the page that ends the layer, a last
    page that promises more, and a total other than ``expected``.
    """
    rep = page_report(pages, page_size, body)
    r = rep.agg(
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count(F.lit(1)).alias("pages"),
        F.countDistinct("page").alias("numbers"), F.min("page").alias("first"), F.max("page").alias("last"),
        F.sum("n").alias("total"), F.count_if(~F.col("used") & (F.col("n") > 0)).alias("beyond"),
        F.max_by("more", "page").alias("promised")).first()
    if r["errors"]:
        raise SourceError(f"{r['errors']} page(s) carry an error or can't be read")
    if r["pages"] != r["numbers"] or r["pages"] and r["last"] - r["first"] + 1 != r["pages"]:
        raise SourceError(f"page numbers from {r['first']} to {r['last']} have gaps or repeats ({r['pages']} pages)")
    if r["beyond"]:
        raise SourceError(f"{r['beyond']} page(s) with features follow the page that ends the layer")
    total = r["total"] or 0
    if expected is not None and total != expected:
        raise SourceError(f"pages hold {total} features, expected {expected}")
    if expected is None and r["promised"]:
        raise SourceError("the last page promises more features")
    return collection_features(pages, body)


def source_fallback(candidates: list[tuple[str, DataFrame | Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """First source, in order, that can be read and has at least one row.

    A source may be a function, so that one whose opening fails is passed over
    like one that fails when read.
    """
    failed = []
    for label, source in candidates:
        try:
            df = source() if callable(source) else source
            if not df.isEmpty():
                return label, df
            failed.append(f"{label}: no rows")
        except (PySparkException, Py4JJavaError, SourceError, OSError) as err:
            failed.append(f"{label}: {str(err).splitlines()[0][:200]}")
    raise SourceError("no usable source; " + "; ".join(failed))


def predicate_into_scan(df: DataFrame, box: tuple[float, float, float, float], where: Column | None = None) -> DataFrame:
    """Envelope and attribute filter on a bbox-carrying layer; both reach the Parquet scan."""
    b = F.col("bbox")
    hit = (b["xmin"] <= box[2]) & (b["xmax"] >= box[0]) & (b["ymin"] <= box[3]) & (b["ymax"] >= box[1])
    return df.filter(hit if where is None else hit & where)


# --- tables -------------------------------------------------------------------

def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False)


def read_csv_typed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Typed CSV. Give a schema for anything large; inference reads the file twice."""
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)


def read_layer(spark: SparkSession, path: str, name: str = "parts") -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed("geometry", name)


def optional_layer(spark: SparkSession, df: DataFrame | None, schema: str) -> DataFrame:
    """The layer, or an empty table of the same schema when it is not configured."""
    return df if df is not None else spark.createDataFrame([], schema)


def overlay_layer(layers: dict[str, DataFrame], name: str, allowed: dict[str, str]) -> DataFrame:
    """A whole layer as GeoJSON features; unknown names fail, a missing table is empty."""
    if name not in allowed:
        raise KeyError(f"unknown layer {name!r}")
    df = layers.get(allowed[name])
    if df is None:
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([], "feature string")
    return feature_json(df.filter(F.col("geometry_json").isNotNull()), "geometry_json")


def feature_json(df: DataFrame, geometry_json: str, id_col: str | None = None) -> DataFrame:
    """One GeoJSON feature text per row; every other column becomes a property."""
    props = F.to_json(F.struct(*[c for c in df.columns if c != geometry_json]))
    head = F.concat(F.lit('{"type":"Feature",'), F.concat(F.lit('"id":'), F.col(id_col), F.lit(",")) if id_col else F.lit(""))
    return df.select(F.concat(head, F.lit('"geometry":'), F.col(geometry_json), F.lit(',"properties":'), props, F.lit("}")).alias("feature"))


def solar_response_parse(responses: DataFrame, body: str = "body") -> DataFrame:
    """Solar answers per point -> annual values; unreadable or empty answers are dropped."""
    def annual(key):
        return F.get_json_object(F.col(body), f"$.outputs.{key}.annual").try_cast("double")

    out = responses.select("lon", "lat", annual("avg_ghi").alias("avg_ghi"), annual("avg_dni").alias("avg_dni"),
                           annual("avg_lat_tilt").alias("avg_lat_tilt"))
    return out.filter(F.coalesce("avg_ghi", "avg_dni", "avg_lat_tilt").isNotNull())
