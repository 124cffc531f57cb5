"""Tables of the engine. Geometry is held as lon and lat, a bounding box, and polygon -> ring -> vertex arrays."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(text: str) -> T.StructType:
    """A schema from lines of `type: name name ...`."""
    fields = []
    for line in text.strip().splitlines():
        kind, names = line.strip().split(":", 1)
        fields += [T.StructField(n, _TYPES[kind]) for n in names.split()]
    return T.StructType(fields)


POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))
_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "time": T.TimestampType(), "date": T.DateType(), "conf": T.DecimalType(5, 4), "mpoly": MULTIPOLYGON}

PLACE = _of("""
    long: id
    string: attribution enwiki_title
    int: geonames_id
    string: osm_id pcode
    int: fips
    string: admin1_code admin2_code admin3_code admin4_code
    int: admin_level
    double: east north south west
    string: name name_ascii name_display name_en name_normalized other_names geonames_feature_class geonames_feature_code place_type
    double: latitude longitude
    mpoly: mpoly
    int: area_sqkm
    double: importance
    string: osmname_class osmname_type osm_type
    int: place_rank
    double: dem elevation
    string: city county country country_code state street note
    long: population popularity
    string: timezone
    int: topic_id
    string: wikidata_id
""")
ORDER = _of("long: id\nbool: complete\nint: duration\nbool: edited\ntime: end\nstring: end_user_timezone map_format\nbool: open_source\ntime: start\nlong: style_id\nstring: token url")
FEATURE = _of("long: id order_id\nint: cnt\ntime: end start\nstring: name geometry_used text\nint: topic_id\nbool: verified")
FEATUREPLACE = _of("long: id feature_id place_id\nint: cluster_frequency\nconf: confidence\nint: country_rank\nbool: correct\nint: median_distance sort_order\nlong: popularity")
ALIAS = _of("long: id\nstring: alias language")
ALIASPLACE = _of("long: id alias_id place_id")
ALTERNATE_NAME = _of("int: geonameid a\nstring: language alternate_name b c d e")
OSM_NAME = _of("string: name alternative_names osm_type\nlong: osm_id\nstring: class type\ndouble: lon lat\nint: place_rank\ndouble: importance\nstring: street city county state country country_code display_name\ndouble: west south east north\nstring: wikidata wikipedia")
PARENTCHILD = _of("long: parent_id child_id")
COUNTRY_RANK = _of("string: country_code\nlong: order_id\nint: rank")
COOCCURRENCE = _of("string: a b\nlong: count")
SOURCE = _of("long: id order_id\nstring: source_text source_type source_url")
STYLE = _of("long: id mapstyle_id feature_id\nbool: label")
METADATA_ENTRY = _of("long: metadata_id\nstring: key value")
TEST = _of("double: accuracy\nint: duration\ntime: created")
GENESIS = _of("string: page_id titles")
#: A candidate for a name; the joined form `target--distance` is kept apart in two columns.
GEOENTITY = _of("""
    long: place_id
    int: admin_level
    string: country_code admin1_code
    int: ccrank
    string: target
    int: edit_distance
    string: place_name alias
    long: population
    double: lon lat
    int: topic_id
    bool: has_mpoly has_pcode
    long: popularity
    string: feature_class feature_code
    int: notability
    string: timezone
    double: importance
""")
