"""Queries on attribute filters: each predicate by itself, and all of them together in the order of what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import vocabulary as v
from sightline.functions.expressions import lookup
from sightline.registry import query
from sightline.sources.tables import INSTANCES, instances, picked, picked_sql, sql_text


def canonical(colour: Column) -> Column:
    """The colour that an alias stands for, else itself."""
    return F.coalesce(lookup(colour, v.COLOUR_ALIASES), colour)


def canonical_type(kind: Column) -> Column:
    """P29."""
    return F.coalesce(lookup(kind, v.TYPE_NAMES), kind)


def known(x: Column) -> Column:
    return F.when(x != "unknown", x)


def target_matches(own: Column, kind: Column, asked: Column) -> Column:
    """vehicles take in non-motor vehicles; the other way round only by types that are non-motor ones."""
    return asked.isNull() | F.coalesce((own == asked) | ((asked == "vehicle") & (own == "non_motor_vehicle")) | ((asked == "non_motor_vehicle") & (own == "vehicle") & F.coalesce(kind.isin(v.NON_MOTOR_TYPES), F.lit(False))), F.lit(False))


def plate_matches(own: Column, asked: Column) -> Column:
    """a row without a plate fails."""
    return asked.isNull() | F.coalesce(own == asked, F.lit(False))


def colour_matches(own: Column, asked: Column, candidates: Column) -> Column:
    """by alias, near colour or candidate; an unknown colour fails."""
    own = known(own)
    near = F.coalesce(F.try_element_at(F.create_map(*[x for c, near in v.NEAR_COLOURS.items() for x in (F.lit(c), F.array(*map(F.lit, near)))]), canonical(asked)), F.array().cast("array<string>"))
    wide = F.transform(candidates, canonical)
    hit = (canonical(own) == canonical(asked)) | F.array_contains(near, own) | F.array_contains(wide, canonical(own)) | F.array_contains(candidates, own)
    return asked.isNull() | F.coalesce(hit, F.lit(False))


def type_matches(own: Column, asked: Column, candidates: Column) -> Column:
    """equal, by alias, without case, by candidates and by related types; an unknown type fails."""
    own = known(own)
    related = F.create_map(*[x for k, own_ in v.TYPE_RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, own_)))])
    around = lambda k: F.coalesce(F.try_element_at(related, k), F.array(k))
    wide = F.array_union(F.flatten(F.transform(candidates, lambda c: around(canonical_type(c)))), candidates)
    hit = (canonical_type(own) == canonical_type(asked)) | (F.lower(own) == F.lower(asked)) | F.array_contains(wide, canonical_type(own)) | F.array_contains(wide, own) | F.array_contains(around(canonical_type(asked)), canonical_type(own))
    return asked.isNull() | F.coalesce(hit, F.lit(False))


def soft_matches(own: Column, asked: Column) -> Column:
    """what is not known passes."""
    return asked.isNull() | known(own).isNull() | (own == asked)


def bag_matches(own: Column, asked: Column) -> Column:
    """F8: a row that does not say has no bag."""
    return asked.isNull() | (F.coalesce(own, F.lit(False)) == asked)


def lane_matches(own: Column, asked: Column) -> Column:
    return asked.isNull() | own.isNull() | (own == asked)


def known_score(colour: Column, kind: Column) -> Column:
    """100 for a known colour and 100 for a known type."""
    return F.when(known(colour).isNotNull(), 100).otherwise(0) + F.when(known(kind).isNotNull(), 100).otherwise(0)


#: Queries that the rows are held against in turn: (target, plate, colour, colour candidates, type, type candidates, gender, clothing, accessory, bag, lane).
ASKED = [
    ("vehicle", None, "白色", [], None, [], None, None, None, None, "eastbound"),
    ("vehicle", None, "深色", ["黑色", "灰色", "棕色", "蓝色"], "小车", ["轿车", "SUV", "跑车"], None, None, None, None, None),
    ("non_motor_vehicle", None, None, [], "三轮车", [], None, None, None, None, None),
    ("pedestrian", None, None, [], None, [], "male", "红色", "帽子", True, None),
    (None, "苏E12345", None, [], None, [], None, None, None, None, None),
    ("vehicle", None, "银色", [], "两厢车", [], None, None, None, None, "northbound"),
    ("vehicle", None, None, [], "大车", ["卡车", "公交车"], None, None, None, False, None),
    (None, None, "棕色", [], "SUV", [], "female", None, None, None, None),
]
_NAMES = ["target_type", "plate", "color", "color_candidates", "vehicle_type", "type_candidates", "gender", "clothing_color", "accessory", "bag", "lane"]


def asked_rows(df: DataFrame) -> DataFrame:
    """df with the columns q_... of the query that its place asks."""
    at = (F.col("id") + F.col("line")) % len(ASKED)
    for i, name in enumerate(_NAMES):
        values = [a[i] for a in ASKED]
        if name.endswith("candidates"):
            df = df.withColumn(f"q_{name}", F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in values]), (at + 1).cast("int")))
        else:
            df = df.withColumn(f"q_{name}", picked(values, at))
    return df


_AT = f"(id + line) % {len(ASKED)}"
_LIST = lambda x: "[" + ", ".join(map(sql_text, x)) + "]::VARCHAR[]"
_ASKED_SQL = INSTANCES + ", asked AS (SELECT *, " + ", ".join((f"list_value({', '.join(_LIST(a[i]) for a in ASKED)})[CAST({_AT} AS INT) + 1]" if n.endswith("candidates") else picked_sql([a[i] for a in ASKED], _AT)) + f" AS q_{n}" for i, n in enumerate(_NAMES)) + " FROM inst)"


def _map(x: str, table: dict[str, str]) -> str:
    return f"coalesce(MAP {{{', '.join(f'{sql_text(k)}: {sql_text(w)}' for k, w in table.items())}}}[{x}], {x})"


def _around(x: str) -> str:
    return f"coalesce(MAP {{{', '.join(f'{sql_text(k)}: {_LIST(w)}' for k, w in v.TYPE_RELATED.items())}}}[{x}], [{x}])"


_COLOUR_OF, _TYPE_OF = (lambda x: _map(x, v.COLOUR_ALIASES)), (lambda x: _map(x, v.TYPE_NAMES))
_PREDICATES = {
    "target_ok": "q_target_type IS NULL OR target_type = q_target_type OR (q_target_type = 'vehicle' AND target_type = 'non_motor_vehicle') OR (q_target_type = 'non_motor_vehicle' AND target_type = 'vehicle' AND coalesce(vehicle_type IN ('三轮车', '电动车', '自行车', '摩托车'), false))",
    "plate_ok": "q_plate IS NULL OR coalesce(plate = q_plate, false)",
    "colour_ok": f"""q_color IS NULL OR (color IS NOT NULL AND color <> 'unknown' AND ({_COLOUR_OF("color")} = {_COLOUR_OF("q_color")} OR (color = '乳白' AND {_COLOUR_OF("q_color")} = '白色') OR (color = '银灰' AND {_COLOUR_OF("q_color")} = '银色')
 OR list_contains(list_transform(q_color_candidates, lambda c: {_COLOUR_OF("c")}), {_COLOUR_OF("color")}) OR list_contains(q_color_candidates, color)))""",
    "type_ok": f"""q_vehicle_type IS NULL OR (vehicle_type IS NOT NULL AND vehicle_type <> 'unknown' AND ({_TYPE_OF("vehicle_type")} = {_TYPE_OF("q_vehicle_type")} OR lower(vehicle_type) = lower(q_vehicle_type) OR list_contains({_around(_TYPE_OF("q_vehicle_type"))}, {_TYPE_OF("vehicle_type")})
 OR list_contains(flatten(list_transform(q_type_candidates, lambda c: {_around(_TYPE_OF("c"))})), {_TYPE_OF("vehicle_type")}) OR list_contains(flatten(list_transform(q_type_candidates, lambda c: {_around(_TYPE_OF("c"))})), vehicle_type) OR list_contains(q_type_candidates, vehicle_type)))""",
    "gender_ok": "q_gender IS NULL OR gender IS NULL OR gender = 'unknown' OR gender = q_gender",
    "clothing_ok": "q_clothing_color IS NULL OR clothing_color IS NULL OR clothing_color = 'unknown' OR clothing_color = q_clothing_color",
    "accessory_ok": "q_accessory IS NULL OR accessory IS NULL OR accessory = 'unknown' OR accessory = q_accessory",
    "bag_ok": "q_bag IS NULL OR coalesce(bag, false) = q_bag",
    "lane_ok": "q_lane IS NULL OR lane IS NULL OR lane = q_lane",
}
_CHECKED = _ASKED_SQL + ", checked AS (SELECT *, " + ", ".join(f"({p}) AS {n}" for n, p in _PREDICATES.items()) + " FROM asked)"


def checked_rows(df: DataFrame) -> DataFrame:
    """df (instances and what is asked) with a column for each predicate."""
    c = F.col
    return df.withColumns(
        {
            "target_ok": target_matches(c("target_type"), c("vehicle_type"), c("q_target_type")),
            "plate_ok": plate_matches(c("plate"), c("q_plate")),
            "colour_ok": colour_matches(c("color"), c("q_color"), c("q_color_candidates")),
            "type_ok": type_matches(c("vehicle_type"), c("q_vehicle_type"), c("q_type_candidates")),
            "gender_ok": soft_matches(c("gender"), c("q_gender")),
            "clothing_ok": soft_matches(c("clothing_color"), c("q_clothing_color")),
            "accessory_ok": soft_matches(c("accessory"), c("q_accessory")),
            "bag_ok": bag_matches(c("bag"), c("q_bag")),
            "lane_ok": lane_matches(c("lane"), c("q_lane")),
        }
    )


@query("F3 F4 F5 F6 F7 F8: each predicate of the attribute filter by itself", f"WITH {_CHECKED} SELECT id, line, {', '.join(_PREDICATES)} FROM checked")
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    return checked_rows(asked_rows(instances(spark, d))).select("id", "line", *_PREDICATES)


@query(
    "F2 F12: all predicates of the attribute filter, rows in the order of what is known",
    f"WITH {_CHECKED} SELECT id, line, CASE WHEN coalesce(color, 'unknown') <> 'unknown' THEN 100 ELSE 0 END + CASE WHEN coalesce(vehicle_type, 'unknown') <> 'unknown' THEN 100 ELSE 0 END AS known FROM checked WHERE {' AND '.join(n for n in _PREDICATES if n != 'lane_ok')}",
)
def attribute_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = checked_rows(asked_rows(instances(spark, d))).where(" and ".join(n for n in _PREDICATES if n != "lane_ok"))
    return kept.select("id", "line", known_score(F.col("color"), F.col("vehicle_type")).alias("known")).orderBy(F.desc("known"), "id", "line")


@query(
    "F1: short filter: colour and type equal or unknown, lane direction of the camera equal or unknown",
    f"WITH {_ASKED_SQL} SELECT id, line FROM asked WHERE (q_color IS NULL OR coalesce(color, '') IN (q_color, 'unknown')) AND (q_vehicle_type IS NULL OR coalesce(vehicle_type, '') IN (q_vehicle_type, 'unknown')) AND (q_lane IS NULL OR lane IS NULL OR lane = q_lane)",
)
def short_filter(spark: SparkSession, d: str) -> DataFrame:
    same = lambda own, asked: F.col(asked).isNull() | F.coalesce((F.col(own) == F.col(asked)) | (F.col(own) == "unknown"), F.lit(False))
    rows = asked_rows(instances(spark, d))
    return rows.where(same("color", "q_color") & same("vehicle_type", "q_vehicle_type") & lane_matches(F.col("lane"), F.col("q_lane"))).select("id", "line")


@query(
    "F9: filter by a parsed query's attributes: what a row does not say passes, colours and types by alias",
    f"""WITH {_ASKED_SQL} SELECT id, line FROM asked WHERE (q_target_type IS NULL OR target_type = q_target_type) AND (q_plate IS NULL OR coalesce(plate = q_plate, false)) AND (q_color IS NULL OR color IS NULL OR {_COLOUR_OF("color")} = {_COLOUR_OF("q_color")})
 AND (q_vehicle_type IS NULL OR vehicle_type IS NULL OR {_TYPE_OF("vehicle_type")} = {_TYPE_OF("q_vehicle_type")}) AND (q_gender IS NULL OR gender IS NULL OR gender = q_gender) AND (q_clothing_color IS NULL OR clothing_color IS NULL OR clothing_color = q_clothing_color)""",
)
def parsed_query_filter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    passes = lambda own, asked: asked.isNull() | own.isNull() | (own == asked)
    kept = (c("q_target_type").isNull() | (c("target_type") == c("q_target_type"))) & plate_matches(c("plate"), c("q_plate")) & passes(canonical(c("color")), canonical(c("q_color"))) & passes(canonical_type(c("vehicle_type")), canonical_type(c("q_vehicle_type")))
    return asked_rows(instances(spark, d)).where(kept & passes(c("gender"), c("q_gender")) & passes(c("clothing_color"), c("q_clothing_color"))).select("id", "line")


@query(
    "P28 P29 P30: colour and type aliases, codes to labels with fallbacks",
    f"""WITH {INSTANCES} SELECT id, line, {_COLOUR_OF("color")} AS colour, {_TYPE_OF("vehicle_type")} AS type,
 coalesce(nullif(color, 'unknown'), MAP {{{", ".join(f"{k}: {sql_text(w)}" for k, w in v.COLOUR_CODES.items())}}}[CAST(id % 14 AS INT)], CASE WHEN id % 14 = 12 THEN 'code 12' END, '未知') AS label FROM inst""",
)
def alias_labels(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("id") % 14).cast("int")
    label = F.coalesce(known(F.col("color")), lookup(code, v.COLOUR_CODES), F.when(code == 12, "code 12"), F.lit("未知"))
    return instances(spark, d).select("id", "line", canonical(F.col("color")).alias("colour"), canonical_type(F.col("vehicle_type")).alias("type"), label.alias("label"))
