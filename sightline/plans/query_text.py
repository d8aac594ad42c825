"""Queries that take user texts apart: the library's parser and the short one. All work is in regular expressions and lookups of the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import vocabulary as v
from sightline.registry import query
from sightline.sources.tables import QUERY_TEXTS, query_texts, sql_text

ATTRIBUTE_NAMES = ["color", "vehicle_type", "gender", "clothing_color", "bag", "bag_color", "pants_color", "accessory"]
_COLOURS = sorted(v.COLOUR_WORDS, key=len, reverse=True)
_VAGUE = sorted(v.VAGUE_COLOURS, key=len, reverse=True)
_TYPES: dict[str, str | list[str]] = {**v.TYPE_ALIASES, **v.TYPE_GROUPS, **v.TYPE_WORDS}
_TYPE_ORDER = sorted(_TYPES, key=len, reverse=True)


def first_word(text: Column, words: list[str], value) -> Column:
    """value(word) of the first word that the text holds."""
    return F.coalesce(*[F.when(text.contains(w), value(w)) for w in words])


def phrases(text: Column) -> Column:
    """Q4: the phrases found: the longest first, those of one length from left to right, none over another."""
    found, rest = [], text
    for n in sorted({len(p) for p in v.PHRASES}, reverse=True):
        pattern = "(" + "|".join(re.escape(p) for p in v.PHRASES if len(p) == n) + ")"
        found.append(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)))
        rest = F.regexp_replace(rest, pattern, "\x01" * n)
    return F.concat(*found)


def _stated(found: Column, name: str) -> Column:
    """What the first of the phrases that says it says of an attribute."""
    table = {p: own[name] for p, (_, own) in v.PHRASES.items() if name in own}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.get(F.filter(F.transform(found, lambda p: F.try_element_at(pairs, p)), lambda x: x.isNotNull()), F.lit(0))


def extracted(text: Column) -> dict[str, Column]:
    """Q6: the attributes that single words give."""
    colour = lambda w: F.lit(v.COLOUR_WORDS[w])
    bag = F.when(F.greatest(*[text.contains(w) for w in v.BAG_WORDS]), "true")
    at = F.when(text.contains("背包"), F.instr(text, "背包")).otherwise(F.instr(text, "包"))
    bag_colour = F.when(bag.isNotNull() & (at > 1), first_word(F.substring(text, 1, at - 1), _COLOURS, colour))
    clothing = F.coalesce(*[F.when(text.contains(w) & (bag_colour.isNull() | (bag_colour != v.COLOUR_WORDS[w])), colour(w)) for w in _COLOURS])
    trousers = F.regexp_extract(text, "([一-龥]{1,2}色?)裤子", 1)
    return {
        "color": F.coalesce(first_word(text, _COLOURS, colour), first_word(text, _VAGUE, F.lit)),
        "vehicle_type": first_word(text, _TYPE_ORDER, lambda w: F.lit(w if isinstance(_TYPES[w], list) else _TYPES[w])),
        "gender": F.when(text.contains("男"), "male").when(text.contains("女"), "female"),
        "clothing_color": F.when(text.contains("穿") | text.contains("衣"), clothing),
        "bag": bag,
        "bag_color": bag_colour,
        "pants_color": first_word(trousers, _COLOURS, colour),
        "accessory": F.coalesce(*[F.when(F.greatest(*[text.contains(w) for w in words]), name) for name, words in v.ACCESSORY_WORDS.items()]),
    }


def target_type(text: Column) -> Column:
    """Q5: non-motor vehicles before pedestrians before vehicles."""
    return F.coalesce(*[F.when(F.greatest(*[text.contains(w) for w in words]), name) for name, words in v.TARGET_WORDS.items()])


def candidates(text: Column) -> tuple[Column, Column]:
    """Q7: the colours and the types that vague words stand for, else empty."""
    none = F.array().cast("array<string>")
    exact = first_word(text, _COLOURS, F.lit)
    colours = F.when(exact.isNull(), first_word(text, _VAGUE, lambda w: F.array(*map(F.lit, v.VAGUE_COLOURS[w]))))
    types = first_word(text, _TYPE_ORDER, lambda w: F.array(*map(F.lit, _TYPES[w])) if isinstance(_TYPES[w], list) else none)
    return F.coalesce(colours, none), F.coalesce(types, none)


def parse_queries(df: DataFrame, text: str = "text") -> DataFrame:
    """Q2 Q3 Q8: df with plate, query_type, target_type, the attributes, color_candidates and type_candidates. A plate decides alone; then phrases,
    completed by words."""
    t = F.trim(text)
    df = df.withColumns({"__plate": F.nullif(F.regexp_extract(t, f"({v.PLATE})", 1), F.lit("")), "__found": phrases(t)})
    plated, found = F.col("__plate").isNotNull(), F.col("__found")
    words = extracted(t)
    said = F.try_element_at(F.create_map(*[F.lit(x) for p, (target, _) in v.PHRASES.items() for x in (p, target)]), F.get(found, F.lit(0)))
    target = F.when(plated, "vehicle").otherwise(F.coalesce(said, target_type(t)))
    colours, types = candidates(t)
    none = F.array().cast("array<string>")
    out = {
        "plate": F.col("__plate"),
        "query_type": F.when(plated, "plate").otherwise(F.coalesce(target, F.lit("general"))),
        "target_type": target,
        **{n: F.when(~plated, F.coalesce(_stated(found, n), words[n])) for n in ATTRIBUTE_NAMES},
        "color_candidates": F.when(plated, none).otherwise(colours),
        "type_candidates": F.when(plated, none).otherwise(types),
    }
    return df.select(*[c for c in df.columns if c not in out and not c.startswith("__")], *[c.alias(n) for n, c in out.items()])


def _first_sql(text: str, words: list[str], value) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN {value(w)}" for w in words) + " END"


def _parse_sql() -> str:
    colour = lambda w: f"'{v.COLOUR_WORDS[w]}'"
    lengths = sorted({len(p) for p in v.PHRASES}, reverse=True)
    steps, last = [], "t0"
    for i, n in enumerate(lengths):
        pattern = "|".join(p for p in v.PHRASES if len(p) == n)
        steps.append(f"t{i + 1} AS (SELECT *, regexp_extract_all(r{i}, '{pattern}') AS f{i}, regexp_replace(r{i}, '{pattern}', '{'#' * n}', 'g') AS r{i + 1} FROM {last})")
        last = f"t{i + 1}"
    table = lambda name: "MAP {" + ", ".join(f"'{p}': '{own[name]}'" for p, (_, own) in v.PHRASES.items() if name in own) + "}"
    stated = lambda name: f"list_filter(list_transform(found, lambda p: {table(name)}[p]), lambda x: x IS NOT NULL)[1]"
    any_of = lambda words: "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"
    clothing = "CASE " + " ".join(f"WHEN contains(text, '{w}') AND bag_color IS DISTINCT FROM {colour(w)} THEN {colour(w)}" for w in _COLOURS) + " END"
    words = {
        "color": f"coalesce({_first_sql('text', _COLOURS, colour)}, {_first_sql('text', _VAGUE, sql_text)})",
        "vehicle_type": _first_sql("text", _TYPE_ORDER, lambda w: sql_text(w if isinstance(_TYPES[w], list) else _TYPES[w])),
        "gender": "CASE WHEN contains(text, '男') THEN 'male' WHEN contains(text, '女') THEN 'female' END",
        "clothing_color": f"CASE WHEN contains(text, '穿') OR contains(text, '衣') THEN {clothing} END",
        "bag": "bag",
        "bag_color": "bag_color",
        "pants_color": _first_sql("trousers", _COLOURS, colour),
        "accessory": "CASE " + " ".join(f"WHEN {any_of(w)} THEN '{n}'" for n, w in v.ACCESSORY_WORDS.items()) + " END",
    }
    target = "MAP {" + ", ".join(f"'{p}': '{t}'" for p, (t, _) in v.PHRASES.items()) + "}"
    inferred = "CASE " + " ".join(f"WHEN {any_of(w)} THEN '{n}'" for n, w in v.TARGET_WORDS.items()) + " END"
    lists = lambda words, table: _first_sql("text", words, lambda w: sql_text(",".join(table[w])) if isinstance(table[w], list) else "''")
    found = " || ".join(f"f{i}" for i in range(len(lengths)))
    return f"""WITH {QUERY_TEXTS}, t0 AS (SELECT id, text, text AS r0, nullif(regexp_extract(text, '{v.PLATE}'), '') AS plate FROM texts), {", ".join(steps)},
b AS (SELECT id, text, plate, {found} AS found, CASE WHEN {any_of(v.BAG_WORDS)} THEN 'true' END AS bag, CASE WHEN contains(text, '背包') THEN position('背包' IN text) ELSE position('包' IN text) END AS pos, regexp_extract(text, '([一-龥]{{1,2}}色?)裤子', 1) AS trousers FROM {last}),
c AS (SELECT *, CASE WHEN bag IS NOT NULL AND pos > 1 THEN {_first_sql('text[1 : pos - 1]', _COLOURS, colour)} END AS bag_color FROM b),
x AS (SELECT id, text, plate, {", ".join(f"CASE WHEN plate IS NULL THEN coalesce({stated(n)}, {words[n]}) END AS {n}" for n in ATTRIBUTE_NAMES)},
 CASE WHEN plate IS NULL THEN coalesce({target}[found[1]], {inferred}) ELSE 'vehicle' END AS target_type,
 CASE WHEN plate IS NULL AND {_first_sql('text', _COLOURS, sql_text)} IS NULL THEN coalesce({lists(_VAGUE, v.VAGUE_COLOURS)}, '') ELSE '' END AS color_candidates, CASE WHEN plate IS NULL THEN coalesce({lists(_TYPE_ORDER, _TYPES)}, '') ELSE '' END AS type_candidates FROM c)
SELECT *, CASE WHEN plate IS NOT NULL THEN 'plate' ELSE coalesce(target_type, 'general') END AS query_type FROM x"""


@query("Q2 Q3 Q4 Q5 Q6 Q7 Q8: query texts parsed by plate, phrases and words", _parse_sql())
def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_queries(query_texts(spark, d).withColumn("own", F.col("text")))
    return parsed.drop("text").withColumnRenamed("own", "text").withColumns({n: F.array_join(n, ",") for n in ("color_candidates", "type_candidates")})


def longest_word(text: Column, table: dict[str, list[str]]) -> Column:
    """The label of the longest word that the text holds, the first of them if several are as long."""
    words = sorted(((w, label) for label, own in table.items() for w in own), key=lambda x: -len(x[0]))
    return F.coalesce(*[F.when(text.contains(w), label) for w, label in words])


def short_parse(text: Column) -> dict[str, Column]:
    """Q1: colour, type, lane direction and the words that are neither colour nor type."""
    low = F.lower(text)
    known = [w for table in (v.SHORT_COLOURS, v.SHORT_TYPES) for words in table.values() for w in words]
    holds = lambda x: F.lower(x).rlike("|".join(map(re.escape, known)))
    return {
        "color": F.coalesce(*[F.when(low.contains(w), label) for label, words in v.SHORT_COLOURS.items() for w in words]),
        "vehicle_type": longest_word(low, v.SHORT_TYPES),
        "direction": longest_word(low, v.LANE_WORDS),
        "keywords": F.filter(F.split(text, "\\s+"), lambda w: (w != "") & ~holds(w)),
    }


def _longest_sql(table: dict[str, list[str]]) -> str:
    words = sorted(((w, label) for label, own in table.items() for w in own), key=lambda x: -len(x[0]))
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{label}'" for w, label in words) + " END"


_KNOWN = "|".join(w for table in (v.SHORT_COLOURS, v.SHORT_TYPES) for words in table.values() for w in words)


@query(
    "Q1: colour by the first entry, type and lane direction by the longest word, the other words",
    f"""WITH {QUERY_TEXTS} SELECT id, CASE {" ".join(f"WHEN contains(lower(text), '{w}') THEN '{label}'" for label, words in v.SHORT_COLOURS.items() for w in words)} END AS color, {_longest_sql(v.SHORT_TYPES)} AS vehicle_type, {_longest_sql(v.LANE_WORDS)} AS direction,
 array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(lower(w), '{_KNOWN}')), ' ') AS keywords FROM texts""",
)
def short_queries(spark: SparkSession, d: str) -> DataFrame:
    parts = short_parse(F.col("text"))
    return query_texts(spark, d).select("id", *[(F.array_join(c, " ") if n == "keywords" else c).alias(n) for n, c in parts.items()])
