"""Open property maps: MAP<STRING, VARIANT> keeps the types of JSON values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PROPERTIES


def is_object(json: Column) -> Column:
    """Whether the whole text is one JSON object; false for null.

    The parser stops at the end of the first value, so "4 words" would pass for a number. Inside of an array and of an
    object, what follows the value must go on with the one or the other, so nothing but blanks passes for both.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), json, F.lit("}"))).isNotNull()
    # the whole is read only of texts that begin as an object does
    return F.coalesce(F.when(json.rlike(r"\A[ \t\r\n]*\{"), F.try_parse_json(json).isNotNull() & inside), F.lit(False))


def parse(json: Column) -> Column:
    """A JSON object as a property map; null for what is not an object."""
    return F.from_json(F.when(is_object(json), json), PROPERTIES)


def clean(properties: str) -> Column:
    """Properties as a graph can store them.

    Nulls go. An object is flattened by one level as key_subkey, of which scalars alone stay. A list of scalars
    stays, any other list becomes its JSON text. Of equal keys the last one wins.
    """
    kind = "schema_of_variant({})".format
    scalar = f"NOT is_variant_null(s.value) AND NOT startswith({kind('s.value')}, 'OBJECT') AND NOT startswith({kind('s.value')}, 'ARRAY')"
    item = f"NOT is_variant_null(x) AND NOT startswith({kind('x')}, 'OBJECT') AND NOT startswith({kind('x')}, 'ARRAY')"
    inner = f"filter(map_entries(variant_get(e.value, '$', '{PROPERTIES}')), s -> s.value IS NOT NULL AND {scalar})"
    flat = f"transform({inner}, s -> named_struct('key', concat(e.key, '_', s.key), 'value', s.value))"
    listed = f"CASE WHEN forall(variant_get(e.value, '$', 'array<variant>'), x -> {item}) THEN e.value ELSE CAST(to_json(e.value) AS variant) END"
    entry = f"""CASE WHEN e.value IS NULL OR is_variant_null(e.value) THEN CAST(array() AS array<struct<key:string,value:variant>>)
        WHEN startswith({kind('e.value')}, 'OBJECT') THEN {flat}
        WHEN startswith({kind('e.value')}, 'ARRAY') THEN array(named_struct('key', e.key, 'value', {listed}))
        ELSE array(named_struct('key', e.key, 'value', e.value)) END"""
    every = f"flatten(transform(map_entries({properties}), e -> {entry}))"
    # Entries and keys are bound by a lambda each, so that they are made once whatever follows.
    kept = "map_from_entries(filter(e, (x, i) -> NOT array_contains(slice(k, i + 2, size(k)), x.key)))"
    keyed = f"transform(array(transform(e, x -> x.key)), k -> {kept})[0]"
    plain = f"forall(map_values({properties}), v -> v IS NOT NULL AND NOT is_variant_null(v) AND NOT startswith({kind('v')}, 'OBJECT') AND NOT startswith({kind('v')}, 'ARRAY'))"
    # Scalars alone stay as they are, which is cheaper to see than to make anew.
    return F.when(F.col(properties).isNotNull(), F.when(F.expr(plain), F.col(properties)).otherwise(F.expr(f"transform(array({every}), e -> {keyed})[0]")))


def merged(rows: DataFrame, keys: list[str], properties: str = "properties", seq: str = "seq", last: tuple[str, ...] = ()) -> DataFrame:
    """keys and the property map in which of each key's values the one with the largest seq wins, nulls included;
    and the columns `last` of the record with the largest seq. A key without properties has an empty map."""
    each = rows.select(*keys, seq, *last, F.explode_outer(properties).alias("k", "v"))
    own = each.groupBy(*keys, "k").agg(F.max_by("v", seq).alias("v"), F.max(seq).alias("_seq"), *[F.max_by(c, seq).alias(c) for c in last])
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    return own.groupBy(*keys).agg(F.map_from_entries(entries).alias(properties), *[F.max_by(c, "_seq").alias(c) for c in last])


def without_nulls(properties: Column) -> Column:
    """A JSON null inside a variant is not an SQL null; both go."""
    return F.map_filter(properties, lambda k, v: v.isNotNull() & ~F.is_variant_null(v))
