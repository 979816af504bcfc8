"""JavaScript-style type tests on VARIANT fields.

The ``*_sql`` forms are the same tests as SQL text: an expression of hundreds of nodes is built
in one call that way.

Casting a variant would turn ``true`` into 1 and ``"5"`` into 5, so each reader looks at the
type tag first and yields NULL for a value of any other type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(event: Column, path: str) -> Column:
    """Sub-variant at ``path``; SQL NULL when absent, variant null when the JSON says null."""
    return F.try_variant_get(event, f"$.{path}", "variant")


def tag(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_sql(value: str) -> str:
    return f"case when schema_of_variant({value}) = 'STRING' then try_variant_get({value}, '$', 'string') end"


def number_sql(value: str) -> str:
    kind = f"schema_of_variant({value})"
    return (
        f"case when {kind} in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith({kind}, 'DECIMAL') "
        f"then try_variant_get({value}, '$', 'double') end"
    )


def truthy_sql(value: str) -> str:
    """JavaScript truthiness: absent, null, false, zero and the empty string are not."""
    kind = f"schema_of_variant({value})"
    return (
        f"coalesce(case when {kind} is null or {kind} = 'VOID' then false "
        f"when {kind} = 'STRING' then {string_sql(value)} <> '' "
        f"when {kind} = 'BOOLEAN' then try_variant_get({value}, '$', 'boolean') "
        f"when startswith({kind}, 'ARRAY') or startswith({kind}, 'OBJECT') then true "
        f"else {number_sql(value)} <> 0 end, true)"
    )


def list_sql(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def as_string(member: str) -> Column:
    return F.expr(string_sql(member))


def as_number(member: str) -> Column:
    return F.expr(number_sql(member))


def opening(raw: Column) -> Column:
    """First character of a JSON text, which tells its type."""
    return F.substring(F.ltrim(raw, F.lit(" \t\n\r")), 1, 1)


def top_level(raw: Column, names: tuple[str, ...]) -> Column:
    """Struct of the named members of a JSON object, each a variant, from one parse.

    All members are NULL unless the text is a well-formed object, see :func:`is_object`. Asking
    for the members by name lets the parser skip the rest, which is far cheaper than a lookup per
    member in a whole parsed document.
    """
    schema = ", ".join(f"`{n}` variant" for n in names) + ", `_malformed` string"
    # The screen for personal data takes strings to stand in double quotes.
    options = {"columnNameOfCorruptRecord": "_malformed", "allowSingleQuotes": "false"}
    return F.from_json(F.when(opening(raw) == "{", raw), schema, options)


def is_object(members: Column) -> Column:
    """True when :func:`top_level` met a well-formed object."""
    return members.isNotNull() & members["_malformed"].isNull()


def once(df: DataFrame, name: str, value: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its ``keep`` columns) with ``value`` as a column that is evaluated once per row.

    The optimizer copies a projected expression into every filter and projection above that uses
    it, but it never looks through a generator. The value is computed by a projection, which is
    compiled, and only handed on by the generator.
    """
    kept = list(df.columns if keep is None else keep)
    computed = df.select(*kept, value.alias("_value"))
    return computed.select(*kept, F.explode(F.array("_value")).alias(name))


def is_array(raw: Column) -> Column:
    return F.try_parse_json(F.when(opening(raw) == "[", raw)).isNotNull()


def one_of(text: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(text.isin(*values), F.lit(False))
