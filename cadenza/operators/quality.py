"""Data quality: rules to violations, completeness, list lengths, typed records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check of one column; ``arg`` is the pattern, the members or the flag of the kind."""

    column: str
    kind: str
    message: str
    arg: object = None


def _bad(rule: Rule) -> Column:
    c = F.col(rule.column)
    text = c.cast("string")
    kinds = {
        "present": lambda: c.isNull(),
        "bool_text": lambda: ~F.lower(text).isin("true", "false", "wahr", "falsch"),
        "integer": lambda: ~text.rlike(r"^[+-]?\d+$"),
        "natural": lambda: ~text.rlike(r"^\d+$") | (text.try_cast("decimal(38,0)") < (1 if rule.arg == "positive" else 0)),
        "integer_text": lambda: ~text.rlike(r"^-?\d+$"),
        "number_text": lambda: ~text.rlike(r"^-?\d+(?:\.\d*)?$") | (F.lit(False) if rule.arg is None else (text.try_cast("double") <= 0 if rule.arg == ">0" else text.try_cast("double") < 0)),
        "string": lambda: F.char_length(text) == 0,
        "list": lambda: ~text.rlike(r"(?s)^\[.*\]$|^[^{\[]*$"),
        "map": lambda: ~text.rlike(r"(?s)^\{.*\}$"),
        "regex": lambda: ~text.rlike(str(rule.arg)),
        "member": lambda: ~text.isin(*rule.arg),
    }
    return F.coalesce(kinds[rule.kind](), F.lit(False))


def validate(df: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """(key, column, message, value): one row per violated rule, in one pass; null values violate ``present`` only."""
    checks = F.array(*(F.when(_bad(r), F.struct(F.lit(r.column).alias("column"), F.lit(r.message).alias("message"), F.col(r.column).cast("string").alias("value"))) for r in rules))
    return df.select(F.col(key).alias("key"), F.explode(F.filter(checks, lambda v: v.isNotNull())).alias("v")).select("key", "v.*")


#: Rules up to which their table is broadcast.
BROADCAST_RULES = 50_000


def validate_by(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, column, message, value): the violations of a table of rules (column, kind, message, arg, members), of any length.

    The columns that have rules become rows (key, column, value), which meet the rules of their column, and the kind of a
    rule decides how ``arg`` (a pattern or flag) or ``members`` is taken. Rules of columns that ``df`` lacks do not apply; null values violate
    ``present`` only; an unknown kind is an error.
    """
    own = rules.filter(F.col("column").isin([c for c in df.columns if c != key] + [key]))
    names = [r[0] for r in own.select("column").distinct().collect()]  # no more than df has columns
    if not names:
        return df.select(F.col(key).alias("key"), *(F.lit("").alias(c) for c in ("column", "message", "value"))).limit(0)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names)))
    rows = df.select(F.col(key).alias("key"), pairs.alias("p")).select("key", "p.*")
    table = own.select("column", "kind", "message", "arg", "members")
    table = F.broadcast(table) if table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else table
    text, arg = F.col("value"), F.col("arg")
    number = ~text.rlike(r"^-?\d+(?:\.\d*)?$") | F.when(arg == ">0", text.try_cast("double") <= 0).when(arg == ">=0", text.try_cast("double") < 0).otherwise(False)
    kinds = {
        "present": text.isNull(), "bool_text": ~F.lower(text).isin("true", "false", "wahr", "falsch"), "integer": ~text.rlike(r"^[+-]?\d+$"),
        "natural": ~text.rlike(r"^\d+$") | (text.try_cast("decimal(38,0)") < F.when(arg == "positive", 1).otherwise(0)), "integer_text": ~text.rlike(r"^-?\d+$"),
        "number_text": number, "string": F.char_length(text) == 0, "list": ~text.rlike(r"(?s)^\[.*\]$|^[^{\[]*$"), "map": ~text.rlike(r"(?s)^\{.*\}$"),
        "regex": ~F.regexp_like(text, arg), "member": ~F.array_contains("members", text),
    }
    bad = F.raise_error(F.concat(F.lit("unknown kind of rule: "), F.coalesce("kind", F.lit("null")))).cast("boolean")
    for kind, broken in kinds.items():
        bad = F.when(F.col("kind") == kind, F.coalesce(broken, F.lit(False))).otherwise(bad)
    return rows.join(table, "column").filter(bad).select("key", "column", "message", "value")


def complete_by(df: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """Violations of a table of declared attributes (column, kind): absent, or not of their kind (text, integer, number, flag)."""
    rule = F.create_map(*(F.lit(x) for kv in {"integer": "integer", "number": "number_text", "flag": "bool_text", "text": "string"}.items() for x in kv))
    none = [F.lit(None).cast("string").alias("arg"), F.lit(None).cast("array<string>").alias("members")]
    own = kinds.select("column", F.try_element_at(rule, F.col("kind")).alias("kind"), F.concat(F.lit("no "), F.col("kind")).alias("message"), *none)
    there = kinds.select("column", F.lit("present").alias("kind"), F.lit("absent").alias("message"), *none)
    return validate_by(df, there.unionByName(own), key)


def complete(df: DataFrame, kinds: dict[str, str], key: str) -> DataFrame:
    """Violations of declared attributes: absent, or not of their kind (text, integer, number, flag)."""
    rule = {"integer": "integer", "number": "number_text", "flag": "bool_text", "text": "string"}
    rules = [Rule(c, "present", "absent") for c in kinds] + [Rule(c, rule[k], f"no {k}") for c, k in kinds.items()]
    return validate(df, rules, key)


def same_length(df: DataFrame, lists: Sequence[str], n: str, key: str) -> DataFrame:
    """(key, column, size): comma lists whose length is neither 1 nor that of the list ``n``."""
    size = lambda c: F.size(F.split(c, ","))
    bad = F.array(*(F.when((size(c) != size(n)) & (size(c) != 1), F.struct(F.lit(c).alias("column"), size(c).alias("size"))) for c in lists))
    return df.select(F.col(key).alias("key"), F.explode(F.filter(bad, lambda v: v.isNotNull())).alias("v")).select("key", "v.*")


def to_typed(settings: DataFrame, fields: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(records, violations): one row per song with a column per field.

    ``fields`` maps a field to (key, type); the last assignment counts, a value that can't be
    cast is null in the record and a violation.
    """
    raw = settings.groupBy("song").agg(*(F.max_by("value_text", F.when(F.col("key") == key, F.col("line"))).alias(f) for f, (key, _) in fields.items()))
    cast = {f: F.col(f).try_cast(t) for f, (_, t) in fields.items()}
    records = raw.select("song", *(v.alias(f) for f, v in cast.items()))
    bad = F.array(*(F.when(F.col(f).isNotNull() & v.isNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, v in cast.items()))
    return records, raw.select("song", F.explode(F.filter(bad, lambda v: v.isNotNull())).alias("v")).select("song", "v.*")
