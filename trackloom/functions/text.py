"""Numbers in prose held against facts, names held against names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number with its unit; fixed pattern.
NUMBER = r"(?i)(?<![\w.])(\d+(?:\.\d+)?)\s*(%|m|metres|xg|s\b|seconds)?"
#: Numbers near these words are years or ordinals, not measurements; fixed words.
SKIP = r"(?i)\b(20\d\d|first|second|third|half)\b"
#: Tolerance of each unit; fixed values.
TOLERANCE = {"pct": 1.6, "m": 1.6, "xg": 0.04, "s": 0.25, "count": 1.0}


def unit_kind(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u == "%", "pct").when(u.isin("m", "metres"), "m").when(u == "xg", "xg").when(u.isin("s", "seconds"), "s").otherwise("count")


def tolerance(kind: Column) -> Column:
    out = F.lit(TOLERANCE["count"])
    for k, v in TOLERANCE.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, raw, value, kind) of each number of a text; unit-less ones within twelve characters of a skipped word are left out."""
    d = df.select(key, F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).alias("_raw"), F.split(text, NUMBER, -1).alias("_rest"))
    # the context is cut from the texts between the numbers; twelve characters hold at most twelve numbers
    ends = lambda cut: F.zip_with("_rest", "_raw", lambda t, r: F.concat(cut(t, F.lit(12)), F.coalesce(r, F.lit(""))))
    d = d.select(key, "_raw", "_rest", ends(F.right).alias("_before"), ends(F.left).alias("_after"))
    before = lambda i: F.concat(F.array_join(F.slice("_before", F.greatest(i - 11, F.lit(1)), F.least(i, F.lit(12))), ""), F.right(F.get("_rest", i), F.lit(12)))
    after = lambda i: F.array_join(F.slice("_after", i + 2, F.lit(13)), "")
    near = lambda r, i: F.concat(F.right(before(i), F.lit(12)), r, F.left(after(i), F.lit(12)))
    d = d.select(key, F.posexplode(F.transform("_raw", lambda r, i: F.struct(r.alias("raw"), near(r, i).alias("near")))).alias("i", "_n")).select(key, "i", "_n.raw", "_n.near")
    d = d.withColumn("num", F.regexp_extract("raw", r"\d+(?:\.\d+)?", 0)).withColumn("unit", F.regexp_extract("raw", NUMBER, 2))
    d = d.where(~((F.col("unit") == "") & F.regexp_like("near", F.lit(SKIP))))
    return d.select(key, "i", F.trim("raw").alias("raw"), F.col("num").cast("double").alias("value"), unit_kind(F.col("unit")).alias("kind"))


def check_numbers(found: DataFrame, facts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Numbers with backed and the nearest fact (by, kind, fact, label) of the same kind within its tolerance."""
    f = facts.select(*by, "kind", "fact", "label")
    j = found.join(f, [*by, "kind"], "left").withColumn("gap", F.abs(F.col("value") - F.col("fact")))
    near = F.when(F.col("gap") <= tolerance(F.col("kind")) + 1e-12, F.struct("gap", "label"))
    g = j.groupBy(*dict.fromkeys([key, *by]), "i", "raw", "value", "kind").agg(F.min(near).alias("b"))
    return g.select(*dict.fromkeys([key, *by]), "i", "raw", "value", "kind", F.col("b").isNotNull().alias("backed"), "b.label")


def audit(checked: DataFrame, *keys: str) -> DataFrame:
    b = F.col("backed")
    return checked.groupBy(*keys).agg(F.count("*").alias("n_numbers"), F.count(F.when(b, 1)).alias("n_backed"), F.count(F.when(~b, 1)).alias("n_unbacked"))


def flatten_json(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, label, value): numeric leaves of nested JSON objects with dotted paths, level by level until no object or array is left."""
    level = df.select(F.col(key).alias("_key"), F.lit("").alias("label"), F.parse_json(doc).alias("v"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        leaf = level.where(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")).select(F.col("_key").alias(key), "label", F.expr("try_variant_get(v, '$', 'double')").alias("value"))
        out = leaf if out is None else out.union(leaf)
        inner = level.where(kind.rlike("^(OBJECT|ARRAY)"))
        if inner.isEmpty():
            return out
        step = "SELECT _key, concat_ws('.', nullif(label, ''), coalesce(t.key, cast(t.pos AS string))) AS label, t.value AS v FROM {inner}, LATERAL variant_explode(v) AS t"
        level = df.sparkSession.sql(step, inner=inner)


def gate(coverage: Column, recall: Column, spread: Column | None = None) -> Column:
    """absolute, comparative (both teams alike) or abstain; a missing spread is never comparative."""
    full = (coverage >= 40) & (recall >= 50)
    tier = F.when(full, "absolute")
    if spread is not None:
        tier = tier.when(spread <= 0.05, "comparative")
    return tier.otherwise("abstain")


def name_match(a: Column, b: Column) -> Column:
    """One name holds the other, or some longer word of one equals or begins a word of the other."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda t: F.length(t) > 2)
    some = F.exists(words(a), lambda t: F.exists(words(b), lambda u: t.eqNullSafe(u) | u.startswith(t) | t.startswith(u)))
    return F.contains(b, a) | F.contains(a, b) | some
