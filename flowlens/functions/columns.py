"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F, types as T

EPSILON = 1e-9

# Whitespace as Unicode defines it, and the dashes folded to "-".
SPACE = (
    "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
DASH = "[\\x{2010}-\\x{2015}\\x{2212}\\x{FFFD}]"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, names, what: str) -> None:
    """Fail on the driver, before any job runs."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def squeeze(c: str | Column) -> Column:
    """Strip, one space for each run of whitespace, empty text to null."""
    text = F.regexp_replace(as_col(c), f"{SPACE}+", " ")
    return F.nullif(F.btrim(text), F.lit(""))


def to_number(c: str | Column) -> Column:
    """Text to double; text that is no number becomes null."""
    return as_col(c).try_cast("double")


def is_inf(c: str | Column) -> Column:
    return F.abs(as_col(c)) == F.lit(float("inf"))


def finite(c: str | Column, otherwise: float | None = None) -> Column:
    """Infinity and NaN to null; with a value, these and null to the value.

    x + 0 x is x when finite and NaN when not: one sum instead of branches that repeat the expression.
    """
    c = as_col(c).cast("double")
    probe = c + c * F.lit(0.0)
    if otherwise is None:
        return F.nullif(probe, F.lit(float("nan")))
    return F.coalesce(F.nanvl(probe, F.lit(float(otherwise))), F.lit(float(otherwise)))


def finite_frame(df: DataFrame, otherwise: float | None = None, known: Collection[str] = ()) -> DataFrame:
    """`finite` over every floating column but those known to be finite."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in known]
    return df.withColumns({name: finite(name, otherwise) for name in floats}) if floats else df


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """Zero where the denominator is (almost) zero or the quotient is not finite."""
    n, d = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return finite(F.when(F.abs(d) > F.lit(EPSILON), n / d), 0.0)


def column_key(c: str | Column) -> Column:
    """Raw column name to snake case."""
    text = F.lower(F.regexp_replace(as_col(c), f"^{SPACE}+|{SPACE}+$", ""))
    text = F.replace(F.replace(text, F.lit("%"), F.lit("pct")), F.lit("/"), F.lit("_per_"))
    text = F.btrim(F.regexp_replace(text, "[^0-9a-zA-Z]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("unnamed_column"))


def clean_label(c: str | Column) -> Column:
    """Dash variants to "-", dashes spaced, whitespace squeezed, outer blanks and dashes stripped."""
    text = F.regexp_replace(as_col(c), DASH, "-")
    text = F.regexp_replace(text, f"{SPACE}*-{SPACE}*", " - ")
    text = F.regexp_replace(text, f"{SPACE}+", " ")
    return F.btrim(text, F.lit(" -"))


def label_key(c: str | Column) -> Column:
    """Key under which the alias table is searched."""
    return F.btrim(F.regexp_replace(F.lower(clean_label(c)), "[^0-9a-zA-Z]+", " "))


def hash_key(row_id: str | Column, seed: int | str) -> Column:
    """Deterministic random order: independent of partitioning."""
    return F.md5(F.concat_ws("-", as_col(row_id).cast("string"), F.lit(str(seed))))


def hash_unit(*parts: str | Column) -> Column:
    """Uniform number in [0, 1) from the given parts."""
    text = F.concat_ws("-", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def quantized(c: str | Column, digits: int = 6) -> Column:
    return F.round(as_col(c), digits)


def with_fixed_text(df: DataFrame, **texts: tuple[str, int]) -> DataFrame:
    """Adds columns with a number below 128 as text of fixed decimals: `name=(number column, decimals)`.

    The exact binary value is rounded half to even. `format_string` rounds the shortest decimal text half up,
    which differs on values such as 40.625. The steps are separate projections, so that nothing is computed
    twice; products are taken in two limbs of 28 bits, so that none overflows.
    """
    low = F.lit(2**28 - 1)
    at = {f"_{name}": (c, d) for name, (c, d) in texts.items()}
    out = df.withColumns({f"{n}_s": (F.col(c) * F.lit(2.0**56)).cast("bigint") for n, (c, _) in at.items()})
    out = out.withColumns({f"{n}_l": F.col(f"{n}_s").bitwiseAND(low) * 10**d for n, (_, d) in at.items()})
    out = out.withColumns({
        f"{n}_h": F.shiftright(f"{n}_s", 28) * 10**d + F.shiftright(f"{n}_l", 28) for n, (_, d) in at.items()})
    out = out.withColumns({
        f"{n}_r": F.shiftleft(F.col(f"{n}_h").bitwiseAND(low), 28) + F.col(f"{n}_l").bitwiseAND(low) for n in at})
    half = F.lit(2**55)
    # half to even: an odd quotient rounds up on the half, an even one only beyond it
    out = out.withColumns({
        f"{n}_q": F.shiftright(f"{n}_h", 28) + (F.col(f"{n}_r") + F.shiftright(f"{n}_h", 28).bitwiseAND(F.lit(1)) > half).cast("bigint")
        for n in at})
    made = {
        name: F.concat(F.expr(f"cast(_{name}_q div {10**d} as string)"), F.lit("."),
                       F.lpad(F.expr(f"cast(_{name}_q % {10**d} as string)"), d, "0"))
        for name, (_, d) in texts.items()}
    return out.withColumns(made).drop(*[f"{n}_{step}" for n in at for step in "slhrq"])
