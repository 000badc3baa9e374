"""Text expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmetry.constants import BACKEND_SHORT, PROMPT_TAIL_CHARS

# The characters Unicode counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def word_count(text: Column) -> Column:
    """Words separated by any Unicode whitespace. (Replacing characters and splitting on
    one blank takes a fraction of the time a regular expression with that class does.)"""
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.coalesce(F.size(F.array_remove(F.split(blanks, " "), "")), F.lit(0)).cast("long")


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.trim(text, F.lit(WHITESPACE))


def lookup(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Map through a small literal table; other values pass to ``default`` (or themselves)."""
    out = None
    for key, mapped in table.items():
        out = F.when(value == key, F.lit(mapped)) if out is None else out.when(value == key, F.lit(mapped))
    return out.otherwise(value if default is None else default)


def backend_label(tutor: Column, student: Column) -> Column:
    """``GPT↑ / Gemini↓``; unknown names pass through, missing ones show ``?``."""
    short_t = lookup(F.coalesce(tutor, F.lit("?")), BACKEND_SHORT)
    short_s = lookup(F.coalesce(student, F.lit("?")), BACKEND_SHORT)
    return F.concat(short_t, F.lit("↑ / "), short_s, F.lit("↓"))


def keep_tail(text: Column, chars: int = PROMPT_TAIL_CHARS) -> Column:
    """The last ``chars`` characters of the stripped text."""
    clean = strip(F.coalesce(text, F.lit("")))
    return F.right(clean, F.lit(chars))


def slug(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def file_slug(name: Column) -> Column:
    return F.translate(name, "/.", "_-")


def run_part(run: Column, index: int) -> Column:
    """Part ``index`` of ``<student>_<tutor>_<suffix>``; null below two parts."""
    parts = F.split(run, "_")
    return F.when(F.size(parts) >= 2, parts[index])


def variant_key(mode: Column, no_bias: Column) -> Column:
    """Name of an alignment variant; ``text_mms`` has no bias dimension."""
    return F.when((mode != "text_mms") & no_bias, F.concat(mode, F.lit("_no_bias"))).otherwise(mode)


def lettered_choices(choices: Column) -> Column:
    """``Choices:`` followed by ``  A. …`` lines; empty when there are none."""
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("  "), F.char(i + 65), F.lit(". "), c))
    block = F.concat(F.lit("Choices:\n"), F.array_join(lines, "\n"))
    return F.when(F.size(choices) > 0, block).otherwise("")


def render(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a template; text coming from a column is never re-read."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def exact_mean(x: Column, digits: int) -> Column:
    """Rounded mean that does not depend on the order of the rows. Null without values, NaN with a NaN among them.

    The sum is one of decimals (values count to nine places) and is divided once. Where a value has more than 19 digits before
    the point, or is infinite or NaN, the mean is that of the doubles.
    """
    exact = x.try_cast("decimal(28,9)")
    total = F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double"))
    return round_exact(F.try_divide(F.coalesce(total, F.sum(x.cast("double"))), F.count(x)), digits)


def round_exact(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals by its exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal text of the double, so 2.0115 goes to
    2.012 although the stored number lies below the tie. Here the scaled value and its
    rounding error come from an exact product (Dekker's split), so the last digit agrees
    with tools that round the stored number. NaN, infinities, and numbers so large that they have no such decimals stay as they are.
    """
    scale = float(10**digits)
    value = x.cast("double")
    head = F.lit(134217729.0) * value - (F.lit(134217729.0) * value - value)
    scaled = value * scale
    error = (head * scale - scaled) + (value - head) * scale
    whole = F.floor(scaled)
    past_tie = (scaled - whole - 0.5) + error
    up = (past_tie > 0) | ((past_tie == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return F.when(F.abs(scaled) < 2.0**52, (whole + up.cast("int")) / F.lit(scale)).otherwise(value)


def seconds(ms: Column, digits: int = 3) -> Column:
    """Milliseconds to seconds, rounded once."""
    return round_exact(ms / F.lit(1000.0), digits)


def ratio(top: Column, bottom: Column, digits: int = 3) -> Column:
    """Rounded quotient, 0.0 when the divisor is not positive."""
    return F.when(bottom > 0, round_exact(top / bottom, digits)).otherwise(F.lit(0.0))
