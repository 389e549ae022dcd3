"""Text, number and truth-value column expressions shared by every operator.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation and can be pushed around freely by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as white space in the source data
# (ASCII blanks plus NBSP, BOM and the Unicode space separators).
WHITESPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_WS = "[\\s\\u000b\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trim_ws(c: Column) -> Column:
    """Trim every kind of white space, not only U+0020 as ``trim`` does."""
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_blank(c: Column) -> Column:
    """Trimmed text; null becomes the empty string."""
    return F.coalesce(trim_ws(c), F.lit(""))


def fold_arabic(c: Column) -> Column:
    """Fold Arabic spelling variants so that names can be matched.

    Alef maksura becomes ya, a word-final ha becomes ta marbuta, and hamza on
    or under alef is dropped (madda is kept).
    """
    trimmed = trim_ws(F.coalesce(c, F.lit("")))
    folded = F.when(trimmed.contains("ه"), F.regexp_replace(trimmed, f"ه(?={_WS}|\\z)", "ة")).otherwise(trimmed)
    return F.translate(folded, "ىأإ", "ياا")


def text_key(c: Column) -> Column:
    """Matching key of a name: folded, single-spaced, lower-case.

    One test tells whether a name holds a letter to fold or any inner white
    space; one that does not needs only trimming and lower case.  Letters are
    looked up by ``translate``; regular expressions run only where they change something.
    """
    trimmed = trim_ws(F.coalesce(c, F.lit("")))
    other = WHITESPACE.replace(" ", "")
    spaced = F.translate(fold_arabic(c), other, " " * len(other))
    folded = F.lower(F.when(spaced.contains("  "), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))
    return F.when(F.translate(trimmed, "هىأإ" + WHITESPACE, "") != trimmed, folded).otherwise(F.lower(trimmed))


def truthy(c: Column) -> Column:
    """True for text that is present: not null, not empty, and not a zero."""
    return F.coalesce((c != "") & ~F.trim(c).rlike(r"^[+-]?0+(\.0*)?$"), F.lit(False))


def present(c: Column) -> Column:
    """True for text that is neither null nor empty (a zero counts as present)."""
    return F.coalesce(c != "", F.lit(False))


def first_filled(*cols: Column | str) -> Column:
    """First value that is neither null nor empty; columns or literals."""
    return F.coalesce(*[F.nullif(c, F.lit("")) if isinstance(c, Column) else F.lit(c) for c in cols])


def parse_number(c: Column) -> Column:
    """Number of a text cell: null stays null, unreadable or non-finite text is 0."""
    t = trim_ws(c)
    return F.when(
        present(c),
        F.when(t.rlike(_PLAIN_NUMBER), F.coalesce(t.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)),
    )


def is_not_numeric(c: Column) -> Column:
    """True for a non-blank cell that does not hold a plain number."""
    t = trim_ws(c)
    return present(t) & ~t.rlike(_PLAIN_NUMBER)


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and the infinities become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))


def natural_key(c: Column) -> Column:
    """Sort key that orders digit runs of any length by value: each run without leading zeros, after its length."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    between = F.split(c, r"\d+")
    bare = F.transform(runs, lambda r: F.regexp_replace(r, r"^0+(?=\d)", ""))
    sized = F.transform(bare, lambda r: F.concat(F.lpad(F.length(r).cast("string"), 10, "0"), r))
    return F.array_join(F.zip_with(between, sized, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
