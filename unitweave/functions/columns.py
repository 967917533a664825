"""Column functions on units, features and counts."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitweave.functions.tables import LEXICAL_CODES

#: Stands for a unit past the end of a short sample in the key of an n-gram, and for a null value in a value feature.
PAD, NULL = "_", "\\N"

#: Lexical units in the order in which they are tried at each place, in the syntax that Java and RE2 share.
LEXER = (
    r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
    r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
    r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
    r"|`[^`\\]*(?:\\.[^`\\]*)*`"
    r"|0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    r"|[\p{L}_$][\p{L}\p{N}_$]*"
    r"|>>>=|===|!==|>>>|<<=|>>=|\*\*=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
    r"|[^\x09-\x0D\x20]"
)
KEYWORDS = """
await break case catch class const continue debugger default delete do else export extends finally for function if import in
instanceof let new return static super switch this throw try typeof var void while with yield
""".split()


def unit_class(unit: Column) -> Column:
    """Code of the lexical class of a unit's text. Words come first, told by the first character's number: most units are
    words, and only those beyond ASCII need a pattern."""
    code, first = LEXICAL_CODES, F.ascii(unit)
    letter = first.between(97, 122) | first.between(65, 90) | first.isin(36, 95)
    word = (
        F.when(unit.isin("true", "false"), code["Boolean"]).when(unit == "null", code["Null"])
        .when(unit.isin(KEYWORDS), code["Keyword"]).otherwise(code["Identifier"])
    )
    return (
        F.when(letter | ((first >= 128) & F.regexp_like(unit, F.lit(r"^\p{L}"))), word)
        .when(first.between(48, 57), code["Numeric"])
        .when(unit.startswith("//"), code["LineComment"]).when(unit.startswith("/*"), code["BlockComment"])
        .when((F.length(unit) > 1) & first.isin(34, 39), code["String"])
        .when((F.length(unit) > 1) & (first == 96), code["Template"]).otherwise(code["Punctuator"])
    )


def ngrams(units: Column, n: int = 4) -> Column:
    """Array of n-gram keys: n consecutive units joined by commas; one padded key if there are fewer than n units.

    Null for null or no units, and for n below 1.
    """
    if n < 1:
        return F.lit(None).cast("array<string>")
    size = F.size(units)
    joined = lambda t: F.transform(
        F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), ",", PAD)
    )
    full = F.transform(F.array(units.cast("array<string>")), joined)[0]  # the inner variable holds the array, made once
    padded = F.array(
        F.array_join(
            F.concat(units.cast("array<string>"), F.array_repeat(F.lit(PAD), F.greatest(n - size, F.lit(0)))), ",", PAD
        )
    )
    return F.when(size >= n, full).when(size > 0, padded)


#: Bits of a unit in a packed n-gram; 0 is the pad, codes count from 1.
BITS = 7


def packable(units: Column, n: int) -> Column:
    """Whether a sample's n-grams fit in 63 bits: all codes are small, and there are few enough of them."""
    if n < 1 or n * BITS > 63:
        return F.lit(False)
    return F.forall(units, lambda u: F.coalesce(u.between(0, (1 << BITS) - 2), F.lit(False)))


def packed_ngrams(units: Column, n: int = 4) -> Column:
    """The n-grams of `ngrams` as numbers, BITS to a unit, for units that are `packable`; null for no units.

    Windows of 2, 4, 8 and so on units are two neighbouring windows of half the size, and those of n units are put
    together from them: a few additions for each, however long it is.
    """
    size = F.size(units)
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  so that x is made once

    def joined(a: Column, p: int, b: Column, q: int) -> Column:
        """Windows of p + q units from those of p and of q."""
        many = size - (p + q - 1)
        return F.zip_with(F.slice(a, 1, many), F.slice(b, p + 1, many), lambda x, y: F.shiftleft(x, BITS * q) + y)

    def grown(w: Column, p: int, found: Column | None, r: int) -> Column:
        """Windows of n units. w: windows of p units, a power of 2; found: windows of r units, the powers of n below p."""
        if n & p:
            found, r = (joined(found, r, w, p), r + p) if r else (w, p)
        return found if 2 * p > n else bound(joined(w, p, w, p), lambda wide: grown(wide, 2 * p, found, r))

    ones = F.transform(units, lambda u: u.cast("long") + 1)
    short = F.aggregate(units, F.lit(0).cast("long"), lambda total, u: F.shiftleft(total, BITS) + u + 1)
    padded = F.array(F.call_function("shiftleft", short, F.greatest(n - size, F.lit(0)) * BITS))
    return F.when(size >= n, bound(ones, lambda w: grown(w, 1, None, 0))).when(size > 0, padded)


def unpacked_key(packed: Column, n: int = 4) -> Column:
    """The text key of a packed n-gram."""
    code = lambda k: F.shiftrightunsigned(packed, BITS * (n - 1 - k)).bitwiseAND((1 << BITS) - 1)
    return F.concat_ws(",", *[F.when(code(k) == 0, PAD).otherwise((code(k) - 1).cast("string")) for k in range(n)])


def value_key(unit: Column, value: Column) -> Column:
    """Key of a (unit, value) feature. Truth values share the integers' keys; newlines are taken out."""
    text = F.regexp_replace(value, "\n", "")
    return F.concat(unit.cast("string"), F.lit(":"), F.coalesce(text, F.lit(NULL)))


def literal_type(value_type: Column, attributes: Column) -> Column:
    """Unit of a literal: by the type of its value, else RegExp if it has a pattern, else the unit Literal."""
    return (
        F.when(value_type == "string", "String").when(value_type.isin("int", "bool"), "Int").when(value_type == "float", "Numeric")
        .when(value_type == "null", "Null").when(F.map_contains_key(attributes, F.lit("regex")), "RegExp").otherwise("Literal")
    )


def leaf_value(attributes: Column) -> Column:
    """Attribute value as text (a null value that is present gives None), else attribute name, else null."""
    value = F.element_at(attributes, "value")
    return F.when(
        F.map_contains_key(attributes, F.lit("value")), F.coalesce(value, F.lit("None"))
    ).otherwise(F.element_at(attributes, "name"))


def chi2_critical(confidence: float = 99) -> float:
    """Critical value for one degree of freedom at a confidence in percent, to two decimals."""
    return round(NormalDist().inv_cdf(1 - (1 - confidence / 100) / 2) ** 2, 2)


def chi2_statistic(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-by-two chi-square with continuity correction (clamped at 0); 0 if a row or column is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, gap = a + b + c + d, F.abs(a * d - b * c)
    gap = F.greatest(gap - n / 2, F.lit(0.0))
    return F.coalesce(F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d)), F.lit(0.0))
