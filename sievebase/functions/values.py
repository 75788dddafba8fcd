"""Value semantics: 15-digit numbers, number/string conversion, ordering keys, string helpers.

All functions take and return Columns, so they stay inside generated code and can be pushed around by
the optimiser.  Python UDFs are never used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
SIGNIFICANT_DIGITS = 15
TOO_LARGE = 1e76
TOO_SMALL = 1e-75

_NUMBER = r"\A *[+-]? *([0-9]+\.?[0-9]*|\.[0-9]+)([Ee][+-]?[0-9]+)? *\z"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def r15(x: Column) -> Column:
    """Rounds a double to 15 significant digits; magnitudes out of range become 0.

    ``%.14e`` rounds the shortest decimal form, not the binary value.  The two differ only where that
    form has 16 digits and ends in 5; there the exact remainder against this tie decides.
    """
    return bound(x.cast("double"), lambda v: bound(F.format_string("%.15e", F.abs(v)), lambda s: _rounded(v, s)))


def _rounded(x: Column, sixteen: Column) -> Column:
    a = F.abs(x)
    digits = F.regexp_replace(F.substring_index(sixteen, "e", 1), r"\.", "").cast("long")
    places = 15 - F.substring_index(sixteen, "e", -1).cast("int")
    remainder = _exact_product_less(a, F.pow(F.lit(10.0), places), digits)
    down = F.concat(F.substring(sixteen, 1, 16), F.lit("e"), F.substring_index(sixteen, "e", -1)).cast("double")
    below = (remainder < 0) | ((remainder == 0) & (F.floor(digits / 10) % 2 == 0))
    tie = (digits % 10 == 5) & (sixteen.cast("double") == a) & places.between(0, 22)
    nearest_ = F.when(tie & below, F.signum(x) * down).otherwise(F.format_string("%.14e", x).cast("double"))
    return F.when(x.isNull(), None).when((a >= TOO_LARGE) | (a < TOO_SMALL), F.lit(0.0)).otherwise(nearest_)


def _exact_product_less(a: Column, b: Column, n: Column) -> Column:
    """``a * b - n`` with the product's rounding error included; the product is near the integer n."""

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * 134217729.0  # 2 ** 27 + 1
        high = big - (big - v)
        return high, v - high

    product, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    error = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    return (F.round(product, 0).cast("long") - n).cast("double") + (product - F.round(product, 0)) + error


def to_num(s: Column) -> Column:
    """The number a string stands for, null if it isn't one.

    Blanks may surround it and follow its sign; the empty string is 0; more than 15 significant
    digits or a magnitude out of range make it invalid.
    """
    compact = F.regexp_replace(s, " ", "")
    digits = F.regexp_replace(F.regexp_replace(compact, r"[Ee].*$", ""), r"[^0-9]", "")
    significant = F.length(F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", ""))
    value = compact.try_cast("double")
    in_range = (value == 0) | ((F.abs(value) < TOO_LARGE) & (F.abs(value) >= TOO_SMALL))
    return F.when(F.trim(s) == "", F.lit(0.0)).when(s.rlike(_NUMBER) & (significant <= SIGNIFICANT_DIGITS) & in_range, value)


def number_of(text: str) -> float | None:
    """:func:`to_num` of a constant, for the operands of comparisons."""
    if not text.strip(" "):
        return 0.0
    if not re.fullmatch(_NUMBER.removeprefix(r"\A").removesuffix(r"\z"), text):
        return None
    mantissa = re.sub("[^0-9]", "", re.split("[Ee]", text)[0])
    value = float(text.replace(" ", ""))
    fits = len(mantissa.lstrip("0").rstrip("0")) <= SIGNIFICANT_DIGITS and (value == 0 or TOO_SMALL <= abs(value) < TOO_LARGE)
    return value if fits else None


def num_or_zero(s: Column) -> Column:
    """As :func:`to_num`, invalid strings counting as 0 (null stays null)."""
    return F.when(s.isNull(), None).otherwise(F.coalesce(to_num(s), F.lit(0.0)))


def num_to_str(x: Column) -> Column:
    """Display form of a number: plain decimal where 15 digits do, else an exponent.

    Numbers whose shortest decimal form is plain and has at most 15 digits, and whole ones, are shown by
    a cast; only the rest take the long way over rounding and formatting.
    """
    x = x.cast("double")
    shortest, size = x.cast("string"), F.abs(x)
    short = (size >= 1e-3) & (size < 1e7) & (F.length(shortest) <= F.when(x < 0, SIGNIFICANT_DIGITS + 2).otherwise(SIGNIFICANT_DIGITS + 1))
    whole = (size < 1e15) & (x == F.floor(x))
    return F.when(x.isNull(), None).when(whole, F.floor(x).cast("string")).when(short, shortest).otherwise(bound(r15(x), _shown))


def _shown(x: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,19)").cast("string"), r"0+$", ""), r"\.$", "")
    exponent = F.regexp_replace(F.format_string("%.14E", x), r"\.?0*E", "E")
    return F.when(x == 0, F.lit("0")).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e15), plain).otherwise(exponent)


def fixed_dp(x: Column, places: int) -> Column:
    """Decimal string with ``places`` (0-9) digits after the point, cut off rather than rounded."""
    if not 0 <= places <= 9:
        raise ValueError("places must be from 0 to 9")
    scaled = r15(x).cast("decimal(38,15)")
    whole = F.abs(scaled).cast("string")
    cut = F.regexp_extract(F.concat(whole, F.lit("0" * 15)), r"^[0-9]+\.[0-9]{%d}" % places if places else r"^[0-9]+", 0)
    return F.when((scaled < 0) & cut.rlike("[1-9]"), F.concat(F.lit("-"), cut)).otherwise(cut)


# --- ordering keys -------------------------------------------------------------------------------


def right_adjusted(c: Column) -> list[Column]:
    """Sort keys: shorter strings first, then byte order."""
    return [F.octet_length(c), c]


def nocase(c: Column) -> Column:
    """ASCII upper-case form, the key of case-blind comparison."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


# --- number helpers ------------------------------------------------------------------------------


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def nearest(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x, 0).cast("long")


def away_from_zero(x: Column) -> Column:
    return (F.signum(x) * F.ceil(F.abs(x))).cast("long")


def round_places(x: Column, places: int, mode: str = "nearest") -> Column:
    """Rounds to ``places`` decimals: nearest (half away from zero), trunc or up (away from zero)."""
    if mode == "nearest":
        return F.round(x, places)
    scaled = F.round(x * 10.0**places, 6)
    step = {"trunc": F.floor, "up": F.ceil}[mode](F.abs(scaled))
    return F.signum(x) * step / 10.0**places


def int_to_hex(x: Column) -> Column:
    return F.hex(x)


def hex_to_int(s: Column) -> Column:
    return F.conv(s, 16, 10).try_cast("long")


# --- string helpers ------------------------------------------------------------------------------


def deblank(c: Column) -> Column:
    return F.trim(c)


def unblank(c: Column) -> Column:
    """Outer blanks removed, inner runs of blanks squeezed to one."""
    return F.regexp_replace(F.trim(c), " +", " ")


def pad_right(c: Column, n: int, pad: str = " ") -> Column:
    return F.rpad(c, n, pad)


def pad_left(c: Column, n: int, pad: str = " ") -> Column:
    """Right-justified in n characters; a longer string keeps its last n."""
    return F.lpad(F.right(c, F.lit(n)), n, pad)


def zero_pad(c: Column, n: int) -> Column:
    return pad_left(c.cast("string"), n, "0")


def pad_or_elide(c: Column, n: int) -> Column:
    """Exactly n characters; a longer string ends in three dots."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(max(0, n - 3))), F.lit("..."[:n]))).otherwise(F.rpad(c, n, " "))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def thousands_text(c: Column) -> Column:
    """A comma before every third character from the right, whatever the characters."""
    return F.regexp_replace(c, r"(?s)(?<=.)(?=(?:.{3})+\z)", ",")


def reverse(c: Column) -> Column:
    return F.reverse(c)


def replace_char(c: Column, old: str, new: str) -> Column:
    """Every ``old`` character replaced by ``new``."""
    return F.translate(c, old, new)


def replace_string(c: Column, old: str, new: str) -> Column:
    """Every occurrence of ``old``, from the left, replaced by ``new``; an empty ``old`` changes nothing."""
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def string_to_hex(c: Column) -> Column:
    """Two hex digits for each byte of the UTF-8 text."""
    return F.hex(c.cast("binary"))


def hex_to_string(c: Column) -> Column:
    """The text whose UTF-8 bytes the digits name, null where they don't name any."""
    return F.try_to_binary(c, F.lit("hex")).cast("string")


# --- words -----------------------------------------------------------------------------------------


def words(c: Column, separators: str = " ") -> Column:
    """Runs of characters other than the separators."""
    flat = F.translate(c, separators, separators[0] * len(separators))
    return F.filter(F.split(flat, f"\\Q{separators[0]}\\E"), lambda w: w != "")


def word(c: Column, n: int, separators: str = " ") -> Column:
    """The n-th word (from 1), empty if there are fewer."""
    return F.when(c.isNotNull(), F.coalesce(F.get(words(c, separators), F.lit(n - 1)), F.lit("")) if n >= 1 else F.lit(""))


def word_count(c: Column, separators: str = " ") -> Column:
    return F.size(words(c, separators))


def word_position(c: Column, n: int, separators: str = " ") -> Column:
    """Where the n-th word begins (from 1), 0 if there are fewer."""
    runs = "".join(f"\\x{{{ord(s):x}}}" for s in separators)
    before = F.regexp_extract(c, rf"\A((?:[{runs}]*[^{runs}]+){{{n - 1}}}[{runs}]+|[{runs}]*)(?=[^{runs}])" if n > 1 else rf"\A([{runs}]*)(?=[^{runs}])", 1)
    return F.when(word_count(c, separators) >= n, F.length(before) + 1).otherwise(F.when(c.isNotNull(), F.lit(0))) if n >= 1 else F.when(c.isNotNull(), F.lit(0))


def one_of(c: Column, choices: str, separator: str = "/") -> Column:
    """Whether the value is one of the listed ones."""
    return c.isin(choices.split(separator))


def is_digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]*\z")


def is_integer(c: Column) -> Column:
    """Digits and signs only, in any order (as loosely as the helper it stands for)."""
    return c.rlike(r"\A[0-9+-]*\z")


def is_alpha(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z]*\z")


def bracketed(c: Column, opening: str = "(", closing: str = ")") -> Column:
    """What stands between the first opening and the next closing bracket, empty if there is none."""
    inner = F.regexp_extract(c, rf"(?s)\Q{opening}\E(.*?)\Q{closing}\E", 1)
    return inner


def next_string(prefix: str) -> str | None:
    """The smallest string above all strings that begin with ``prefix`` (None if there is none)."""
    stem = prefix.rstrip("\U0010ffff")
    if not stem:
        return None
    following = ord(stem[-1]) + 1
    return stem[:-1] + chr(0xE000 if following == 0xD800 else following)


def _code_page(codec: str = "cp037") -> tuple[str, str]:
    """The 256 characters of Latin-1 and those that share their byte in ``codec``."""
    every = bytes(range(1, 256))
    return every.decode("latin-1"), every.decode("latin-1").encode(codec, "replace").decode("latin-1")


def to_ebcdic(c: Column) -> Column:
    """Latin-1 text whose characters stand for the EBCDIC bytes of ``c``."""
    plain, coded = _code_page()
    return F.translate(c, plain, coded)


def from_ebcdic(c: Column) -> Column:
    plain, coded = _code_page()
    return F.translate(c, coded, plain)
