"""Key hashes (sampling order) and index terms, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekin.options import SketchOptions

# A hex digit and the same digit with its top bit flipped.
HEX_DIGITS = "0123456789abcdef"
HEX_DIGITS_TOP_FLIPPED = "89abcdef01234567"


def md5_hex(key: Column) -> Column:
    return F.md5(key.cast("binary"))


def _signed_little_endian(key: Column) -> Column:
    """Hex text that sorts like the md5 bytes read as a signed little-endian number."""
    digest = md5_hex(key)
    top = F.translate(F.substring(digest, 31, 1), HEX_DIGITS, HEX_DIGITS_TOP_FLIPPED)
    rest = [F.substring(digest, start, 2) for start in range(29, 0, -2)]
    return F.concat(top, F.substring(digest, 32, 1), *rest)


def key_hash(key: Column, opts: SketchOptions) -> Column:
    """The value whose ascending order picks the sketch keys."""
    if callable(opts.hash_order):
        return opts.hash_order(key)
    if opts.hash_order == "be":
        return md5_hex(key)
    if opts.hash_order == "le_signed":
        return _signed_little_endian(key)
    if opts.hash_order == "xxhash64":
        return F.xxhash64(key)
    return F.sha2(key, 256)


def hash_sql(opts: SketchOptions) -> str | None:
    """SQL template for the hex text of :func:`key_hash`; None where it is no hex text."""
    if opts.hash_order == "be":
        return "md5({})"
    if opts.hash_order == "sha2":
        return "sha2({}, 256)"
    if opts.hash_order == "le_signed":
        # The digits of the last two bytes; no more of them are counted.
        top = f"translate(substring(md5({{0}}), 31, 1), '{HEX_DIGITS}', '{HEX_DIGITS_TOP_FLIPPED}')"
        return f"concat({top}, substring(md5({{0}}), 32, 1), substring(md5({{0}}), 29, 2))"
    return None


def _term_text(text: Column, opts: SketchOptions) -> Column:
    if opts.term == "md5":
        return md5_hex(text)
    digits = F.lower(F.hex(text))
    return F.when(F.length(digits) < 32, F.lpad(digits, 32, "0")).otherwise(digits)


def term(key: Column, sign: Column, opts: SketchOptions) -> Column:
    """Index term of a key with its sign label (``+1`` or ``-1``)."""
    inner = _term_text(key, opts) if opts.inner_hash else key
    return _term_text(F.concat(inner, sign), opts)


def sign_label(value: Column, mean: Column, opts: SketchOptions, negate: bool = False) -> Column:
    """``+1``/``-1``; ``negate`` labels the negated measure of the same sketch."""
    distance = value - mean if opts.label == "paper" else mean - value
    if negate:
        distance = -distance
    tie = F.lit(0.0)
    if opts.rel_eps:
        tie = F.lit(opts.rel_eps) * F.greatest(F.lit(1.0), F.abs(mean))
    return F.when(distance > tie, F.lit("+1")).otherwise(F.lit("-1"))
