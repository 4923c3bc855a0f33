"""Column functions over document text: words, whitespace, digests, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that separates words (the Unicode white-space
# set plus the four ASCII information separators).
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# The same set as a pattern; the property class is several times faster than the list.
_SPACES = r"(?U)[\s\x1c-\x1f]+"

# Floors of the length budgets.
MIN_TARGET_WORDS = 8
MIN_OUTPUT_TOKENS = 64
RESPONSE_HEADROOM = 64
CHARS_PER_TOKEN = 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """The white-space separated words of a text, in order."""
    return F.array_remove(F.split(_col(text), _SPACES), "")


def word_count(text: Column | str, at_least_one: bool = False) -> Column:
    n = F.size(words(text))
    return F.greatest(F.lit(1), n) if at_least_one else n


def strip_spaces(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(WHITESPACE))


def doc_digest(text: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(_col(text)), 1, 16)


def _key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u0001", *[p.cast("string") for p in parts])), 1, 24)


def summary_key(*, digest: Column | str, target: Column | str, model_tag: Column | str,
                prompt_version: Column | str, temperature: float = 0.0, seed: int = 0) -> Column:
    """Cache key of one summary: what was summarized, how long, by what, with which prompt."""
    tag = F.lit(model_tag) if isinstance(model_tag, str) else model_tag
    version = F.lit(prompt_version) if isinstance(prompt_version, str) else prompt_version
    return _key(version, tag, _col(digest), _col(target), F.lit(float(temperature)), F.lit(int(seed)))


def embedding_key(*, digest: Column | str, model_id: str, prefix: str, normalize: bool) -> Column:
    """Cache key of one embedding; per document, so a grown corpus re-encodes new rows only."""
    return _key(F.lit(model_id), F.lit(prefix), F.lit(normalize), _col(digest))


def target_words(text: Column | str, fraction: Column | float) -> Column:
    """Words to ask for when a text is shortened to ``fraction`` of its length."""
    share = F.lit(float(fraction)) if isinstance(fraction, (int, float)) else fraction.cast("double")
    asked = F.ceil(share * word_count(text, at_least_one=True)).cast("int")
    return F.greatest(F.lit(MIN_TARGET_WORDS), asked)


def output_budget(target: Column | str) -> Column:
    """Output tokens to allow for a summary of about ``target`` words."""
    asked = (_col(target) * 2).cast("int") + F.lit(MIN_OUTPUT_TOKENS)
    return F.greatest(F.lit(MIN_OUTPUT_TOKENS), asked)


def next_pow2(n: Column | str) -> Column:
    """Smallest power of two that is at least n (1 for n <= 1); exact for LONG."""
    n = _col(n).cast("long")
    bits = F.length(F.bin(n - 1))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    )


def context_budget(prompt_tokens: Column | str, *, num_ctx: int, max_ctx: int | None = None,
                   headroom: int = RESPONSE_HEADROOM, strict: bool = False) -> Column:
    """STRUCT<required, num_ctx, overflow> for a prompt of a known token count.

    The window grows to the next power of two, clamped to ``max_ctx``. With
    ``strict`` a prompt that still does not fit fails the job.
    """
    required = _col(prompt_tokens).cast("long") + F.lit(headroom)
    grown = next_pow2(required)
    if max_ctx is not None:
        grown = F.least(grown, F.lit(int(max_ctx)).cast("long"))
    window = F.when(required > num_ctx, grown).otherwise(F.lit(int(num_ctx)).cast("long"))
    overflow = required > window
    if strict:
        message = F.concat(F.lit("prompt needs "), required.cast("string"), F.lit(" tokens but the ceiling is "),
                           window.cast("string"))
        window = F.when(overflow, F.raise_error(message).cast("long")).otherwise(window)
    return F.struct(required.alias("required"), window.alias("num_ctx"), overflow.alias("overflow"))


def approx_tokens(prompt: Column | str) -> Column:
    return F.floor(F.length(_col(prompt)) / CHARS_PER_TOKEN).cast("long")


def with_prefix(text: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _col(text)) if prefix else _col(text)


def one_line_head(text: Column | str, n: int = 120) -> Column:
    """The first n characters with line feeds shown as spaces (for tables)."""
    return F.translate(F.substring(_col(text), 1, n), "\n", " ")


def clipped_head(text: Column | str, n: int, mark: str = "...") -> Column:
    """The first n characters, marked when something was cut off (for display)."""
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def compression_ratio(summary_words: Column | str, doc_words: Column | str) -> Column:
    return _col(summary_words) / F.greatest(F.lit(1), _col(doc_words))


def safe_tag(tag: Column | str) -> Column:
    """A model tag as it may appear in a file name."""
    return F.translate(_col(tag), "/:", "__")


def sidecar_name(tag: Column, version: Column, fraction: Column, n: Column, seed: Column) -> Column:
    """File name of a persisted example set; the fraction prints as in Python."""
    return F.concat(
        safe_tag(tag), F.lit("__"), version, F.lit("__frac"), fraction.cast("double").cast("string"),
        F.lit("__n"), n.cast("string"), F.lit("__seed"), seed.cast("string"), F.lit(".json"),
    )
