"""Column helpers on strings: white space, quotes, entropy and plausibility.

The ``*_sql`` functions take and give SQL text; the ones without take and give columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions import sqltext as S
from exposure.params import Gate

# The Unicode White_Space characters, as the inside of a character class.
UNICODE_SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# White space as a regular-expression \s without Unicode sees it.
ASCII_SPACE = r"\t\n\f\r "
# The Unicode white space as the characters themselves.
SPACE_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
QUOTES = "\"'`"
# Characters of a string that are looked at first.
HEAD_CHARS = 256

# Words that mark a short string as a placeholder rather than a secret.
NOISE_WORDS = (
    "password", "secret", "changeme", "your_api_key", "example",
    "test", "demo", "placeholder", "insert", "here",
)
# Key names whose string values are taken for secrets whatever their entropy.
HIGH_VALUE_KEYS = (
    "password", "secret", "token", "credential",
    "api_key", "apikey", "private_key", "privatekey",
    "access_token", "accesstoken", "auth_token",
    "client_secret", "clientsecret",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain Python reference would copy the expression into every use, and the optimiser may
    copy a projected column back into its consumers. A lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def trim_space_sql(c: str) -> str:
    return f"btrim({c}, {S.literal(SPACE_CHARS)})"


def strip_quote_pairs_sql(c: str) -> str:
    """Drop every balanced outer pair of equal quotes, however deeply nested.

    The number of pairs is the length of the common prefix of the leading quote run and the
    reversed trailing one, at most half the string, so no level limit is needed.
    """
    lead = f"regexp_extract({c}, {S.raw(f'^[{QUOTES}]*')}, 0)"
    trail = f"reverse(regexp_extract({c}, {S.raw(f'[{QUOTES}]*' + chr(92) + 'z')}, 0))"
    first_difference = f"array_position(zip_with(split({lead}, ''), split({trail}, ''), (a, b) -> a <=> b), false)"
    common = S.let(f"cast({first_difference} AS int)", lambda at: f"if({at} > 0, {at} - 1, char_length({lead}))")
    pairs = f"least({common}, cast(char_length({c}) div 2 AS int))"
    return S.let(pairs, lambda k: f"substr({c}, {k} + 1, char_length({c}) - 2 * {k})")


def normalise_sql(c: str) -> str:
    """Trim, remove balanced outer quote pairs, trim again."""
    quoted = S.raw(f"^[{QUOTES}]")
    return S.let(
        trim_space_sql(c),
        lambda t: f"if({t} rlike {quoted}, {trim_space_sql(strip_quote_pairs_sql(t))}, {t})",
    )


def after_equals_sql(c: str) -> str:
    return f"regexp_replace({c}, {S.raw('(?s)^[^=]*=')}, '')"


def value_side_sql(c: str) -> str:
    """What follows the first ``=``, normalised; the string itself where there is none."""
    return f"if(instr({c}, '=') > 0, {normalise_sql(after_equals_sql(c))}, {c})"


def entropy_sql(c: str) -> str:
    """Shannon entropy in bits: character counts over the byte length, rounded to 9 digits.

    Each distinct character is counted by removing it from what is left of the string, so the
    rest shrinks with every step and long strings stay cheap.
    """
    share = f"(octet_length(acc.rest) - octet_length(rest)) / octet_length(ch) / octet_length({c})"
    bits = f"acc.bits - {S.let(share, lambda p: f'{p} * log2({p})')}"
    step = f"transform(array(replace(acc.rest, ch, '')), rest -> named_struct('rest', rest, 'bits', {bits}))[0]"
    chars = f"array_remove(array_distinct(split({c}, '')), '')"
    start = f"named_struct('rest', {c}, 'bits', cast(0 AS double))"
    return f"round(aggregate({chars}, {start}, (acc, ch) -> {step}, acc -> acc.bits), 9)"


def is_noise_sql(c: str) -> str:
    """Short strings holding a placeholder word, and one byte repeated."""
    words = f"(octet_length({c}) < 20 AND lower({c}) rlike '{'|'.join(NOISE_WORDS)}')"
    same = S.raw(r"(?s)^([\x00-\x7F])\1*\z")
    return f"({words} OR {c} rlike {same})"


def has_distinct_sql(c: str, least: int) -> str:
    """At least so many distinct characters; a long string is only split as a whole where its head has fewer."""
    head = f"size(array_distinct(split(left({c}, {HEAD_CHARS}), ''))) >= {least}"
    return f"({head} OR char_length({c}) > {HEAD_CHARS} AND size(array_distinct(split({c}, ''))) >= {least})"


def may_pass_sql(c: str, gate: Gate) -> str:
    """Cheap conditions every string that passes the entropy gate meets."""
    cheap = f"char_length({c}) >= {gate.min_chars}"
    if gate.min_distinct > 1:
        cheap += f" AND {has_distinct_sql(c, gate.min_distinct)}"
    return f"({cheap})"


def is_plausible_sql(c: str, gate: Gate = Gate()) -> str:
    """Length, noise and entropy gates."""
    return (
        f"(octet_length({c}) >= {gate.min_len} AND {may_pass_sql(c, gate)} AND NOT {is_noise_sql(c)} "
        f"AND {entropy_sql(c)} >= {gate.min_entropy}D)"
    )


def parse_json_sql(c: str) -> str:
    """The text as a variant, NULL unless it is exactly one JSON value.

    The parser stops after the first value. Read as the first element of an array that ends in a
    number made from the text itself, nothing can follow that value unseen.
    """

    def first(mark: str) -> str:
        wrapped = S.let(
            f"try_parse_json(concat('[', {c}, ',', {mark}, ']'))",
            lambda w: f"if(try_variant_get({w}, '$[1]', 'bigint') = {mark}, "
            f"try_variant_get({w}, '$[0]', 'variant'), NULL)",
        )
        return f"if({c} IS NULL, NULL, {wrapped})"

    return S.let(f"xxhash64({c})", first)


parse_json = S.column_function(parse_json_sql)
normalise = S.column_function(normalise_sql)
value_side = S.column_function(value_side_sql)
entropy = S.column_function(entropy_sql)
is_noise = S.column_function(is_noise_sql)
is_plausible = S.column_function(is_plausible_sql)
may_pass = S.column_function(may_pass_sql)


def is_high_value_key_sql(key: str) -> str:
    return f"lower({key}) rlike '{'|'.join(HIGH_VALUE_KEYS)}'"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
