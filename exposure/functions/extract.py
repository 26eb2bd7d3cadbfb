"""Candidate extraction: text column in, array of plausible secret values out.

Everything happens inside the row. No shuffle is needed to remove repeats, and the candidate
text never has to leave the expression: ``candidate_hashes`` gives SHA-256 values only.

A string needs ``gate.min_chars`` characters to pass the gate. The patterns carry that bound, so
ordinary prose is discarded by the scan instead of being split, normalised and scored.

The building blocks are SQL text (see ``sqltext``); the column functions are at the end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from exposure.functions import sqltext as S
from exposure.functions.text import (
    ASCII_SPACE,
    UNICODE_SPACE,
    after_equals_sql,
    entropy_sql,
    has_distinct_sql,
    is_high_value_key_sql,
    is_noise_sql,
    may_pass_sql,
    normalise_sql,
    parse_json_sql,
)
from exposure.params import Gate

# Character class and least length of the three secret shapes.
SHAPES = (
    ("A-Za-z0-9+/=", 20),
    ("0-9a-fA-F", 32),
    ("A-Za-z0-9._-", 24),
)
# Markers followed by a secret.
PREFIXES = ("Bearer ", "token=", "key=", "secret=", "api_key=", "--token=", "-t ")
# What separates tokens on a line, besides white space.
TOKEN_DELIMITERS = r"\"'=,:\[\]{}|;"

_JSON_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_JSON_TOKEN = rf"(?s){_JSON_STRING}(\s*+:(?:\s*+{_JSON_STRING})?)?"

_NONE = "cast(array() AS array<string>)"


def _all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {S.raw(pattern)}, {group})"


def _runs(text: str, cls: str, least: int) -> str:
    """Maximal runs of a character class, tried only where a run begins."""
    return _all(text, f"(?<![{cls}])[{cls}]{{{least},}}")


def long_runs(text: str, least: int) -> str:
    """The text reduced to its unbroken runs of at least ``least`` characters."""
    return f"array_join({_runs(text, f'^{ASCII_SPACE}', least)}, '\\n')"


def shape_matches(text: str, least: int = 1) -> str:
    """All matches of the secret shapes."""
    return f"concat({', '.join(_runs(text, cls, max(n, least)) for cls, n in SHAPES)})"


def prefix_tails(text: str) -> str:
    """Per line and marker: what follows the first marker, up to a space, quote, comma or semicolon."""
    parts = []
    for p in PREFIXES:
        pattern = f"(?:^|\\n)(?>[^\\n]*?{re.escape(p)})([^{UNICODE_SPACE}\"',;]*+)"
        parts.append(f"if(contains({text}, '{p}'), {_all(text, pattern, 1)}, {_NONE})")
    return f"concat({', '.join(parts)})"


def right_hand_sides(text: str, least: int) -> str:
    """Per line: everything after the first ``=``."""
    pattern = f"(?:^|\\n)[^=\\n]*+=([^\\n]{{{least},}})"
    return f"if(contains({text}, '='), {_all(text, pattern, 1)}, {_NONE})"


def line_tokens_sql(runs: str, least: int) -> str:
    return _runs(runs, f"^{ASCII_SPACE}{TOKEN_DELIMITERS}", least)


def plain_words(runs: str, least: int) -> str:
    """Words without ``=``, cut at commas, colons and semicolons."""
    pattern = f"(?<![^{UNICODE_SPACE}])[^={UNICODE_SPACE}]{{{least},}}+(?![^{UNICODE_SPACE}])"
    return f"flatten(transform({_all(runs, pattern)}, w -> split(w, '[,:;]+')))"


def json_pairs(text: str, least: int = 1) -> str:
    """``array<struct<key,value>>`` of every string value of at least ``least`` bytes of a valid JSON text, else empty.

    Array elements and a bare top-level string have the key ``''``. No value has more bytes than lie between the text's first and
    last quote, as escapes are longer than what they stand for; texts where that is too little are not parsed.
    """

    def part(i: int) -> str:
        return f"regexp_extract(tok, {S.raw(_JSON_TOKEN)}, {i})"

    def unescape(c: str) -> str:
        backslash = S.literal("\\")
        decoded = f"from_json(concat('[\"', {c}, '\"]'), 'array<string>')[0]"
        return f"if(contains({c}, {backslash}), {decoded}, {c})"

    keyed = f"{part(2)} != ''"
    pair = (
        f"named_struct('key', if({keyed}, {unescape(part(1))}, ''), "
        f"'value', if({keyed}, {unescape(part(3))}, {unescape(part(1))}))"
    )
    pairs = f"filter(transform({_all(text, _JSON_TOKEN)}, tok -> {pair}), p -> octet_length(p.value) >= {least})"
    looks = S.raw(r"^[ \t\r\n]*+[{\[\"]")
    quoted = f"octet_length(regexp_extract({text}, {S.raw('(?s)".*"')}, 0)) >= {least + 2}"
    valid = f"(CASE WHEN {text} rlike {looks} AND {quoted} THEN {parse_json_sql(text)} END) IS NOT NULL"
    return f"CASE WHEN {valid} THEN {pairs} ELSE cast(array() AS array<struct<key:string,value:string>>) END"


# How a raw piece is treated, kept as its first character so that arrays of strings stay
# hashable: cut at the first ``=``; as it is; or cut, and taken whatever its entropy.
_CUT, _WHOLE, _NAMED = "c", "w", "n"


def _tag(values: str, tag: str) -> str:
    return f"transform({values}, v -> concat('{tag}', v))"


def _finish(tagged: str, gate: Gate) -> str:
    """Normalise, cut and gate raw pieces; sorted and distinct. All kinds go through one chain.

    Normalising and cutting never lengthen a piece, so those with too few bytes are dropped first.
    """
    long_enough = f"filter({tagged}, t -> octet_length(t) > {gate.min_len})"
    cleaned = f"transform(array_distinct({long_enough}), t -> concat(left(t, 1), {normalise_sql('substr(t, 2)')}))"
    rest = f"concat(left(t, 1), {normalise_sql(after_equals_sql('t'))})"
    cut = f"transform({cleaned}, t -> if(NOT startswith(t, '{_WHOLE}') AND instr(t, '=') > 0, {rest}, t))"
    named = f"startswith(t, '{_NAMED}')"
    passes = S.let(
        "substr(t, 2)",
        lambda c: f"octet_length({c}) >= {gate.min_len} AND ({named} OR {may_pass_sql(c, gate)}) "
        f"AND NOT {is_noise_sql(c)} AND ({named} OR {entropy_sql(c)} >= {gate.min_entropy}D)",
    )
    values = f"filter(array_distinct({cut}), t -> {passes})"
    return f"sort_array(array_distinct(transform({values}, t -> substr(t, 2))))"


def _json_pieces(pairs: str) -> str:
    all_values = f"transform({pairs}, p -> concat('{_CUT}', p.value))"
    named = f"filter({pairs}, p -> {is_high_value_key_sql('p.key')})"
    return f"concat({all_values}, transform({named}, p -> concat('{_NAMED}', p.value)))"


def _high_entropy_matches_sql(text: str, min_len: int = 12, min_entropy: float = 4.0) -> str:
    gate = Gate(min_len, min_entropy)
    passes = (
        f"octet_length(m) >= {min_len} AND {has_distinct_sql('m', gate.min_distinct)} "
        f"AND {entropy_sql('m')} >= {min_entropy}D"
    )
    shortest = min(n for _, n in SHAPES)
    return S.let(
        long_runs(text, shortest),
        lambda runs: f"filter(array_distinct({shape_matches(runs, gate.min_chars)}), m -> {passes})",
    )


def _high_entropy_hits_sql(text: str, min_len: int = 12, min_entropy: float = 4.0) -> str:
    return f"size({_high_entropy_matches_sql(text, min_len, min_entropy)})"


def _high_entropy_hashes_sql(text: str, min_len: int = 12, min_entropy: float = 4.0) -> str:
    return f"transform({_high_entropy_matches_sql(text, min_len, min_entropy)}, m -> sha2(m, 256))"


def _seeded_sql(text: str, gate: Gate = Gate()) -> str:
    return _finish(_tag(shape_matches(text, gate.min_chars), _CUT), gate)


def _from_lines_sql(text: str, gate: Gate = Gate()) -> str:
    n = gate.min_chars
    whole = f"concat({right_hand_sides(text, n)}, {line_tokens_sql(long_runs(text, n), n)})"
    return _finish(f"concat({_tag(prefix_tails(text), _CUT)}, {_tag(whole, _WHOLE)})", gate)


def _from_words_sql(text: str, gate: Gate = Gate()) -> str:
    n = gate.min_chars
    return _finish(_tag(plain_words(long_runs(text, n), n), _WHOLE), gate)


def _from_json_sql(text: str, gate: Gate = Gate()) -> str:
    return _finish(S.let(json_pairs(text, max(1, gate.min_len)), _json_pieces), gate)


def _candidates_sql(text: str, gate: Gate = Gate(), structured: bool = True) -> str:
    n = gate.min_chars

    def of_runs(runs: str) -> str:
        cut = f"concat({shape_matches(runs, n)}, {prefix_tails(text)})"
        whole = f"concat({right_hand_sides(text, n)}, {line_tokens_sql(runs, n)}, {plain_words(runs, n)})"
        return f"concat({_tag(cut, _CUT)}, {_tag(whole, _WHOLE)})"

    pieces = S.let(long_runs(text, n), of_runs)
    if structured:
        pieces = f"concat({pieces}, {S.let(json_pairs(text, max(1, gate.min_len)), _json_pieces)})"
    return f"if({text} IS NULL, {_NONE}, {_finish(pieces, gate)})"


def _candidate_hashes_sql(text: str, gate: Gate = Gate(), structured: bool = True) -> str:
    return f"transform({_candidates_sql(text, gate, structured)}, c -> sha2(c, 256))"


def _line_tokens_column_sql(text: str, least: int) -> str:
    return S.let(long_runs(text, least), lambda runs: line_tokens_sql(runs, least))


# --- column functions -------------------------------------------------------------------------

_high_entropy_hits = S.column_function(_high_entropy_hits_sql)
_high_entropy_hashes = S.column_function(_high_entropy_hashes_sql)
_seeded = S.column_function(_seeded_sql)
_from_lines = S.column_function(_from_lines_sql)
_from_words = S.column_function(_from_words_sql)
_from_json = S.column_function(_from_json_sql)
_candidates = S.column_function(_candidates_sql)
_candidate_hashes = S.column_function(_candidate_hashes_sql)
_line_tokens = S.column_function(_line_tokens_column_sql)


def high_entropy_hits(text: Column | str, min_len: int = 12, min_entropy: float = 4.0) -> Column:
    """How many distinct shape matches reach the length and the entropy."""
    return _high_entropy_hits(text, min_len, float(min_entropy))


def high_entropy_hashes(text: Column | str, min_len: int = 12, min_entropy: float = 4.0) -> Column:
    """SHA-256 (hex) of the distinct shape matches that ``high_entropy_hits`` counts."""
    return _high_entropy_hashes(text, min_len, float(min_entropy))


def seeded(text: Column | str, gate: Gate = Gate()) -> Column:
    """Candidates found by shape alone."""
    return _seeded(text, gate)


def from_lines(text: Column | str, gate: Gate = Gate()) -> Column:
    """Candidates found by markers, assignments and tokens of a line."""
    return _from_lines(text, gate)


def from_words(text: Column | str, gate: Gate = Gate()) -> Column:
    """Candidates found as plain words."""
    return _from_words(text, gate)


def from_json_text(text: Column | str, gate: Gate = Gate()) -> Column:
    """Candidates found as string values of a JSON text."""
    return _from_json(text, gate)


def line_tokens(text: Column | str, least: int) -> Column:
    """Tokens of at least ``least`` characters, repeats included."""
    return _line_tokens(text, least)


def candidates(text: Column | str, gate: Gate = Gate()) -> Column:
    """Sorted distinct plausible secret values of a text (``array<string>``)."""
    return _candidates(text, gate)


def candidate_hashes(text: Column | str, gate: Gate = Gate(), structured: bool = True) -> Column:
    """SHA-256 (hex) of every candidate of a text. Without ``structured`` the text is not tried as JSON; all else goes by lines, so the candidates of a
    text are then those of its parts, cut behind line ends."""
    return _candidate_hashes(text, gate, structured)
