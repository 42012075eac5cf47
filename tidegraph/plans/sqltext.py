"""SQL that normalises texts of every script as the operators do, for the checks of queries against a database without NFKC."""

from __future__ import annotations

import unicodedata
from functools import cache


@cache
def _compatibility() -> str:
    """(c, f) of the characters that NFKC changes, up to the end of the supplementary symbols."""
    pairs = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4]
    pairs = [(c, f) for c, f in pairs if c != f]
    quoted = lambda xs: "[" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    return f"SELECT unnest({quoted([c for c, _ in pairs])}) AS c, unnest({quoted([f for _, f in pairs])}) AS f"


def surfaces(name: str, texts: str) -> str:
    """Common table expressions ending in name(x, s): the normalised surface of every distinct text x of the query `texts` (x)."""
    tidy = r"trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}\p{{M}}_\x{{3400}}-\x{{9fff}}]+', ' ', 'g'))"
    return rf"""{name}_c AS ({_compatibility()}),
{name}_x AS (SELECT DISTINCT x FROM ({texts}) WHERE x IS NOT NULL),
{name}_p AS (SELECT x, unnest(regexp_extract_all(x, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(x, '(?s).'), 1) AS i FROM {name}_x WHERE NOT regexp_full_match(x, '[\x00-\x7f]*')),
{name}_n AS (SELECT x, nfc_normalize(string_agg(coalesce(f, ch), '' ORDER BY i)) AS t FROM {name}_p LEFT JOIN {name}_c ON c = ch GROUP BY x),
{name} AS (SELECT x, {tidy.format('x')} AS s FROM {name}_x WHERE regexp_full_match(x, '[\x00-\x7f]*') UNION ALL SELECT x, {tidy.format('t')} FROM {name}_n)"""


def trigrams(c: str) -> str:
    """Distinct trigrams of the words of c, padded by two blanks before and one after."""
    pad = rf"list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: '  ' || w || ' ')"
    return f"list_distinct(flatten(list_transform({pad}, lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"
