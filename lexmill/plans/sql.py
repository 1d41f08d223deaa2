"""Snippets the oracle SQL is written with (DuckDB)."""

SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORD = r"[\p{L}\p{Nl}\p{No}]+"


def lower(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def fold(x: str) -> str:
    return f"translate({lower(x)}, 'əıçğöşü', 'eicgosu')"


def words(x: str) -> str:
    return f"regexp_extract_all({lower(x)}, '{WORD}')"


def ngrams(tokens: str, n: int) -> str:
    """Distinct n-grams of a list."""
    return f"(CASE WHEN len({tokens}) >= {n} THEN list_distinct(list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(list_slice({tokens}, i, i + {n} - 1), ' '))) ELSE [] END)"


def segments(table: str, key: str, text: str) -> str:
    """`(key, seq, s)`: the non-empty fallback segments of a text, numbered from 0."""
    cut = rf"regexp_replace(regexp_replace({text}, '([.!?])\s+([A-ZƏÇĞİÖŞÜ])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n', chr(1), 'g')"
    parts = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {collapse('x')}), lambda x: x <> '')"
    return f"(SELECT {key}, unnest(range(0, len(p)))::INT AS seq, unnest(p) AS s FROM (SELECT {key}, {parts} AS p FROM {table} WHERE {text} IS NOT NULL))"
