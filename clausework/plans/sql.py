"""Pieces of the independent SQL: the same rules as the Column functions, in another dialect."""

from __future__ import annotations

from ..functions import text as X

EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def bounded(col: str, words: str) -> str:
    return f"regexp_matches({col}, '{EDGE_L}({words}){EDGE_R}', 'i')"


#: White space of the Unicode standard, listed anew: the text functions have their own.
BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{0085}\x{00A0}\x{1680}\x{2000}\x{2001}\x{2002}\x{2003}\x{2004}\x{2005}\x{2006}\x{2007}\x{2008}\x{2009}\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def squash(col: str) -> str:
    return rf"trim(regexp_replace({col}, '{BLANK}', ' ', 'g'))"


def words(col: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({col}, '{BLANK}'), lambda x: x <> ''))"


def scoped(col: str) -> str:
    return f"({bounded(col, X.SCOPE_WORDS)} OR regexp_matches({col}, 'n[''’]t{EDGE_R}', 'i'))"


def noise(col: str) -> str:
    t = squash(col)
    return rf"({t} = '' OR regexp_matches({t}, '{X.BULLETS}') OR regexp_matches({t}, '^[(\[]see', 'i') OR {bounded(t, 'FM' + chr(92) + 's+[0-9][0-9-]*')} OR {bounded(t, '(ATP|ADP|ADRP|JP)' + chr(92) + 's+[0-9][0-9.-]*')} OR {bounded(t, '(' + X.MONTHS + ')' + chr(92) + 's+[0-9]{4}')} OR regexp_matches({t}, '^[0-9]+-[0-9]+{EDGE_R}'))"


def unsupported(col: str) -> str:
    t = squash(rf"regexp_replace({col}, '^\s*translate(\s+to\s+[A-Za-z0-9_]+)?\s*:\s*', '', 'i')")
    said = rf"regexp_replace(regexp_replace({t}, '^it is not the case that\s+', '', 'i'), '{EDGE_L}as\s+its\s+(agent|patient|destination|origin){EDGE_R}', '\1as SLOT\3', 'gi')"
    return f"(len(list_filter(regexp_split_to_array({t}, '[.!?]+'), lambda p: trim(p) <> '')) > 1 OR len(regexp_extract_all({t}, '[A-Za-z0-9_?''-]+')) > {X.MAX_TOKENS} OR {bounded(said, '|'.join(X.MARKERS))})"


def phenomena_list(col: str) -> str:
    tags = []
    for k, p in X.PHENOMENA.items():
        more = f" OR regexp_matches({col}, 'n[''’]t{EDGE_R}', 'i')" if k == "negation" else ""
        tags.append(f"CASE WHEN {bounded(col, p)}{more} THEN '{k}' END")
    got = f"list_filter([{', '.join(tags)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({got}) > 0 THEN {got} ELSE ['other'] END"


def values(rows: list[tuple], names: list[str], select: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"{select} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({', '.join(names)})"
