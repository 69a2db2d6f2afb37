"""Text functions as Column expressions: cleaning, segmentation, shape tests and gates.

Word edges are explicit classes of letters, digits and underscore, which mean the same in every regular-expression dialect.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Word lists and patterns of the gates.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
BULLETS = "[▪⚫•◦●■]"
SCOPE_WORDS = "or|either|neither|nor|if|unless|not|no|never|may|might|can|could|must|shall|should|would|only|except"
PHENOMENA = {
    "definition": r"(is|are)\s+(a|an|the)",
    "negation": "not|no|never|neither",
    "condition": "if|unless|when|only|except",
    "modality": "must|should|may|can|shall|could|might",
    "relation": "supports?|provides?|includes?|requires?|consists?|enables?|integrates?",
}
MARKERS = ("it", "its", "they", "them", "their", "this unit", "that unit", "these units", "those units", "former", "latter", "aforementioned")
TITLE_STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
#: Heads of a definition that name no kind, and words that open or refuse one.
NO_KINDS = ("application", "division", "part", "subset", "one", "type", "kind", "form", "processing", "combination", "group", "set", "component", "aspect")
LEADS = "within|under|during|when|if|although|according|for"
REFUSED = "or|either|neither|nor|unless|except|if|not|no|may|might|can|must"
#: Publication numbers, and a month with its year.
CITED = rf"FM\s+[0-9][0-9-]*|(ATP|ADP|ADRP|JP)\s+[0-9][0-9.-]*|({MONTHS})\s+[0-9]{{4}}"
#: White space in any script, in a notation that several dialects share.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A run of white space that squash() changes: anything but a lone plain blank. The one range in front tells plain signs apart at once.
GAP = rf"[^!-~](?:(?<! )(?<={BLANK})|(?<= )(?=[^!-~])(?={BLANK})){BLANK}*"
WORD = r"[\p{L}\p{N}_]"
MAX_TOKENS = 64
MIN_SENTENCE_WORDS = 5


def bounded(words: str) -> str:
    """A pattern for words that stand by themselves, any case."""
    return rf"(?i)(?<!{WORD})(?:{words})(?!{WORD})"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores (and '' at an end without one)."""
    return F.split(F.lower(text), r"[^a-z0-9_\p{L}\p{N}]+")


def has_word(text: Column, words: str) -> Column:
    """Whether one of the words (alternatives of a pattern) stands in the text by itself, in any case. Plain words, with s? at their ends at most, are looked up among the tokens, which costs one pass for all of them."""
    parts = words.split("|")
    if all(re.fullmatch(r"[a-z]+(s\?)?", p) for p in parts):
        plain = [x for p in parts for x in ((p[:-2], p[:-1]) if p.endswith("?") else (p,))]
        return F.coalesce(F.arrays_overlap(tokens(text), F.array(*map(F.lit, plain))), text.isNotNull() & F.lit(False))
    return F.regexp_like(text, F.lit(bounded(words)))


def denies(text: Column) -> Column:
    """A contracted negation."""
    return (F.contains(text, F.lit("'")) | F.contains(text, F.lit("’"))) & F.regexp_like(text, F.lit(rf"(?i)n['’]t(?!{WORD})"))


def squash(text: Column) -> Column:
    """Runs of white space, of any script, become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def text_key(text: Column) -> Column:
    return F.lower(squash(text))


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def n_squashed(text: Column) -> Column:
    """Words of a squashed text: one more than its blanks."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def sentences(text: Column) -> Column:
    """Squashed pieces that end in . ! or ? before white space."""
    return F.split(squash(text), " (?<=[.!?] )")


def is_sentence(s: Column) -> Column:
    """Of a squashed text: five words or more, not only digits and signs, no bullet in front."""
    return (n_squashed(s) >= MIN_SENTENCE_WORDS) & F.regexp_like(s, F.lit(r"\p{L}")) & ~F.regexp_like(s, F.lit(rf"^\s*({BULLETS}|[-*] )"))


def first_sentence(text: Column) -> Column:
    """The first sentence with abbreviations protected; NULL under six words or without a final stop."""
    guarded = text
    for a in ("U.S.", "e.g.", "i.e."):
        guarded = F.replace(guarded, F.lit(a), F.lit(a.replace(".", "․")))
    first = F.trim(F.replace(F.element_at(F.split(guarded, r"(?<=[.!?])\s+(?=[A-Z(])", 2), 1), F.lit("․"), F.lit(".")))
    return F.when((n_words(first) >= 6) & F.regexp_like(first, F.lit(r"[.!?]$")), first)


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition, for which there is no built-in function."""
    return pandas_udf(_nfkc, "string")(text)


def clean_line(line: Column) -> Column:
    """A line composed (NFKC), without soft hyphens, with broken words joined and blanks squashed; NULL for numbers, running heads and short lines in capitals."""
    t = squash(F.regexp_replace(F.replace(nfkc(line), F.lit("­"), F.lit("")), rf"(?<={WORD})-{BLANK}+(?={WORD})", ""))
    head = F.regexp_like(t, F.lit(rf"^(?i)(FM\s+[0-9][0-9-]*|(CHAPTER|SECTION)\s+[A-Za-z0-9_]+(\s+[A-Za-z0-9_]+)*|([0-9]{{1,2}}\s+)?({MONTHS})\s+[0-9]{{4}})$"))
    shout = (n_words(t) < 6) & F.regexp_like(t, F.lit(r"\p{L}")) & (F.upper(t) == t)
    return F.when(t == "", t).when(F.regexp_like(t, F.lit(r"^[0-9]+$")) | head | shout, F.lit(None).cast("string")).otherwise(t)


def is_heading(line: Column) -> Column:
    """No final stop, under ten words, all capitals or each word capitalised but for stop words."""
    s = F.trim(line)
    bare = F.transform(words(s), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[()\[\]{}:,;/-]+", ""), r"[()\[\]{}:,;/-]+$", ""))
    titled = F.forall(bare, lambda w: (w == "") | (F.upper(w) == w) | F.lower(w).isin(*TITLE_STOPWORDS) | F.regexp_like(w, F.lit(r"^\p{Lu}")))
    return (s != "") & ~F.endswith(s, F.lit(".")) & (n_words(s) < 10) & ((F.upper(s) == s) | titled)


def join_hyphens(page: Column) -> Column:
    """Words broken over a line end by a hyphen are joined."""
    return F.regexp_replace(page, rf"(?<={WORD})-[ \t]*\n{BLANK}*(?={WORD})", "")


def is_noise(text: Column, *, squashed: bool = False) -> Column:
    """Layout and citations: empty text, bullets, publication numbers, '(see', month and year, page numbers like 1-2. A text that is squashed already is not squashed again; a citation has a blank before a digit."""
    t = text if squashed else squash(text)
    return (
        (t == "") | F.regexp_like(t, F.lit(BULLETS)) | F.regexp_like(t, F.lit(r"^(?i)[(\[]see"))
        | (F.regexp_like(t, F.lit(r"\s[0-9]")) & has_word(t, CITED)) | F.regexp_like(t, F.lit(r"^[0-9]+-[0-9]+($|[^\p{L}\p{N}_])"))
    )


def unsupported_reasons(text: Column) -> Column:
    """Why the controlled fragment cannot hold a sentence: several sentences, over 64 tokens, the first discourse marker."""
    t, several, n, said = _fragment(text)
    marker = F.coalesce(*[F.when(has_word(said, m), F.lit(f"marker {m}")) for m in MARKERS])
    return F.array_compact(F.array(F.when(several, F.lit("several sentences")), F.when(n > MAX_TOKENS, F.concat(F.lit("too long: "), n.cast("string"))), marker))


def _fragment(text: Column, squashed: bool = False) -> tuple[Column, Column, Column, Column]:
    """A prompt's text, whether it is several sentences, its tokens, and it without the two exempted phrases. Each pattern passes once over the text, however long."""
    bare = F.regexp_replace(text, r"^(?i)\s*translate(\s+to\s+[A-Za-z0-9_]+)?\s*:\s*", "")
    t = F.when(F.lower(F.substring(text, 1, 9)) == "translate", bare).otherwise(text) if squashed else squash(bare)
    several = F.regexp_like(t, F.lit("^[.!? ]*+[^.!? ][^.!?]*+[.!?][.!? ]*+[^.!? ]"))
    role = lambda x: F.when(F.regexp_like(x, F.lit(r"(?i)as\s+its\s")), F.regexp_replace(x, bounded(r"as\s+its\s+(agent|patient|destination|origin)"), "as SLOT")).otherwise(x)
    said = role(F.regexp_replace(t, r"^(?i)it is not the case that\s+", ""))
    return t, several, F.regexp_count(t, F.lit("[A-Za-z0-9_?'-]+")), said


def unsupported(text: Column, *, squashed: bool = False) -> Column:
    """Whether there is any of unsupported_reasons(); so many tokens need twice as many characters. Only a text that holds a marker or "unit" is looked at without the exempted phrases."""
    t, several, n, said = _fragment(text, squashed)
    one, more = ("|".join(m for m in MARKERS if (" " in m) == two) for two in (False, True))
    return several | ((F.length(t) > 2 * MAX_TOKENS) & (n > MAX_TOKENS)) | (has_word(t, one) & has_word(said, one)) | (F.contains(F.lower(t), F.lit(" unit")) & has_word(said, more))


def scoped(text: Column) -> Column:
    """Scope or modality words, or a contracted negation."""
    return has_word(text, SCOPE_WORDS) | denies(text)


def phenomena(text: Column) -> Column:
    """The tags of PHENOMENA that a text has, or other. Its tokens are made once and the plain words found among them; a definition has is or are among them."""
    plain = {k: [x for w in p.split("|") for x in ((w[:-2], w[:-1]) if w.endswith("?") else (w,))] for k, p in PHENOMENA.items() if k != "definition"}
    listed = F.array(*map(F.lit, dict.fromkeys(["is", "are", *(w for ws in plain.values() for w in ws)])))

    def tags(found: Column) -> Column:
        has = lambda ws: F.arrays_overlap(found, F.array(*map(F.lit, ws)))
        holds = {k: has(plain[k]) if k in plain else has(["is", "are"]) & has_word(text, p) for k, p in PHENOMENA.items()}
        return F.array_compact(F.array(*[F.when(c | denies(text) if k == "negation" else c, F.lit(k)) for k, c in holds.items()]))

    got = F.element_at(F.transform(F.array(F.array_intersect(tokens(text), listed)), tags), 1)
    return F.element_at(F.transform(F.array(got), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("other")))), 1)


def shapes(text: Column) -> dict[str, Column]:
    """Six shapes of a prompt."""
    return {
        "copular": has_word(text, r"(is|are|was|were)\s+(an?|the|some)"),
        "existential": has_word(text, r"some|there\s+is|there\s+are|exists|exist|at\s+least\s+one"),
        "subclass": has_word(text, r"subclass|kind of|type of|class of"),
        "conditional": F.regexp_like(text, F.lit(r"(?i)^(every|each|all|no)($|[^\p{L}\p{N}_])")) | has_word(text, "if"),
        "negation": has_word(text, "not|no|never"),
        "nary": has_word(text, "among") | F.regexp_like(text, F.lit(r"\[[^\]]+,")),
    }


def spaced(term: Column) -> Column:
    """PascalCase to lower words."""
    return F.lower(F.regexp_replace(term, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def pascal(phrase: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(phrase, F.lit("[A-Za-z0-9]+"), 0), lambda w: upper_first(w)), "")


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def article(word: Column) -> Column:
    return F.when(F.lower(F.left(word, F.lit(1))).isin("a", "e", "i", "o", "u"), F.lit("an")).otherwise(F.lit("a"))


def singular(phrase: Column) -> Column:
    """The head noun (the last word) in the singular, in any case: ies (of over four letters) to y, ses, xes, ches and shes without es, other s but ss, us and is without s."""
    w = F.regexp_extract(phrase, r"([^ ]+)$", 1)
    rest = F.regexp_replace(phrase, r"[^ ]+$", "")
    one = (
        F.when(F.regexp_like(w, F.lit("(?i)..ies$")), F.regexp_replace(w, "(?i)ies$", "y"))
        .when(F.regexp_like(w, F.lit("(?i)(s|x|ch|sh)es$")), F.regexp_replace(w, "(?i)es$", ""))
        .when(F.regexp_like(w, F.lit("(?i)(^|[^sui])s$")), F.regexp_replace(w, "(?i)s$", "")).otherwise(w)
    )
    return F.concat(rest, one)


def ngrams(tokens: Column, longest: int = 6) -> Column:
    """Runs of 1 to `longest` words, longest first, distinct. The tokens are bound once, so they are not made anew for each run."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.transform(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda k: F.array_join(F.slice(t, k, n), " "))).otherwise(none))
    return F.array_distinct(F.flatten(F.flatten(F.transform(F.array(tokens), runs))))


def clean_doc(doc: Column) -> Column:
    """A term's documentation without markup: the first sentence, 300 characters at most; under ten, empty."""
    t = squash(F.regexp_replace(F.regexp_replace(doc, r"<[^>]*>|&%", ""), '"', ""))
    s = F.substring(F.regexp_extract(t, r"^([^.]*\.?)", 1), 1, 300)
    return F.when(F.length(s) < 10, F.lit("")).otherwise(s)


def definition_head(sentence: Column) -> dict[str, Column]:
    """The copular head of a sentence, or why there is none, in the order of the checks."""
    pattern = r"^(?i)\s*([A-Za-z][A-Za-z'-]*(?:\s+[A-Za-z][A-Za-z'-]*){0,5}?)\s+(?:is|are)\s+(?:(?:a|an|the)\s+)?([A-Za-z][A-Za-z'-]*)(?:$|[^\p{L}\p{N}_].*)"
    subject, head = F.regexp_extract(sentence, pattern, 1), F.lower(F.regexp_extract(sentence, pattern, 2))
    reason = (
        F.when(F.regexp_like(sentence, F.lit(rf"(?i)^({LEADS})(?!{WORD})")), "leading_scope")
        .when(has_word(sentence, REFUSED), "condition_negation_or_disjunction")
        .when(head == "", "no_simple_definition_head")
        .when(head.isin(*NO_KINDS) | F.endswith(head, F.lit("ed")), "non_kind_predicate")
    )
    return {"reason": reason, "subject": F.when(reason.isNull(), subject), "head": F.when(reason.isNull(), head)}
