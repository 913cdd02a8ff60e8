"""Text functions, Column to Column, within whole-stage codegen."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def normalize_space(c: Column) -> Column:
    """No-break spaces become spaces, line separators newlines; blanks collapse; no white space around a newline."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\u2028\u2029]", "\n"), r"[ \xa0\t\r\f\x0b]{2,}|[\xa0\t\r\f\x0b]", " ")  # not each single space
    return F.btrim(F.regexp_replace(c, r"\s*\n\s*", "\n"), F.lit(" \n\t\r"))


def clean_flat(c: Column) -> Column:
    """All white space to one space, curly apostrophe to straight; null to the empty text."""
    return F.btrim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("’"), F.lit("'")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def clean_text(c: Column) -> Column:
    """normalize_space(), which leaves no two newlines together; null if that is empty."""
    return F.nullif(normalize_space(c), F.lit(""))


def clean_span(c: Column) -> Column:
    return F.nullif(F.btrim(F.btrim(normalize_space(c), F.lit(" \t\n\r;."))), F.lit(""))


@cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """The compatibility decomposition (NFKD) without combining marks, by rule from the Unicode tables of this Python:
    characters that become one other or nothing (for translate; those that vanish come last), and a map of those that
    become several. Hangul syllables stay whole: their decomposition is one to one, so equality does not change."""
    one, gone, many = {}, [], {}
    for i in range(0xA0, 0x30000):
        c = chr(i)
        if unicodedata.combining(c):
            gone.append(c)
        elif unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one) + "".join(gone), "".join(one.values()), many


def strip_accents(c: Column) -> Column:
    """NFKD without combining marks. Only texts with a character that becomes several go through the map."""
    single, plain, many = decompositions()
    table = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    ranges: list[list[int]] = []
    for x in sorted(map(ord, many)):  # with gaps of up to 64: a class of few ranges is quick, and a needless look-up harmless
        if ranges and x - ranges[-1][1] <= 64:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    some = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    seldom = rf"[^\x00-\x{{{ranges[0][0] - 1:X}}}\x{{{ranges[0][1] + 1:X}}}-\x{{{ranges[1][0] - 1:X}}}]"
    return F.translate(F.when(F.rlike(c, F.lit(seldom)) & F.rlike(c, F.lit(some)), spread).otherwise(c), single, plain)


def bare_words(c: Column) -> Column:
    """The runs of a-z and 0-9 of the lower-case text without accents; null: none."""
    flat = F.btrim(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))
    return F.array_remove(F.split(flat, " "), "")


def normalize_key(c: Column) -> Column:
    return F.btrim(F.lower(clean_flat(c)), F.lit(" .;:,"))


def normalize_article_number(c: Column) -> Column:
    key = normalize_key(c)
    return F.when(key.isin("article liminaire", "art liminaire", "art. liminaire"), "liminaire").otherwise(key)


def normalize_source_code(c: Column) -> Column:
    """As normalize_key(), with the two other names of one code brought to the usual one."""
    named = F.replace(F.replace(F.lower(clean_flat(c)), F.lit("code rural (nouveau)"), F.lit(P.RURAL)), F.lit("code rural et de la peche maritime"), F.lit(P.RURAL))
    return F.btrim(named, F.lit(" .;:,"))


def normalize_gold_term(c: Column) -> Column:
    """Without one leading French article, if more than two characters follow it."""
    t = F.btrim(c, F.lit(" \t\r\n"))
    return F.coalesce(*(F.when(t.startswith(p) & (F.length(t) > len(p) + 2), F.btrim(F.substring(t, len(p) + 1, 1 << 30), F.lit(" \t\r\n"))) for p in P.LEADING_ARTICLES), t)


def is_blank(c: Column) -> Column:
    return F.coalesce(F.btrim(c, F.lit(" \t\r\n")), F.lit("")) == ""


def unknown_if_blank(c: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(c, F.lit(" \t\r\n")), F.lit("")), F.lit("unknown"))


def normalize_label(c: Column) -> Column:
    return F.lower(clean_text(c))


def first_non_empty(*columns: Column) -> Column:
    """The first value that is not blank, as it is."""
    return F.coalesce(*(F.when(clean_text(c).isNotNull(), c) for c in columns))


def first_given(*columns: Column) -> Column:
    """The first value that is neither null nor empty, cleaned; null if that is blank."""
    return clean_text(F.coalesce(*(F.nullif(c, F.lit("")) for c in columns)))


def search_text(c: Column) -> Column:
    """Text to look up normalised terms in as whole words: bare words between single spaces, one on either side."""
    return F.concat(F.lit(" "), F.array_join(bare_words(c), " "), F.lit(" "))


def normalize_term(c: Column) -> Column:
    return F.btrim(F.regexp_replace(strip_accents(F.lower(clean_flat(c))), r"\s*'\s*", "'"))


def normalize_for_match(c: Column) -> Column:
    return F.btrim(strip_accents(F.lower(clean_flat(c))), F.lit(" .;:,\"'"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalize_for_match(c), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), 0)


def token_f1(pred: Column, gold: Column) -> Column:
    """Multiset overlap F1 of two token arrays: both empty 1, one empty 0."""
    same = F.aggregate(F.array_distinct(pred), F.lit(0), lambda a, x: a + F.least(F.size(F.filter(pred, lambda y: y == x)), F.size(F.filter(gold, lambda y: y == x))))
    p, g = F.size(pred), F.size(gold)
    return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0) | (same == 0), 0.0).otherwise(2.0 * same / (p + g))


def safe_id_part(c: Column) -> Column:
    c = F.replace(F.translate(F.upper(F.coalesce(c, F.lit("UNK"))), P.ACCENTED, P.PLAIN), F.lit("Œ"), F.lit("OE"))
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("UNK"))


def preview(c: Column, most: int = 500) -> Column:
    flat = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most))), F.lit("..."))).otherwise(flat)


def word_total(c: Column) -> Column:
    return F.size(F.filter(F.split(F.btrim(c), r"(?U)\s+"), lambda x: x != ""))


def truncate_at_boundary(c: Column, most: int = 900) -> Column:
    c = F.split(F.split(normalize_space(c), r"\n\d+°\s", 2)[0], r"\n[a-z]\)\s", 2)[0]
    return F.coalesce(clean_span(F.when(F.length(c) > most, F.rtrim(F.left(c, F.lit(most)))).otherwise(c)), F.lit(""))


def trim_definition(c: Column) -> Column:
    def stop(c: Column, regex: str) -> Column:
        """Cuts at the first place the marker is found, if that is beyond the thirtieth character."""
        return F.btrim(F.regexp_replace(c, rf"(?sU)^((?:(?!{regex}).){{31,}}?){regex}.*$", "$1"))

    return F.btrim(reduce(stop, P.STOPS, clean_flat(c)), F.lit(" ;"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def coarse_pattern(c: Column) -> Column:
    p = F.coalesce(c, F.lit("unknown"))
    groups = [(p == "terme_colon_definition", "colon_definition"), (p.contains("s'entend de"), "sentend_de"), (p.contains("on entend par"), "on_entend_par"), (p.contains("défini") | p.contains("defini"), "defini_comme"), (p.contains("considéré") | p.contains("consideres"), "qualification")]
    return F.coalesce(*(F.when(test, name) for test, name in groups), F.lit("other"))
