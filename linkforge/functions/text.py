"""Normalisation of names and addresses as Column expressions; only folding of non-ASCII text is a UDF."""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import ADDR_CANON, LANDMARK, LEGAL, LEGAL_CANON, LEGAL_FORM

BUCKET = 8
"""About so many rules stand in one map."""
# What counts as a link in a name, and how single characters are written in ASCII.
URL = r"(^|\s)(https?://)?(www\.)?([a-z0-9\-]+)\.(com|net|org|in|co|io|fr|us|biz|info)\b"
VOWELS = "aeiou"
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng",
         "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "«": "<<", "»": ">>", "·": "."}


@lru_cache(maxsize=100_000)
def ascii_char(ch: str) -> str:
    """ASCII for one character: Latin by decomposition, other scripts by the sound in its Unicode name
    (DEVANAGARI LETTER KA: k; VOWEL SIGN E: e; CYRILLIC SMALL LETTER EM: m)."""
    if ch < "\x80":
        return ch
    low = ch.lower()
    if low in LATIN:
        return LATIN[low]
    base = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    if base and base.isascii():
        return base
    if unicodedata.category(ch)[0] == "N":
        value = unicodedata.numeric(ch, None)
        return f"{value:g}" if value is not None else ""
    if unicodedata.category(ch)[0] in "ZC":
        return " "
    words = unicodedata.name(base[:1] or ch, "").split()
    if not words:
        return ""
    if words[-1] in ("VIRAMA", "NUKTA", "HALANT", "SIGN"):
        return ""
    if words[-1] in ("ANUSVARA", "CANDRABINDU", "BINDI", "TIPPI"):
        return "m"
    sound = words[-1].lower()
    if "LETTER" not in words and "VOWEL" not in words or not sound.isalpha():
        return ""
    if sound[0] in VOWELS and sound[-1] not in VOWELS:
        sound = sound.lstrip(VOWELS)
    elif sound[0] not in VOWELS and len(sound) > 1:
        sound = sound.rstrip(VOWELS) or sound[:1]
    out = sound[:1]
    for c in sound[1:]:
        out += c if c != out[-1] else ""
    return out


def fold_text(s: str) -> str:
    return "".join(map(ascii_char, unicodedata.normalize("NFKC", s))).lower()


@F.pandas_udf(StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: fold_text(x) if x is not None else None, na_action="ignore")


def fold(raw: Column) -> Column:
    """Lower-case ASCII. Rows that are ASCII already reach the UDF as nulls and cost no folding."""
    odd = raw.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.when(odd, _fold_udf(F.when(odd, raw))), F.lower(raw), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def lookup(tokens: Column, rules: dict[str, str]) -> Column:
    """Each token replaced by its rule; unknown tokens stay."""
    return F.transform(tokens, lambda t: F.coalesce(rule_of(t, rules), t)) if rules else tokens


def rule_of(key: Column, rules: dict[str, str]) -> Column:
    """The rule for a key, or null. Maps are searched one entry after the other, so many rules are dealt by the
    key's checksum to maps of a few entries."""
    size = 1
    while size * BUCKET < len(rules):
        size *= 2
    dealt: list[list[Column]] = [[] for _ in range(size)]
    for k, v in rules.items():
        dealt[zlib.crc32(k.encode()) % size] += [F.lit(k), F.lit(v)]
    maps = [F.create_map(*own).cast("map<string,string>") for own in dealt]
    return F.try_element_at(F.get(F.array(*maps), F.pmod(F.crc32(key), F.lit(size)).cast("int")) if size > 1 else maps[0], key)


def legal_forms(tokens: Column) -> Column:
    forms = F.filter(tokens, lambda t: t.isin(LEGAL_FORM))
    return F.array_sort(F.array_distinct(lookup(forms, LEGAL_CANON)))


def core_tokens(tokens: Column) -> Column:
    core = F.filter(tokens, lambda t: ~t.isin(LEGAL))
    return F.when(F.size(core) > 0, core).otherwise(tokens)


def name_words(raw: Column) -> Column:
    """Folded words of a business name: links keep their host label, dotted acronyms close up."""
    s = fold(raw)
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    s = F.regexp_replace(s, URL, " $4 ")
    s = F.replace(F.translate(s, "#-/", "   "), F.lit("'"), F.lit(""))
    s = F.regexp_replace(s, r"\b([a-z])\.(?=[a-z]\.)", "$1")
    return words(F.regexp_replace(s, "[^a-z0-9 ]+", " "))


def address_words(raw: Column, canon: dict[str, str] = ADDR_CANON) -> Column:
    """Canonical address tokens; numbers lose leading zeros, dropped words vanish."""
    raw = F.when(raw == "<NULL>", F.lit("")).otherwise(F.coalesce(raw, F.lit("")))
    s = F.translate(F.regexp_replace(raw, r"\b[nN]\s?[°º]", " "), "°º#", "   ")
    s = F.replace(F.replace(fold(s), F.lit("<null>"), F.lit(" ")), F.lit("n/a"), F.lit(" "))
    s = F.regexp_replace(F.translate(s, "'’", "  "), r"(\d)(st|nd|rd|th|eme|er|e)\b", "$1")
    found = words(F.regexp_replace(F.translate(s, "-/", "  "), "[^a-z0-9 ]+", " "))
    table = F.create_map(*[F.lit(x) for kv in canon.items() for x in kv])
    plain = F.transform(found, lambda t: F.when(is_number(t), number(t)).otherwise(F.coalesce(F.try_element_at(table, t), t)))
    return F.filter(plain, lambda t: t != "")


def is_number(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def number(t: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))


def landmark(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.isin(LANDMARK)).cast("int")


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, is_number)


def beyond_latin(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"[^\x{0}-\x{24F}]"), F.lit(False)).cast("int")


def normalise(df):
    """Adds ``nm, core, legal, addr, nums, lm, indic`` to ``id, country, raw_name, raw_addr`` records."""
    df = df.withColumns({"_n": name_words(F.col("raw_name")), "_a": address_words(F.col("raw_addr"))})
    return df.withColumns({
        "nm": joined(F.col("_n")), "core": joined(core_tokens(F.col("_n"))), "legal": joined(legal_forms(F.col("_n"))),
        "addr": joined(F.col("_a")), "nums": joined(numbers(F.col("_a"))), "lm": landmark(F.col("_a")),
        "indic": beyond_latin(F.col("raw_name"))}).drop("_n", "_a")
