"""Column functions on text: normal forms, tokens, sentences, language by function words."""

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks or ligatures and what they fold to, for full-text search.
FOLD = {"àáâãäå": "a", "çćč": "c", "èéêë": "e", "ìíîï": "i", "ñń": "n", "òóôõö": "o", "ùúûü": "u", "ýÿ": "y", "š": "s", "ž": "z"}
LIGATURES = {"œ": "oe", "æ": "ae", "ß": "ss", "ﬁ": "fi", "ﬂ": "fl"}

# Common function words that search leaves out (English and French).
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his if in into is it its no not of on or our she so such that the their then "
    "there these they this to was we were which will with you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses "
    "son sont sur un une vous"
).split()

# Frequent function words of six languages, for language detection.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with was on are as be this by at from not".split(),
    "fr": "le la les des et du une est que qui dans pour pas sur au avec par plus ce il".split(),
    "es": "el los las y del que una por con para se su al lo como es en no sus la".split(),
    "de": "der die das und den von zu mit sich ist nicht ein eine auf dem des als auch es für".split(),
    "it": "il di che e la per un una non sono con del della le dei si da al nel gli".split(),
    "pt": "o de que e do da em um para com não uma os no se na por mais as dos".split(),
}


def strip_nul(c: Column | str) -> Column:
    """The text without NUL characters."""
    return F.translate(c, "\u0000", "")


def normalize(c: Column | str) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """Lower case with marks dropped and ligatures spelled out."""
    out = F.lower(c)
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.translate(out, "".join(FOLD), "".join(v * len(k) for k, v in FOLD.items()))


def words(c: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms(c: Column | str) -> Column:
    """Words of the folded text without stop words."""
    return F.filter(words(c), lambda w: ~w.isin(*STOP_WORDS))


_WORD = regex.compile(r"[\p{L}\p{N}]+")
_FOLD = str.maketrans({c: v for k, v in FOLD.items() for c in k} | LIGATURES)
_STOP = frozenset(STOP_WORDS)


def surface(text: str) -> tuple[list[str], int]:
    """What `terms` gives, for use within a task, and their number."""
    out = [w for w in _WORD.findall(text.lower().translate(_FOLD)) if w not in _STOP]
    return out, len(out)


def count_tokens(c: Column | str) -> Column:
    """Words and marks: the default token counter."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))


def sentences(c: Column | str) -> Column:
    """Sentences: cut after . ! ? and white space where a capital or digit follows."""
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9À-Ü])")


def hard_cut(c: Column | str, most: int) -> Column:
    """Pieces of at most so many white-space-separated words."""
    ws = F.split(F.trim(c), r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(ws) - 1) / F.lit(most)).cast("int")))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i * most + 1, F.lit(most)), " "))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def detect_language(c: Column | str, first_words: int = 400, least: float = 0.05) -> Column:
    """The language whose function words stand most often among the first words; empty on a tie or too few."""
    words_ = F.slice(F.regexp_extract_all(F.lower(F.substring(c, 1, 12_800)), F.lit(r"[\p{L}]+"), F.lit(0)), 1, first_words)

    def best(ws: Column, hits: Column, top: Column) -> Column:
        first = F.filter(hits, lambda h: h["n"] == top)
        enough = (top > 0) & (F.size(first) == 1) & (top >= least * F.size(ws))
        return F.when(enough, F.get(first, F.lit(0))["lang"]).otherwise("")

    most = lambda hits: F.array_max(F.transform(hits, lambda h: h["n"]))
    counted = lambda ws: F.array(*[_hits(ws, lang) for lang in LANGUAGE_WORDS])
    found = _let(words_, lambda ws: _let(counted(ws), lambda hits: _let(most(hits), lambda top: best(ws, hits, top))))
    return F.coalesce(found, F.lit(""))


def _hits(ws: Column, lang: str) -> Column:
    return F.struct(F.size(F.filter(ws, lambda w: w.isin(*LANGUAGE_WORDS[lang]))).alias("n"), F.lit(lang).alias("lang"))


def like_escape(c: Column | str) -> Column:
    """The text with the wildcards of LIKE escaped by a backslash."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")
