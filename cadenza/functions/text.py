"""Text functions as columns: cleaning, sentence ends, stems, token sets, similarity, caption escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

#: All that Unicode takes for white space, and the four separators.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.btrim(text, F.lit(_SPACES))


def clean(text: Column) -> Column:
    """A word for lookup: no outer white space, quotes or closing punctuation, in lower case."""
    return F.lower(F.rtrim(F.btrim(stripped(text), F.lit("\"'“”‘’")), F.lit(",.!?;:")))


def ends_sentence(text: Column) -> Column:
    return F.right(F.rtrim(stripped(text), F.lit("\"'”’")), F.lit(1)).isin(*".!?…")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def coerce_float(text: Column) -> Column:
    """The first number in a text, or null."""
    return F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def stem(word: Column) -> Column:
    """Without the first suffix that fits and leaves three letters or more."""
    out = word
    for suffix in reversed(lexicon.SUFFIXES):
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 2), F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """The set of stems of a text's words, without stopwords and words of two letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(lexicon.STOPWORDS))
    return F.array_distinct(F.transform(kept, stem))


def trigrams(text: Column) -> Column:
    """The set of three-character windows of a text, in lower case, white space collapsed."""
    flat = F.regexp_replace(stripped(F.lower(text)), r"\s+", " ")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - 2, F.lit(1))), lambda i: F.substring(flat, i, F.lit(3)))
    return F.when(F.length(flat) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def lexical_similarity(a_tokens: Column, b_tokens: Column, a_grams: Column, b_grams: Column) -> Column:
    """0.7 of the tokens' blend of Jaccard and overlap, 0.3 of the trigrams' Jaccard."""
    return 0.7 * (0.45 * jaccard(a_tokens, b_tokens) + 0.55 * overlap(a_tokens, b_tokens)) + 0.3 * jaccard(a_grams, b_grams)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector with length 1; one without length stays."""
    return F.element_at(F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 at least; a vector without length is like nothing."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), dot(a, b) / norm)).otherwise(0.0)


def caption_escape(text: Column) -> Column:
    """Text for a subtitle event: backslashes and braces escaped, line breaks as spaces."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for bad, good in (("{", "\\{"), ("}", "\\}"), ("\n", " ")):
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def caption_time(seconds: Column) -> Column:
    """H:MM:SS.cc, from 0."""
    t = F.greatest(F.lit(0.0), seconds)
    hours, rest = F.floor(t / 3600), t - F.floor(t / 3600) * 3600
    return F.format_string("%d:%02d:%05.2f", hours, F.floor(rest / 60), rest - F.floor(rest / 60) * 60)
