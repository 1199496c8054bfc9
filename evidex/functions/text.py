"""Text expressions: cleaning, tokens, trigrams. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any language make a token.
TOKEN = r"[\p{L}\p{N}]+"

# --- fixed values: named character references this library decodes ------------------------------
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "deg": "°",
    "reg": "®", "copy": "©", "trade": "™", "mdash": "—", "ndash": "–", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·",
    "times": "×", "frac12": "½", "frac14": "¼", "frac34": "¾", "eacute": "é", "egrave": "è",
    "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß",
    "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "ecirc": "ê",
}
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def tokens(col: Column) -> Column:
    """Lower-cased tokens in reading order."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), 0)


def _decoded(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])
    code = F.when(F.lower(F.substring(name, 2, 1)) == "x",
                  F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8))
    code = code.try_cast("int")
    char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(F.substring(name, 1, 1) == "#", char).otherwise(F.try_element_at(table, name)),
                      F.concat(F.lit("&"), name, F.lit(";")))


def unescape(col: Column) -> Column:
    """Decode character references exactly once, in one pass over the text.

    Named references outside ``NAMED_ENTITIES`` are left as they are written.
    """
    plain = F.split(col, _ENTITY, -1)
    names = F.regexp_extract_all(col, F.lit(_ENTITY), 1)
    joined = F.array_join(
        F.zip_with(plain, names, lambda text, name: F.concat(text, F.coalesce(_decoded(name), F.lit("")))), "")
    return F.when(F.contains(col, F.lit("&")), joined).otherwise(col)


def clean_text(col: Column) -> Column:
    """Drop markup, decode references, turn every run of white space into one blank."""
    without_tags = F.regexp_replace(col, r"<[^>]*>", " ")
    spaced = F.translate(unescape(without_tags), " ", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def trigrams(col: Column) -> Column:
    """Distinct three-letter slices of every word padded as ``"  w "``."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(tokens(col), of_word)))


def gram_similarity(left: Column, right: Column) -> Column:
    """Shared over united trigrams of two gram arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return gram_similarity(trigrams(a), trigrams(b))


def array_text(col: Column) -> Column:
    """An array of words as one indexable text."""
    return F.array_join(col, " ")


#: A consonant, a vowel, and the place where an ending was cut off; a ``y`` that is a vowel is written ``Y``.
_C, _V, _CUT = "[^aeiouY]", "[aeiouY]", "\u0001"
#: Step 1 of Porter (1980) as replacements, one after the other (fixed values).
PORTER_STEP_1 = (
    (r"sses$", "ss"), (r"ies$", "i"), (r"([^s])s$", "$1"),                      # 1a
    (r"([^aeiou])y", "$1Y"),
    (rf"({_V}{_C}.*)eed$", "$1ee"),                                              # 1b, measure above 0
    (rf"^(.*{_V}.*[^e]|.*[aiouY])ed$", "$1" + _CUT), (rf"^(.*{_V}.*)ing$", "$1" + _CUT),
    (rf"(at|bl|iz){_CUT}$", "$1e"), (rf"([^aeiouYlsz])\1{_CUT}$", "$1"),
    (rf"^({_C}+{_V}[^aeiouYwxy]){_CUT}$", "$1e"), (rf"{_CUT}$", ""),             # measure 1, ending *o
    (rf"^(.*{_V}.*)[yY]$", "$1i"), ("Y", "y"),                                   # 1c
)


def stemmed(token: Column) -> Column:
    """A lower-case token without plural, ``-ed`` and ``-ing``, a final ``y`` as ``i``: step 1 of Porter (1980). Up to two letters stay.

    Only tokens with one of these endings are rewritten, by patterns in a row, so the token is written twice however many there are.
    """
    out = token
    for pattern, text in PORTER_STEP_1:
        out = F.regexp_replace(out, pattern, text)
    ends = F.substring(token, -1, 1).isin("s", "d", "g", "y")
    return F.when((F.length(token) > 2) & ends, out).otherwise(token)
