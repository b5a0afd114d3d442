"""Terms of a text: words in lower case, and stems of English words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"

# The Porter2 stemmer's rules for inflections and a final e (its steps 1 and 5) as replacements, one after the other. A "~" marks
# a stem that has lost its ending; the repairs that follow use the mark up.
RULES = [
    (r"sses$", "ss"),
    (r"^(..+)ie[ds]$", "$1i"),
    (r"^(.)ie[ds]$", "$1ie"),
    (r"^(.*[aeiouy].*[^us])s$", "$1"),
    (r"^(.*[aeiouy][^aeiouy].*)eed$", "$1ee"),
    (r"^(.*[aeiouy].*[^e]|.*[aiouy])ed$", "$1~"),
    (r"^(.*[aeiouy].*)ing$", "$1~"),
    (r"(at|bl|iz)~$", "$1e"),
    (r"(b)b~$|(d)d~$|(f)f~$|(g)g~$|(m)m~$|(n)n~$|(p)p~$|(r)r~$|(t)t~$", "$1$2$3$4$5$6$7$8$9"),
    (r"^([^aeiouy]*[aeiouy][^aeiouywx])~$", "$1e"),
    (r"~$", ""),
    (r"^(.+[^aeiouy])y$", "$1i"),
    (
        r"^([^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*|[^aeiouy]*[aeiouy]+[^aeiouy][^aeiouy]+"
        r"|[^aeiouy]*[aeiouy]+[wx]|[^aeiouy]*[aeiouy]{2,}[^aeiouy]|[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+)e$",
        "$1",
    ),
]


def stem(word: Column) -> Column:
    """The stem of a word in lower case. Words of up to two letters, and with others than a to z, stay."""
    out = word
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.when(word.rlike("^[a-z]{3,}$"), out).otherwise(word)


def words(text: Column) -> Column:
    """All words of the text, in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
