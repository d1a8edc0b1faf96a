"""Text normalisation as Column builders, with Arrow UDFs where Unicode tables are needed (NFC, case folding)."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that stand in for the modifier letter, and the letter itself.
APOSTROPHES = "'‘’‛ʼʽ`´′"
TURNED, TUTUQ = "ʻ", "ʼ"
# Cyrillic letters and the Latin ones they look like, in this order.
CYRILLIC = "аАеЕоОрРсСуУхХкКвВмМнНтТ"
LATIN = "aAeEoOpPcCyYxXkKBBmMHHTT"
#: White space as Python's str.strip, split and \s see it, for a Java class.
SPACE = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters, one after the other.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


#: Letters of Latin and Cyrillic and punctuation that NFC leaves alone, as long as no combining mark is among them.
COMPOSED = r"\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{4FF}\x{2010}-\x{2027}"


def text_udf(fn, kind: str = "string"):
    """An Arrow UDF from a function of one str; null stays null."""
    types = {"string": pa.string(), "boolean": pa.bool_()}

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fn(x) for x in column.to_pylist()], types[kind])

    return F.arrow_udf(run, kind)


def once(value: Column, fn) -> Column:
    """fn of a value that is worked out once a row. A Column read at several places is written out at each, and inside of functions
    of arrays nothing finds the copies."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def nfc(c: Column) -> Column:
    """NFC. Texts of characters that never change in it stay in the JVM; only the others go to Python."""
    odd = F.when(c.rlike(f"[^{COMPOSED}]"), c)
    return F.when(odd.isNull(), c).otherwise(text_udf(lambda x: unicodedata.normalize("NFC", x))(odd))


def casefold(c: Column) -> Column:
    return text_udf(str.casefold)(c)


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, TURNED * len(APOSTROPHES))


def normalize(c: Column, fold_homoglyphs: bool = False) -> Column:
    """NFC, apostrophes to U+02BB, on request look-alike letters to Latin. Null becomes empty."""
    out = fold_apostrophes(nfc(F.coalesce(c, F.lit(""))))
    return F.translate(out, CYRILLIC, LATIN) if fold_homoglyphs else out


def to_display(c: Column) -> Column:
    """Of a normalised text: U+02BB stays after o and g, and is U+02BC elsewhere."""
    return F.regexp_replace(c, f"(?<![oOgG]){TURNED}", TUTUQ)


def normalize_display(c: Column, fold_homoglyphs: bool = False) -> Column:
    return to_display(normalize(c, fold_homoglyphs))


def py_strip(c: Column, more: str = "") -> Column:
    """str.strip(); with `more`, of exactly those characters (as a Java class body)."""
    return F.regexp_replace(c, f"^[{more}]+|[{more}]+\\z", "") if more else F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def match_key(c: Column) -> Column:
    """Normalised, case-folded, white space collapsed: the form in which answers are compared."""
    return squeeze(casefold(normalize(c)))


def match_key_lower(c: Column) -> Column:
    """match_key with lower() for case folding and no NFC: all in the JVM; equal for composed text without letters such as sharp s."""
    plain = F.translate(F.coalesce(c, F.lit("")), APOSTROPHES + SPACES, TURNED * len(APOSTROPHES) + " " * len(SPACES))
    return F.btrim(F.regexp_replace(F.lower(plain), " {2,}", " "))


def strip_apostrophes(c: Column) -> Column:
    return F.replace(normalize(c), F.lit(TURNED), F.lit(""))


def words_of(c: Column) -> Column:
    """Words of a normalised text."""
    return F.regexp_extract_all(c, F.lit(f"(?U)[\\w{TURNED}]+"), F.lit(0))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"(?U)[\\w{TURNED}]+")).cast("bigint")


def has_cyrillic(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[Ѐ-ӿ]")


def cyrillic_ratio(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    cyrillic = F.regexp_count(text, F.lit(r"[Ѐ-ӿ&&\p{L}]"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(cyrillic / letters)


def slug(c: Column) -> Column:
    """A name for folders: other characters than letters, digits, dot, underscore and dash become dashes."""
    out = F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-")
    out = F.lower(F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", ""))
    return F.when(F.length(out) > 0, out).otherwise("run")


def slug_of(name: str) -> str:
    """slug() of one name, on the driver."""
    return re.sub("-+", "-", re.sub("[^A-Za-z0-9._-]+", "-", name)).strip("-").lower() or "run"


# Characters that HTML gives a meaning to, the ampersand first.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


def html_escape(c: Column) -> Column:
    """A text as it stands between tags or in an attribute; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for plain, entity in ENTITIES.items():
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def lines_of(c: Column) -> Column:
    """str.splitlines()."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.length(F.element_at(parts, -1)) == 0, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def last_line(c: Column) -> Column:
    """The last line of a stripped text; for such a text it is the last that isn't blank."""
    for end in LINE_ENDS:
        c = F.substring_index(c, end, -1)
    return c


def quoted_terms(c: Column) -> Column:
    """Quoted spans in order of appearance; spans that begin with a backslash don't count."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[\"«“„][^\"»”“„\\n]{1,80}[\"»”]|'[^'\\n]{2,80}'"), F.lit(0))
    inner = F.transform(found, lambda x: py_strip(F.substring(x, F.lit(2), F.length(x) - 2)))
    return F.filter(inner, lambda x: (F.length(x) > 0) & (F.length(x) < 80) & ~x.startswith("\\"))


# ---- repair of stored texts ------------------------------------------------------------------------------------------

PRIME = f"(?<!\\p{{L}})([A-Za-z]){TURNED}(\\s*\\()"
QUOTE = f"(?<!\\p{{L}}){TURNED}(\\S[^{TURNED}\\n]{{0,78}}\\S|\\S){TURNED}(?!\\p{{L}})"
LOST_TUTUQ = f"(?<=\\p{{L}})(?<![oOgG]){TURNED}"


def repair(c: Column) -> Column:
    """struct<text, prime, quote, tutuq>: derivative primes, then quotation marks, then misplaced turned commas."""
    one = F.regexp_replace(c, PRIME, "$1^{\\\\prime}$2")
    two = F.regexp_replace(one, QUOTE, "«$1»")
    three = F.regexp_replace(two, LOST_TUTUQ, TUTUQ)
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("bigint")
    return F.struct(three.alias("text"), count(c, PRIME).alias("prime"), count(one, QUOTE).alias("quote"), count(two, LOST_TUTUQ).alias("tutuq"))


def repair_foreign(c: Column) -> Column:
    """Foreign text never has U+02BB: each one is an ASCII apostrophe."""
    return F.struct(F.replace(c, F.lit(TURNED), F.lit("'")).alias("text"), F.regexp_count(c, F.lit(TURNED)).cast("bigint").alias("n"))


def canonicalise(c: Column) -> Column:
    """struct<text, changed>: the display form, and at how many places it differs (1 at least if it differs)."""

    def differ(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None else 0 if x == y else sum(p != q for p, q in zip(x, y)) or 1 for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    out = normalize_display(c)
    return F.struct(out.alias("text"), F.arrow_udf(differ, "bigint")(c, out).alias("changed"))
