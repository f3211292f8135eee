"""A light English stemmer as a Column: plurals, -ed, -ing and -ly, with doubled consonants undone.

It stands in for a full-text dictionary; both sides of a keyword search must use it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(term: Column) -> Column:
    t = F.regexp_replace(term, r"(?<=.{3})(?:ational)$", "ate")
    t = F.regexp_replace(t, r"(?<=ss|sh|ch|x|z)es$", "")
    t = F.regexp_replace(t, r"(?<=.{2})ies$", "y")
    t = F.regexp_replace(t, r"(?<=[^su])s$", "")
    t = F.regexp_replace(t, r"(?<=[aeiouy].{0,12}[^aeiou])(?:ingly|edly|ing|ed)$", "")
    t = F.regexp_replace(t, r"([bdfgmnprt])\1$", "$1")
    return F.when(F.length(t) >= 2, F.regexp_replace(t, r"(?<=.{3})(?:ly|e)$", "")).otherwise(term)


# Words that a search ignores.
SEARCH_STOP_WORDS = ["a", "about", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "has", "have", "he", "her", "his", "how", "i", "in", "is", "it", "its", "me", "my", "of", "on", "or", "she", "so", "that", "the", "their", "there", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your"]


def stem_sql(term: str) -> str:
    """The same stem as SQL without look-behind."""
    t = f"regexp_replace({term}, '^(.{{3,}})ational$', '\\1ate')"
    t = f"regexp_replace({t}, '(ss|sh|ch|x|z)es$', '\\1')"
    t = f"regexp_replace({t}, '^(.{{2,}})ies$', '\\1y')"
    t = f"regexp_replace({t}, '([^su])s$', '\\1')"
    t = f"regexp_replace({t}, '([aeiouy].{{0,12}}[^aeiou])(?:ingly|edly|ing|ed)$', '\\1')"
    t = f"regexp_replace({t}, '(?:(b)b|(d)d|(f)f|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)$', '\\1\\2\\3\\4\\5\\6\\7\\8\\9')"
    return f"CASE WHEN length({t}) >= 2 THEN regexp_replace({t}, '^(.{{3,}})(?:ly|e)$', '\\1') ELSE {term} END"
