"""Item text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters replaced by a space, and the characters that count
# as white space (those of Unicode plus the four information separators).
PUNCTUATION = "-=+,#/?:^.@*\"※~ㆍ!』‘|()[]`'…》”“’·"
WHITE_SPACE = (
    "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
)


def item_text(title: Column, entities: Column) -> Column:
    """Title, a space, and the entity surfaces joined by ', '; null counts as empty."""
    surfaces = F.array_join(F.transform(entities, lambda e: e["surface"]), ", ")
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(surfaces, F.lit("")))


def clean_text(text: Column) -> Column:
    """Punctuation to spaces, runs of white space to one space, ends trimmed."""
    plain = F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))
    return F.trim(F.regexp_replace(plain, WHITE_SPACE, " "))
