"""Plain text of forum posts: markup, entities, words."""

from __future__ import annotations

import html
import re

#: Tags in angle and square brackets; runs of letters and digits.
TAG = re.compile(r"</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*]+(?:=[^\]\n]*)?\]")
WORD = re.compile(r"[^\W_]+")
#: The same tag pattern for SQL engines.
TAG_SQL = r"</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*]+(=[^\]\n]*)?\]"


def without_markup(text: str) -> str:
    """Tags become blanks, character references the characters they stand for."""
    return html.unescape(TAG.sub(" ", text))


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits of the text without its markup."""
    return WORD.findall(without_markup(text).lower())
