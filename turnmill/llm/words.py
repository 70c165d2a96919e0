"""Words of a text and their hashes."""

from __future__ import annotations

import hashlib
import re

# Markup that is no word, and the words. Tags that are long or wrapped must have the form of one: only attributes, some with a value; so prose between a < and a > is kept.
_ATTRIBUTE = r"""\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'<>]+))?"""
_TAG = rf"</?[A-Za-z][^<>\n]{{0,200}}>|</?[A-Za-z][\w:.-]*(?:(?=[^<>]*=)(?:{_ATTRIBUTE})+)?\s*/?>"
_ENTITY = r"&(?:[A-Za-z]{2,8}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,6});"
_LINK = r"""(?<=\])\((?:[^\s()]|\([^\s()]*\))+(?:\s+(?:"[^"\n]*"|'[^'\n]*'))?\s*\)"""
MARKUP = re.compile(rf"<!--.*?-->|{_TAG}|{_ENTITY}|{_LINK}", re.S)
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without tags, entities and the targets of markdown links. Null and empty texts have none."""
    if not text:
        return []
    if "<" in text or "&" in text or "](" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.lower())


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
