"""Folding of texts to what does not change when they are copied or retyped."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones, and Latin letters
#: that decomposition leaves whole.
LOOK_ALIKES = str.maketrans(
    "авекмнорстухіјѕԁԛԝһѵαβεικνορτυχγӏɡıłøđ",
    "abekmhopctyxijsdqwhvabeikvoptuxylgilod",
)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SIGNS = re.compile(r"[^\w\s]|_")


def fold(text: str) -> str:
    """Lower case, entities and tags resolved, accents off, look-alikes as Latin letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.translate(LOOK_ALIKES)


def fold_words(text: str) -> str:
    """fold() with every sign that is no letter, digit or white space as a hyphen, where there are other signs than ASCII's."""
    text = fold(text)
    return text if text.isascii() else " ".join(_SIGNS.sub("-", text).split())
