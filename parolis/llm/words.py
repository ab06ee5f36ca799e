"""Words of a text: runs of letters and digits, lower-cased, without accents."""

from __future__ import annotations

import re
import unicodedata


class _Folding(dict):
    """Characters to their NFKD form without combining marks, lower-cased; ligature oe spelled out."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code))
        c = "".join(x for x in c if not unicodedata.combining(x)).lower()
        c = unicodedata.normalize("NFKD", c)  # lower-casing may compose again
        out = "".join(x for x in c if not unicodedata.combining(x)).replace("œ", "oe")
        self[code] = out
        return out


_FOLD = _Folding()
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The text's words in order; null has none."""
    return _WORDS.findall(text.translate(_FOLD)) if text else []
