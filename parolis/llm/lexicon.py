"""Speaker labels, hesitations, stamps and sound annotations of call transcripts, and their automaton."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import ahocorasick

from parolis.functions.text import DISFLUENCIES

#: Hesitations that are also words of a sentence: they never make a piece non-empty, but stay in the clean text.
WORDS_TOO = frozenset({"be", "bien", "he", "he bien", "la", "ha", "hop", "of", "ok", "okay", "tac", "toc"})

#: Heads of sounds that transcribers write in brackets or between asterisks; further words may follow
#: ("[bruit de moteur]"). Whole phrases of other words are known by the shape of their brackets, see ``is_sound``.
SOUNDS = (
    "bruit", "bruits", "bruit de fond", "pleurs", "pleure", "cris", "crie", "rire", "rires", "rit", "toux", "tousse",
    "respiration", "souffle", "soupir", "silence", "sirene", "sirenes", "klaxon", "sonnerie", "bip", "musique",
    "musique d'attente", "chien qui aboie", "aboiements", "inaudible", "inintelligible", "incomprehensible",
    "parasites", "larsen", "gresillements", "applaudissements", "brouhaha", "und", "blanc", "coupure", "reniflement",
)

#: Transcription-time stamps with digits written as 0; ``-->`` may follow after blanks.
STAMPS = (
    "00:00:00", "00:00:00,000", "00:00:00.00", "00:00:00.000", "00:00:00,00", "00:00", "0:00:00",
    "0'00\"", "00'00\"", "000'00\"",
)

_ROLES = {
    "operateur": ("operateur", "operatrice", "op-sdis", "op_sdis", "op sdis", "op.", "op"),
    "requerant": ("requerant", "requerante", "req.", "req", "appelant", "appelante"),
    "intervenant": ("intervenant", "intervenante", "interv.", "interv"),
    "inconnu": ("inconnu", "inconnue", "unknown"),
}
_NUMBERED = ("", "0", " 0", "_0", "-0", "00", " 00", "_00")

#: Two of these in a piece make it German, where "und" is a word and no hesitation.
UND_IS_A_WORD = frozenset("der die das ist ein eine nicht".split())

#: Words before a label that make it part of a sentence ("dit l'operateur : ...").
DETERMINERS = frozenset("le la les l un une des du de d au aux cet cette ce mon ma son sa notre votre leur quel chaque".split())


#: Most words of a sound annotation.
SOUND_WORDS = 6
_NAMES = re.compile(r"[a-z]+(?:['-][a-z]+)*")


def is_sound(inside: str, left: str, alone: bool) -> bool:
    """Whether folded text between brackets describes a sound rather than what was said.

    Square, curly and angle brackets, asterisks and underscores are never spoken: a short phrase of words in them is an
    annotation. Round brackets may hold a remark, so they need a listed sound as their first word or to stand alone
    between sentences."""
    words = inside.replace(",", " ").split()
    if not 1 <= len(words) <= SOUND_WORDS or not all(_NAMES.fullmatch(w) for w in words):
        return False
    if words[0] in ("at", "arobase", "arobas", "a") and len(words) == 1:
        return False  # a spelt-out sign of an address
    return left != "(" or words[0] in SOUND_HEADS or (alone and len(words) > 1)


SOUND_HEADS = frozenset(s.split()[0] for s in SOUNDS)


class _Folding(dict):
    """Characters to lower case without accent, digits to 0, blanks but line ends to a space; one character for one."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in "\n\r":
            out = "\n"
        elif c.isspace() or unicodedata.category(c) in ("Zs", "Cf"):
            out = " "
        elif c.isdigit():
            out = "0"
        else:
            base = unicodedata.normalize("NFD", c)[0].lower()
            out = base if len(base) == 1 else c
        out = {"’": "'", "‘": "'", "ʼ": "'", "«": '"', "»": '"', "″": '"', "”": '"', "“": '"'}.get(out, out)
        self[code] = out
        return out


_FOLD = _Folding()
_BLANKS = re.compile(r"[^\S\n]+")


def compose(text: str) -> str:
    """NFC, line ends as ``\\n``, other blanks as single spaces."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    return _BLANKS.sub(" ", text)


def fold(text: str) -> str:
    """Folded copy of composed text, character for character."""
    return text.translate(_FOLD)


def _stretched(word: str) -> set[str]:
    """A hesitation with one of its letters drawn out ("euuuh")."""
    return {word[:i] + c * n + word[i + 1 :] for i, c in enumerate(word) for n in range(2, 7)}


def fillers() -> dict[str, bool]:
    """Hesitation -> whether it may be cut out of a sentence."""
    out = {w: w not in WORDS_TOO for w in DISFLUENCIES}
    for w in ("euh", "heu", "heueu", "hm", "hum", "mh", "bah", "ben", "ah", "oh", "hein", "ouf", "pf", "mouais", "ouais"):
        out |= {x: True for x in _stretched(w) if x not in out}
    return out | {"mh": True, "mmh": True}


def parse_label(label: str) -> str | None:
    """``operateur``, ``requerantN``, ``intervenantN`` or ``inconnu`` of a written label; None if it is no label."""
    x = fold(compose(label)).strip()
    digits = re.search(r"(\d+)\D*$", compose(label).strip())
    stem = re.sub(r"[\s_-]*0+$", "", x)
    if not stem:
        return f"requerant{int(digits.group(1))}" if digits and x.strip("0") == "" and x else None
    for role, forms in _ROLES.items():
        if stem in forms or stem.rstrip(".") in forms:
            return role if role in ("operateur", "inconnu") else f"{role}{int(digits.group(1)) if digits else 1}"
    return None


@functools.lru_cache(maxsize=4096)
def speaker_of(column: str | None) -> str:
    """The speaker column's value; nothing usable is ``inconnu``."""
    return (parse_label(column) if column is not None else None) or "inconnu"


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All labels, hesitations, stamps and sounds; values are (kind, length, detail)."""
    a = ahocorasick.Automaton()

    def add(pattern: str, kind: str, detail=None) -> None:
        if pattern not in a:
            a.add_word(pattern, (kind, len(pattern), detail))

    for forms in _ROLES.values():
        for f, n in itertools.product(forms, _NUMBERED):
            add(f + n, "label")
    for s in SOUNDS:
        for left, right in ("[]", "()", "<>", "{}", "**"):
            for pad in ("", " "):
                add(left + pad + s + pad + right, "sound")
    for s in STAMPS:
        for left, right in ("[]", "()", "<>"):
            add(left + s + right, "stamp")
        add(s + " -->", "stamp")
        add(s + "-->", "stamp")
        add(s, "bare")
    for left, right in ("[]", "()", "<>", "{}", "**"):
        add(left, "open", right)
    for f, removable in fillers().items():
        add(f, "filler", removable)
    a.make_automaton()
    return a
