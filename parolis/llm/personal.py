"""Personal values in free text: candidate spans, their features, and the choice among them.

Generators with high recall propose spans that may overlap: every run of capitalised words and every phrase that
introduces a person may be a name, every house number before a noun and a further word an address. No generator needs a
listed value; membership in a list is one feature among many. Boosted trees (:mod:`parolis.llm.boosting`) score them from
features of format and context; of overlapping spans above the calibrated threshold of their kind the best stands.
Spans are positions in the NFC form of the text.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")

#: Frequent given names. A name with one needs no capitals to be proposed; else the list is a feature only.
GIVEN = frozenset(
    """adam adele adrien agathe agnes aicha alain albert alice amelie amina anais andre anne antoine arthur aurelie
    aurore axel baptiste bastien benjamin benoit bernard brigitte bruno camille carole caroline catherine cecile
    celine chantal charles charlotte chloe christian christine christophe claire claude clemence clement
    corentin cyril daniel david denis diane didier dimitri dominique dylan eddy elena elise elodie emilie emma
    emmanuel enzo eric ethan etienne eva fabien fabrice farid fatima fatou felix florence florian francis franck
    francois francoise frederic gabriel gaelle gaetan georges gerard gilles guillaume hamza helene henri herve
    hugo ibrahim ines isabelle jacques jade jean jeanne jerome joel jose josiane julie julien justine karim
    kevin khadija laetitia laura laurent lea leila leo leon lina lisa lola louis louise lucas lucie ludovic
    madeleine maelle malik manon marc margaux maria marie marine martine mathieu mathilde mathis maurice maxime
    mehdi melanie michel mohamed monique moussa myriam nadia nathalie nicolas nicole nina noah noe noemie odile
    olivier oscar pascal patricia patrick paul pauline philippe pierre quentin rachid raphael remi renaud rene
    robert robin romain rose sabrina salome samir samuel sandrine sarah sebastien serge simon simone sofia
    sofiane solene sonia sophie stephane sylvain sylvie tarik theo therese thierry thomas timothee tom tristan
    valerie vanessa veronique victor vincent virginie william xavier yacine yanis yann yasmine yves yvonne zoe
    zohra""".split()
)

TITLES = frozenset("m mr mme mlle monsieur madame mademoiselle docteur dr professeur pr maitre mrs ms miss herr frau senor senora don dona".split())

#: Frequent kinds of streets; others are proposed after a house number only.
STREETS = frozenset(
    """rue r avenue av ave boulevard bd boul bld chemin ch che impasse imp place pl route rte allee allees all quai
    lotissement passage cours square sq faubourg fg sentier residence res hameau ruelle venelle esplanade promenade
    rocade parvis""".split()
)
_ABBREVIATED = frozenset("r av ave bd boul bld ch che imp pl rte all sq fg res".split())

#: Articles, pronouns, prepositions, conjunctions, auxiliaries and adverbs of the languages of the corpus.
COMMON = frozenset(
    """a ai alors am an and apres are as at attend au auf aujourd aus aussi autre aux avait avant avec avez bas bei bien but by car
    ce cela celle ces cote cet cette chaque chez combien comme con contre dans das de dehors dein deja del dem demande den depuis der derriere des
    deux devant die dieser dit doch doit donc dont du due durch ein eine einem einen einer el elle elles en encore entre er es est
    esta et etait ete etre eux fait font for from fur hat here hier his ich ici ihr il ils im in is ist it je jusqu kein la
    las le les leur leurs lo loin los lui ma mais me mein meine meinen merci mes mi mit moi moins mon my nach ne nicht ni no nom non nos notre nous
    numero nur of oder on ont or ou oui our out par para parce pas pendant peu peut plus por pour pres puis quand que quel quelle qui quoi
    rappelez reste rien sa sans sauf se sein sera ses she si sie sin sind sinon so soir son sont sous su suis sur tel tell that the
    their then they this to toi ton toujours tous tout toute toutes tres trop trois tu two un una und une uns unser unter va vais vers veut via vient
    voici voila vom von vor vos votre vous wann war warum was we wer wie wir with wo y you your zu zum zur zwei zwischen""".split()
)
_DETERMINERS = frozenset("le la les l un une des du cette ce ces mon ma ton sa son notre votre der die das den dem ein eine einen the an el los las una unos mein meine".split())
_GERMAN = frozenset("der die das ein eine einen dem den und ist hat wird im am bei nach mit auf von zur zum neben hinter nicht ich wir sie mein meine etwa sind uns sehr noch kein kommt ins alles dort bis etwas weiter hier jetzt wieder gegen schon aus durch vor unter man aber".split())
_UNITS = frozenset(
    """metre metres meter meters km kilometre kilometres kilometer minute minutes minuten heure heures hour hours stunden an ans mois jour jours
    semaine semaines kilo kilos kg litre litres euro euros degre degres personne personnes fois pour bar h m cm mm""".split()
)

_PARTICLES = r"(?:(?:de[ ]+la|de|du|des|le|la|da|di|do|dos|van|von|el|ben)[ ]+|d')"
_WORD = r"[a-z]{3,}"
_SURNAME = rf"(?P<sur>{_WORD}(?:-{_WORD})?)"

_NUMBERS = {
    w: n
    for n, w in enumerate(
        "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split()
    )
} | {"une": 1, "vingt": 20, "vingts": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "septante": 70, "huitante": 80, "octante": 80, "nonante": 90, "cent": 100, "cents": 100}
_NW = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<![a-z'-]){_NW}(?:(?:-et-|-|\s+et\s+|\s+){_NW})*(?![a-z'-])")

# gaps inside a number: blanks, light punctuation, or one linking word of hesitant speech
_GAP = r"(?:[ \t.,\-…/()]{0,14}|[ \t.,…]{1,8}(?:alors|donc|puis|enfin|voila|then|dann|luego)[ \t.,…]{1,8})"
_PHONE = re.compile(rf"(?:(?:\+|00)[ ]?33{_GAP}(?:\(0\){_GAP})?[1-9]|0[1-9])(?:{_GAP}\d){{8}}(?!\d)")
_PHONE_START = re.compile(r"(?<![\d+])(?:\+|0)\d?")
_S = r"[ .\-]{0,9}"
_SOCIAL = re.compile(rf"(?<![\d+.,])[12]{_S}\d\d{_S}\d\d{_S}(?:\d\d|2[ab]){_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d\d)?(?!\d)")
_CARD = re.compile(r"(?<![\w+])(?:\d{12}|\d{4} \d{4} \d{4}|\d{6} \d{6})(?!\w)")
_PASSPORT = re.compile(r"(?<!\w)\d{2} ?[a-z]{2} ?\d{5}(?!\w)")
_NEW_CARD = re.compile(r"(?<!\w)(?=[a-z0-9]*\d)(?=[a-z0-9]*[a-z])[a-z0-9]{9}(?!\w)")

_AT = r"(?:@|[(\[]\s?(?:at|arobase|arobas)\s?[)\]]|(?<!\w)(?:arobase|arobas|at)(?!\w))"
_JOIN = r"(?:point|dot|tiret[ ]+(?:du[ ]+)?bas|tiret|underscore|plus|moins|punkt|punto)"
_LOCAL = re.compile(rf"(?:^|(?<=[^\w.+-]))(?:[a-z0-9][\w.+-]*[ ]+{_JOIN}[ ]+){{0,5}}[a-z0-9][\w.+-]*[ ]*$")
_DOMAIN = re.compile(r"[ ]*[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+|[ ]+(?:point|dot|punkt|punto)[ ]+[a-z0-9-]+)*")
_AT_RE = re.compile(_AT)

_HOUSE = re.compile(rf"(?:\d{{1,4}}|{_NW}(?:(?:-et-|-|\s+et\s+|\s+){_NW})*)(?:\s*(?:bis|ter|quater)\b|\s?[a-d]\b)?\s*,?\s*$")
_CONNECTORS = frozenset("des du de la le les l d".split())
_STREET_STEP = re.compile(r"(?:[ ]+|(?<=[a-z])'[ ]?)([a-z0-9]+(?:-[a-z]+)*)")
_NUMERO = re.compile(r"\s*,?\s*(?:numero|no|n°)\s+(?:\d{1,4}(?:\s*(?:bis|ter|quater)\b|\s?[a-d]\b)?|" + _NW + r"(?:-" + _NW + r")*)")
_TOWN = re.compile(r"\s*,?\s*\d{5}\s+[a-z]+(?:[-' ](?:sur|sous|les|la|le|en|de|saint|sainte|l|d)[-' ][a-z]+)*(?:-[a-z]+)*")
_STREET_STOP = frozenset(
    """avec sans juste sur par pour en au aux a ai j y me ma mon sa on ne se dans chez depuis pendant avant apres entre derriere devant face est sont
    et ou mais donc puis alors vers cote qui que si c ce sous malgre jusqu contre il elle nous vous je numero no
    the at by near about und bei in an y con por""".split()
)

_FILLER = re.compile(
    r"(?:,[ \t]*)?(?<![\w'-])(?:e+u+h+|he+u+(?:e+u+)*|h+u*m+|m+h+|m{3,}|ba+h+|be+n+|hein|bof|pff+|und)(?![\w'-])[,.…]*"
)
#: Phrases after which a name stands.
_INTRODUCED = ("appelle ", "nomme ", "nommee ", "au nom de ", "name is ", "named ", "heisse ", "heisst ", "namens ", "llamo ", "llama ", "nombre de ")
_CUES = {
    "email": re.compile(r"mail|courriel|ecri|contact|envoy|schreib|write|escrib|adresse|copie|chez|pour"),
    "phone": re.compile(r"\btel|appel|numero|joignable|contact|call|phone|nummer|telefon|sinon|gardez|le\s*$|au\s*$"),
    "id_number": re.compile(r"secu|identi|carte|passeport|passport|assure|vitale|ausweis|document|dossier|numero|matricule"),
    "address": re.compile(r"habit|adresse|envoy|c'est au|depart|jusqu|wohne|vivo|live|address|\bat\s*$|\bau\s*$|\bdu\s*$"),
    "name": re.compile(r"appel|\bnom\b|preven|c'est|\bdit\b|avec|name|heiss|llam|tell|ask|frag|pregunt|nomme|signe|demand"),
}


class _Plain(dict):
    """Characters to lower case without accent, digits plain, blanks but line ends to a space; one for one."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in "\n\r":
            out = "\n"
        elif c.isspace() or unicodedata.category(c) in ("Zs", "Cf"):
            out = " "
        elif c.isdigit():
            out = str(unicodedata.digit(c))
        else:
            base = unicodedata.normalize("NFD", c)[0].lower()
            out = {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d"}.get(base, base) if len(base) == 1 else c
        self[code] = {"’": "'", "‘": "'", "‐": "-", "‑": "-", "–": "-"}.get(out, out)
        return self[code]


_PLAIN = _Plain()


@functools.lru_cache(maxsize=1)
def _triggers() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for words, kind in ((GIVEN, "given"), (TITLES, "title"), (STREETS, "street"), (("zero",), "zero"), (("arobas", "@", "(at", "[at", " at "), "at"), (_INTRODUCED, "cue")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    for w in ("euh", "heu", "hm", "hum", "mh", "bah", "ben", "hein", "mmm", "euu", "bof", "pff", "und"):
        if w not in a:
            a.add_word(w, ("filler", len(w)))
    a.make_automaton()
    return a


@dataclass(slots=True)
class Candidate:
    start: int
    end: int
    kind: int
    features: tuple


@dataclass(slots=True)
class Prepared:
    """NFC text, its folded copy with hesitations blanked, and whether it has capitals at all."""

    text: str
    quiet: str
    cased: bool


def prepare(text: str) -> tuple[Prepared, list]:
    text = unicodedata.normalize("NFC", text)
    plain = text.translate(_PLAIN)
    found = list(_triggers().iter(plain))
    quiet = plain
    if any(v[0] == "filler" for _, v in found):
        quiet = _FILLER.sub(lambda m: " " * len(m.group()), plain)
    return Prepared(text, quiet, text != text.lower()), found


def _spelled_digits(chunk: str) -> list[tuple[int, str]]:
    """Digits of a chain of number words, by the end position of each word group."""
    out, open_zero = [], False
    groups = [(m.end(), m.group()) for m in re.finditer(r"[a-z]+(?:-[a-z]+)*", chunk)]
    i = 0
    while i < len(groups):
        end, g = groups[i]
        value, parts = 0, [_NUMBERS.get(x) for x in g.split("-") if x != "et"]
        if None in parts:
            break
        for p in parts:
            value = value * p if p in (20, 100) and 1 < value < 10 else value + p
        # "soixante dix-sept" and "quatre vingt" written apart
        if i + 1 < len(groups) and value in (60, 80) and "-" not in groups[i + 1][1]:
            nxt = _NUMBERS.get(groups[i + 1][1], 0)
            if 10 <= nxt < 20:
                value, i, end = value + nxt, i + 1, groups[i + 1][0]
        i += 1
        if value == 0:
            out.append((end, "0"))
            open_zero = True
        elif value < 10 and open_zero:
            out.append((end, str(value)))
            open_zero = False
        else:
            out.append((end, f"{value:02d}" if value < 100 else str(value)))
            open_zero = False
    return out


def candidates(p: Prepared, found: list) -> list[Candidate]:
    """Spans proposed by all generators; they overlap."""
    q, text, out = p.quiet, p.text, []
    n = len(q)

    def add(kind: str, pattern: int, a: int, z: int, **f) -> None:
        while z > a and q[z - 1] in " \t\n.,":
            z -= 1
        while a < z and q[a] in " \t\n":
            a += 1
        before, after = q[max(0, a - 42) : a], q[z : z + 24]
        own = q[a:z]
        digits = sum(c.isdigit() for c in own)
        sentence = re.split(r"[.!?\n]\s", before)[-1]
        prev = re.search(r"([a-z0-9]+)[ '.,]*$", before)
        prev = prev.group(1) if prev else ""
        sur = f.get("sur", "")
        first = text[a : a + 1]
        gaps = re.findall(r"[^a-z0-9]+", own)
        words = re.findall(r"[a-z]+", own)
        around = re.findall(r"[a-z]+", before + " " + after)
        written = text[a:z]
        out.append(
            Candidate(a, z, KINDS.index(kind), (
                pattern,
                digits,
                z - a,
                1.0 if re.search(r"[.!?]\s+\S", own) else 0.0,
                1.0 if "\n" in own else 0.0,
                max(map(len, gaps), default=0),
                len(set(gaps)),
                1.0 if _CUES[kind].search(sentence) else 0.0,
                sum(bool(_CUES[k].search(sentence)) for k in KINDS if k != kind),
                1.0 if first.isupper() else 0.0,
                1.0 if f.get("sur_upper") else 0.0,
                1.0 if p.cased else 0.0,
                1.0 if any(w in COMMON for w in sur.split("-")) else 0.0,
                len(sur),
                f.get("particle", 0),
                f.get("given", 0),
                f.get("title", 0),
                1.0 if prev in ("a", "vers", "cote", "pres", "secteur", "bei", "near", "en", "richtung", "hacia", "towards") else 0.0,
                f.get("name_words", 0),
                f.get("connector", 0),
                f.get("spelled", 0),
                f.get("one", 0),
                f.get("numero", 0),
                1.0 if before[-1:] == "'" or before[-1:] in "-_@+" and before else 0.0,
                1.0 if re.search(r"(?:\d\s?h|\bh|bar|km|lot|sn-|relais|canal|fiche)\s?$", before) else 0.0,
                1.0 if after[:1] and (after[:1].isalnum() or after[:1] in "@_") else 0.0,
                1.0 if re.match(r"\s*(?:[@(\[]|arobas)", after) else 0.0,
                f.get("follow", 0),
                f.get("domain_dots", 0),
                f.get("tail", 0),
                f.get("listed", 0),
                f.get("run", 0),
                1.0 if words and words[0] in COMMON else 0.0,
                sum(w in COMMON for w in words),
                1.0 if not re.search(r"\w", sentence) else 0.0,
                sum(w in _GERMAN for w in around) / max(3, len(around)),
                1.0 if kind == "name" and written.isupper() else 0.0,
                1.0 if re.search(r"[^\W\d_]{3}", text[max(0, a - 12) : a]) and text[max(0, a - 12) : a].isupper() else 0.0,
                1.0 if re.match(r"[ ,]+[^\W\d_]", text[z : z + 4]) and text[z : z + 4].strip(" ,")[:1].isupper() else 0.0,
                f.get("plural", 0),
                f.get("unit", 0),
                f.get("caps", 0),
                f.get("again", 0),
                1.0 if prev in COMMON else 0.0,
                1.0 if prev in _DETERMINERS else 0.0,
            ))
        )

    has_digit = any(c in q for c in "0123456789")
    if has_digit:
        for m in _PHONE_START.finditer(q):
            x = _PHONE.match(q, m.start())
            if x:
                add("phone", 0 if q[m.start()] == "0" and not q.startswith("0033", m.start()) else 1, *x.span(), follow=int(q[x.end() : x.end() + 2].strip()[:1].isdigit()))
        for rx, k in ((_SOCIAL, 2), (_CARD, 3), (_PASSPORT, 4), (_NEW_CARD, 5)):
            for x in rx.finditer(q):
                d = re.sub(r"\D", "", x.group().replace("2a", "19").replace("2b", "18"))
                valid = len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])
                add("id_number", k, *x.span(), tail=int(valid))

    for last, (kind, length) in found:
        a, z = last - length + 1, last + 1
        if kind == "at":
            x = _AT_RE.search(q, max(0, a - 1), min(n, z + 10))
            if not x:
                continue
            dom = _DOMAIN.match(q, x.end())
            lo = max(q.rfind("\n", 0, x.start()), q.rfind("@", 0, x.start())) + 1  # each sign is searched once
            loc = _LOCAL.search(q[lo : x.start()])
            if not dom or not loc:
                continue
            dots = len(re.findall(r"\.|\b(?:point|dot|punkt|punto)\b", dom.group()))
            spelled = int(q[x.start() : x.end()].strip(" ([])").startswith(("ar", "at")))
            # the whole chain, and without its leading words
            add("email", 6, lo + loc.start(), dom.end(), domain_dots=dots, spelled=spelled)
            short = re.search(r"[a-z0-9][\w.+-]*\s*$", q[lo : x.start()])
            if short and short.start() != loc.start():
                add("email", 7, lo + short.start(), dom.end(), domain_dots=dots, spelled=spelled)
            continue
        if q[a] == " ":
            continue  # part of a hesitation
        if (a and (q[a - 1].isalnum() or q[a - 1] in "_@.+")) or (z < n and (q[z].isalnum() or q[z] in "_@+")):
            if kind != "cue":
                continue
        if kind == "zero":
            chain = _SPELLED.match(q, a)
            if chain:
                total = ""
                for end, d in _spelled_digits(chain.group()):
                    total += d
                    if len(total) >= 10:
                        if len(total) == 10 and total[1] != "0":
                            add("phone", 8, a, a + end, spelled=1, name_words=len(total))
                        break
        elif kind == "street":
            word = q[a:z]
            if word in _ABBREVIATED and q[z : z + 1] not in (".", " "):
                continue
            _street(p, a, z, add, listed=1)
        elif kind in ("given", "title", "cue"):
            _names(p, a, z, kind, add)
    for m in _INITIAL.finditer(q):
        _names(p, m.start(), m.start() + 1, "initial", add)
    for m in _NUMBERED.finditer(q):
        word = m.group("kind")
        if m.group("house") not in ("un", "une", "0") and "\t" not in text[m.start() : m.end()] and word not in STREETS and word not in COMMON and word not in _NUMBERS and (m.group("house")[:1].isdigit() or not word.endswith("s")):
            _street(p, m.start("kind"), m.end("kind"), add, listed=0, plural=int(word.endswith(("s", "x"))), unit=int(word in _UNITS))
    if p.cased:
        _runs(p, add)
    # whether a wider candidate of another kind covers this one
    wide = {k: _Cover([(c.start, c.end) for c in out if KINDS[c.kind] == k]) for k in ("address", "email")}
    for c in out:
        c.features = (*c.features, float(any(KINDS[c.kind] != k and w.holds(c.start, c.end) for k, w in wide.items())))
    return out


_NUMBERED = re.compile(rf"(?<![\w'./:,-])(?P<house>\d{{1,4}}(?:[ ]?[a-d]\b)?|{_NW}(?:(?:-et-|-){_NW})*)(?:[ ]?(?:bis|ter|quater)\b)?,?[ ]+(?P<kind>[a-z]{{3,}}(?:-[a-z]{{3,}})?)(?=[ ])")


def _street(p: Prepared, a: int, z: int, add, **f) -> None:
    """Addresses around a kind of street at ``a``."""
    q, text = p.quiet, p.text
    word, stop, words, connector, caps = q[a:z], z, 0, 0, 0
    w = _STREET_STEP.match(q, z + (q[z : z + 1] == "."))
    while w:
        x, at = w.group(1), w.start(1)
        if x in _CONNECTORS:
            connector = 1
        else:
            if x in _STREET_STOP or (words and (x.isdigit() or x in COMMON)):
                break
            if words >= 3 and not (q[z:at].rstrip().endswith((" de", " du", " des", " la", " et", " d'")) or text[at].isupper()):
                break  # a long name goes on after a connector or with a capital
            if not f["listed"] and x in STREETS:
                return  # the number belongs to something else: "bus 12 waits square ..."
            words, stop, caps = words + 1, w.end(), caps + text[at].isupper()
        w = _STREET_STEP.match(q, w.end())
    if not words or not (f["listed"] or caps or q.startswith((" de ", " du ", " des ", " d'"), z)):
        return
    house = _HOUSE.search(q, max(0, a - 40), a)
    if house and q[house.start() - 1 : house.start()] == "'":  # "quelqu'un douze rue ..."
        house = _HOUSE.search(q, house.start() + 2, a) if q.startswith("un ", house.start()) else None
    numero = _NUMERO.match(q, stop)
    tail = numero.end() if numero else stop
    town = _TOWN.match(q, tail)
    end = town.end() if town else tail
    abbreviated = int(word in _ABBREVIATED)
    if house and (house.start() == 0 or not (q[house.start() - 1].isalnum() or q[house.start() - 1] in "'-./:,")):
        h = house.group().strip()
        add("address", 9, house.start(), end, name_words=words, connector=connector, spelled=int(not h[:1].isdigit()), one=int(h in ("un", "une")), numero=int(bool(numero)), follow=abbreviated, tail=int(bool(town)), caps=caps, **f)
    if numero:
        add("address", 10, a, end, name_words=words, connector=connector, numero=1, follow=abbreviated, tail=int(bool(town)), caps=caps, **f)


class _Cover:
    """Whether one of many intervals holds a given one."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans.sort()
        self.starts = [a for a, _ in spans]
        self.reach = list(itertools.accumulate((z for _, z in spans), max))

    def holds(self, a: int, z: int) -> bool:
        i = bisect.bisect_right(self.starts, a)
        return i > 0 and self.reach[i - 1] >= z


_AFTER_TITLE = re.compile(rf"\.?[ ]+(?P<part>{_PARTICLES})?{_SURNAME}")
_AFTER_CUE = re.compile(rf"[ ]*(?P<part>{_PARTICLES})?{_SURNAME}(?P<next>[ ]+[a-z]+)?")
_AFTER_GIVEN = re.compile(rf"[ ]+(?P<part>{_PARTICLES})?{_SURNAME}")
_INITIAL = re.compile(rf"(?<![\w'.@+-])(?P<i>[a-z])\.[ ]?(?P<part>{_PARTICLES})?{_SURNAME}")
_BEFORE_GIVEN = re.compile(rf"(?<![\w'.@+-])(?P<part>{_PARTICLES})?{_SURNAME}[ ]+$")
_TWO_AFTER_TITLE = re.compile(rf"\.?[ ]+(?P<one>{_WORD}(?:-{_WORD})?)[ ]+(?P<part>{_PARTICLES})?{_SURNAME}")
_TWO_AFTER_CUE = re.compile(rf"[ ]*(?P<one>{_WORD}(?:-{_WORD})?)[ ]+(?P<part>{_PARTICLES})?{_SURNAME}")
_UP = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in range(0x100, 0x250) if chr(c).isupper())
_CAPITAL = re.compile(rf"(?<![\w'’-])[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*(?![\w@])")
_RUN = re.compile(rf"(?<![\w'’.@+-]){_CAPITAL.pattern}(?:[ ]+(?:(?:de la|de|du|des|da|di|do|dos|van|von|der|den|el|ben|al|le|la)[ ]+)*{_CAPITAL.pattern})+")
_SECOND_HALF = re.compile(r"-[a-z]+")
_TITLE_BEFORE = re.compile(r"(?<![a-z])([a-z]+)\.?[ ]+$")


def _names(p: Prepared, a: int, z: int, kind: str, add) -> None:
    """Name spans around a given name, a title, an initial or a phrase that introduces a name."""
    q, text = p.quiet, p.text

    def propose(pattern: int, start: int, m: re.Match, shift: int = 0, stop: int | None = None, **f) -> None:
        s, word = m.start("sur") + shift, m.group("sur")
        if word.split("-")[0] in TITLES or word in _NUMBERS:
            return
        end = m.end("sur") + shift if stop is None else stop
        add("name", pattern, start, end, sur=word, sur_upper=text[s : s + 1].isupper(), particle=int(bool(m.group("part"))), **f)

    def whole(m: re.Match | None, second: int) -> bool:
        """Whether two further words can be a given name and a surname: capitals where the text has any."""
        return bool(m) and m.group("one") not in COMMON and m.group("sur") not in COMMON and (not p.cased or text[second : second + 1].isupper())

    if kind == "title":
        m = _AFTER_TITLE.match(q, z)
        if m and m.group("sur").split("-")[0] not in GIVEN:  # a listed given name makes its own proposal
            propose(11, a, m, title=1, follow=int(q[z : z + 1] == "."))
        m = _TWO_AFTER_TITLE.match(q, z)
        if whole(m, m.start("sur") if m else 0) and m.group("one").split("-")[0] not in GIVEN:
            propose(18, a, m, title=1, follow=int(q[z : z + 1] == "."))
    elif kind == "cue":
        m = _AFTER_CUE.match(q, z)
        if m and m.group("sur").split("-")[0] not in GIVEN and (m.group("next") or "").strip() not in GIVEN:
            propose(15, m.start("part") if m.group("part") else m.start("sur"), m)
        m = _TWO_AFTER_CUE.match(q, z)
        if whole(m, m.start("sur") if m else 0) and m.group("one").split("-")[0] not in GIVEN and m.group("sur").split("-")[0] not in GIVEN:
            propose(19, m.start("one"), m)
    elif kind == "initial":
        m = _INITIAL.match(q, a)
        if m and m.group("i") + "." != "m.":
            propose(13, a, m, follow=int(text[a : a + 1].isupper()))
    elif not (a and q[a - 1] == "-"):  # else the second half of a compound
        half = _SECOND_HALF.match(q, z)
        stop = half.end() if half else z
        t = _TITLE_BEFORE.search(q, max(0, a - 16), a)
        start = t.start(1) if t and t.group(1) in TITLES else a
        m = _AFTER_GIVEN.match(q, stop)
        after = bool(m) and m.group("sur").split("-")[0] not in COMMON and m.group("sur").split("-")[0] not in GIVEN
        if m:
            propose(12, start, m, given=1, listed=1, title=int(start < a))
        lo = max(0, a - 48)
        b = _BEFORE_GIVEN.search(q[lo:a])
        if b and b.group("sur").split("-")[0] not in GIVEN:
            shouted = text[lo + b.start("sur") : lo + b.end("sur")].isupper()
            propose(14, lo + b.start(), b, lo, stop, given=1, listed=1, follow=int(after), tail=int(shouted))


def _runs(p: Prepared, add) -> None:
    """Names as two to four capitalised words in a row, particles between them allowed."""
    text, q = p.text, p.quiet
    for m in _RUN.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end()) for w in _CAPITAL.finditer(m.group())]
        n = len(words)
        for size in (2, 3, 4) if n == 4 else (2, 3):
            for i in range(n - size + 1):
                a, z = words[i][0], words[i + size - 1][1]
                one, sur = q[a : words[i][1]], q[words[i + size - 1][0] : z]
                if one in TITLES or sur in TITLES or sur in _NUMBERS:
                    continue
                near = text[max(0, a - 40) : a] + text[z : z + 40]
                if text[a:z].isupper() and near.isupper():
                    continue  # capitals say nothing where all are
                lower = text[words[i + size - 1][0] : z].lower()
                add("name", 14 + size if size < 4 else 20, a, z, sur=sur.split("'")[-1], sur_upper=1, run=n, particle=int(z - a > sum(y - x for x, y in words[i : i + size]) + size - 1),
                    listed=int(one.split("-")[0] in GIVEN or sur.split("-")[0] in GIVEN), again=int(lower in text), tail=int(text[words[i][0] : words[i][1]].isupper()) + 2 * int(text[words[i + size - 1][0] : z].isupper()))


N_FEATURES = 46


def resolve(cands: list[Candidate], prob: np.ndarray, thresholds: np.ndarray) -> list[tuple[int, int, str]]:
    """Non-overlapping spans above their kind's threshold, best first, in order of position."""
    order = sorted(
        (i for i, c in enumerate(cands) if prob[i] >= thresholds[c.kind]),
        key=lambda i: (-round(float(prob[i]), 1), -(cands[i].end - cands[i].start), cands[i].start),
    )
    taken: list[tuple[int, int, str]] = []
    for i in order:
        c = cands[i]
        at = bisect.bisect_left(taken, (c.start, c.end, ""))
        free = (at == 0 or taken[at - 1][1] <= c.start) and (at == len(taken) or taken[at][0] >= c.end)
        if free:
            taken.insert(at, (c.start, c.end, KINDS[c.kind]))
    return taken
