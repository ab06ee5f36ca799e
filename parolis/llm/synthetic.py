"""Labelled sentences to train the redaction trees on, made here from a seed.

Values are random: given names and surnames from random syllables of several sound patterns (somewhat less than half of the
given names are frequent ones), kinds of streets from a list of which a third is in no list of the library, numbers from random
digits, in all written forms the generators know. So are the traps: counts and measures, incident, lot and equipment
numbers, streets without a house number, towns, short emergency numbers, capitalised nouns and headings.
"""

from __future__ import annotations

import random

from parolis.llm.personal import GIVEN

#: Labelled sentences the trees are fitted and calibrated on.
SENTENCES = 15_000

_UNITS = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
_TENS = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 80: "quatre-vingt"}


def spelled(n: int) -> str:
    """A number below 100 in French words."""
    if n < 20:
        return _UNITS[n]
    ten = 80 if n >= 80 else 60 if n >= 60 else n // 10 * 10
    return _TENS[ten] if n == ten else f"{_TENS[ten]}-{_UNITS[n - ten]}"


_STREET_KINDS = "rue avenue boulevard chemin impasse place route allée quai lotissement av. bd imp. ch. pl. rte r. cours passage square".split()
_RARE_KINDS = "traverse drève carriera draille voyette cavée rampe chaussée porte jetée villa cité terrasse raidillon".split()
_STREET_NAMES = (
    "des Tilleuls", "du Lavoir", "de la Fontaine", "des Deux Ponts", "du Maréchal Foch", "Émile Zola", "des Grands Pins", "de la Liberté", "du Vieux Puits",
    "Marie Curie", "des Bleuets", "du Cimetière", "de Strasbourg", "des Cordeliers", "Voltaire", "Neuve", "Haute", "Saint-Michel", "Romane", "de l'Abbaye", "des Mésanges",
    "du Capitaine Roux de Brière", "de la Croix Blanche", "du Onze Novembre",
)
_PARTS = ("", "", "", "", "", "", "Le ", "de ", "Da ", "du ", "Van ")
_CALM = (
    "la vitrine a cédé", "aucun témoin ici", "tout le quartier est dans le noir", "le chat miaule", "une branche barre le sentier", "le gardien ouvre la grille",
    "on entend des cris", "il manque une couverture", "la pluie redouble", "the kitchen smells of smoke", "nobody answered the door", "der Keller steht unter Wasser",
    "die Tür klemmt wieder", "la escalera está rota", "el perro ladra mucho", "the lift has stopped", "les volets sont clos", "son genou enfle",
)
_NOUNS = "Hund Garten Schlüssel Fenster Zug Lehrer Schule Wagen Dach Keller Tisch Arzt Schrank Bruder Treppe Lampe Decke Kiste Fluss Kirche".split()
_TRAPS = (
    "{h} h {m}, relève du groupe", "Il fait {a},{b} degrés dehors", "Pression {c}/{b0} mesurée", "Palette {a}-{m} livrée", "Affaire {y}-{six}", "Pompe sn-{a}-{seven}",
    "Bordereau {y}", "passez canal {a}", "réglage {a},{b} via relais {b}", "La rue {sn} reste bouchée", "rendez-vous place {sn}", "Le bus {a} tourne place {sn}",
    "au fond du chemin creux", "voyez le quai numéro trois", "devant l'ancien lotissement", "Faites le 17 ou le 115", "borne {a} de la d {c}", "Zone {b} ter",
    "à {town}", "vers {town}", "Commune : {town}", "à peine {c} mètres", "Binôme {b} canal {a}", "cinq rues plus bas", "un chemin boueux", "une place vide",
    "quelqu'un route fermée", "six places debout", "{h}h{m} départ", "[00:{m}:{a}] fin", "near {town} within {c} metres", "noch {c} Meter bis {town}", "unos {c} metros de {town}",
    "la voie numéro {b}", "le quai {b}", "le boulevard reste ouvert", "monsieur boite", "madame pleure beaucoup", "le docteur repart", "docteur vient voir",
    "Eine junge Frau wartet", "eine Frau ruft laut", "una señora espera", "la señora vieja espera", "monsieur a froid", "madame tousse un peu", "le docteur reste joignable",
    "un monsieur dort", "une madame attend", "der Herr wartet draußen", "el señor espera", "Die Frau zittert", "monsieur transpire", "a miss and a man wait", "Herr wartet dort",
    "tremp e. Le chef sort", "il est pâl e. La grue arrive", "on y va\nt. Le relais est là", "ga z. Le groupe sort",
    "my name is missing", "il s'appelle pareil", "je m'appelle pas", "contact rompu", "au nom de tous", "named below",
    "the flames at the warehouse", "{h} h {m}. 04 lances", "mesures {c}/{b0} puis {a}", "palier {b} porte {a}", "moins de {six} euros", "dossier {seven}", "le {h}/{m}/{y}",
    "{b} {count} {adj} à {town}", "{a} {count} près du {thing}", "{sp} {count} dans le {thing}", "{sp} {count} de la {thing2}", "il y a {b} {count} du {thing}", "environ {sp} {count} au {thing}",
    "le {thing} {b} {verb} place {sn}", "la {thing2} {a} {verb} le {thing}", "ligne {b} {verb} au {thing}", "{a} {measure} de {town}", "encore {b} {measure} vers le {thing}",
    "Der {noun} {verb_de}", "Ein {noun} {verb_de} nach {town}", "Das {noun} Nummer {b}", "Mein {noun} hinter {town}", "Die {noun} bei {town}", "Unser {noun}, Ihr {noun2}",
    "bis {noun} {town} noch {b} Meter", "die {noun} {noun2} steht", "Drei {noun} {verb_de}",
    "Der {noun} {verb_de} {noun2} {town}", "der {noun} am {noun2} {town} noch {c} Meter", "Ein {noun} kommt {noun2} {town}", "Die {noun} sperrt uns {noun2} {noun3} {town}", "alles leer {noun} {town} dort",
    "réglage {a},{b} @ pylône {b}", "niveau {b} @ borne", "waiting at the corner", "he stays at a bridge", "a boy sits at our gate", "smoke at {town}", "she fell at the {thing}",
    "Le {thing} {town}", "La {thing2} Neuve", "Trois Le", "Du Stade {town}", "Centre de Secours", "{shout}", "{shout}", "{shout}", "{shout}", "{shout}", "{shout}",
    "Un {thing} d'{noun} {verb} la {thing2}", "une {thing2} d'acier {verb} tout", "Le {thing} neuf d'acier", "{sp} {count} d'un bloc",
    "Le {thing} neuf {verb} le {thing2} vide", "la {thing2} neuve {verb} l'{thing} neuf", "un {thing} neuf {verb} l'ancien {thing}", "le {thing} {b} {verb} la {thing2} rouge",
    "die {noun} {noun2} {town} etwas weiter", "Das {noun} {verb_de} die {noun2} {town}", "wir sehen den {noun} {noun2} {town}", "ein {noun} {verb_de} {noun2} {town} im {noun3}",
)
_COUNTS = "camions blessés étages portes lances chevaux tentes sacs caisses voitures moutons élèves maisons wagons seaux pneus".split()
_THINGS = "tracteur portique hangar talus garage bassin pont préfabriqué moulin gymnase".split()
_THINGS_F = "caserne grange ferme cour digue barrière citerne remorque halle borne".split()
_SHOUTED = "LE LA UN UNE DES DANS SOUS VERS GARAGE TALUS PONT ROUGE CASSÉ TOMBE GRANGE FERME DERRIÈRE PRÈS SANS OUVRE CITERNE HALLE FROIDE".split()

_FRAMES = {
    "email": ("le courriel reste {}", "répondez sur {} avant midi", "mon adresse est {}", "joindre {} pour la suite", "{} quand c'est fini", "mettez {} en copie", "tout est parti chez {} hier", "please mail {}", "le rapport va à {}", "schreib an {}", "es {} para escribir"),
    "phone": ("Composez le {}", "tél. {}", "ou alors {} svp", "on me trouve au {} la journée", "le {} sonne occupé", "son numéro : {}", "ring me on {}", "notez le {}", "appelez {}", "{} dès que possible", "Telefon {}", "llame al {}"),
    "id_number": ("Sécurité sociale {}", "carte nationale {}", "l'attestation porte {}", "immatriculé {} au fichier", "voici {}", "le passeport dit {} dessus", "{} pour le formulaire", "My passport reads {}", "Ausweis {}", "numéro d'assuré {}"),
    "address": ("Je loge {}", "ça se passe au {} derrière l'école", "domicile : {}", "venez vite {}", "{} côté cour", "on part du {}", "allez au {}", "The house is {}", "Wir wohnen {}", "il attend {}", "livraison {} demain", "Adresse {}"),
    "name": ("Moi c'est {}", "mon voisin s'appelle {}", "ici {} à l'écoute", "cherchez {} s'il vous plaît", "{} reste en bas", "réservé au nom de {}", "la gardienne monte avec {} à l'étage", "regardez ici, {}", "signé {}", "{} a froid", "Her name is {}", "Er heißt {}", "{} ne bouge pas", "demandez {}", "hier {} a téléphoné", "selon {}, rien", "me llamo {}", "Bonsoir, {} au téléphone", "on a vu {} ce soir", "{} et moi", "remis à {} par le chef", "the caller was {}", "Gestern kam {} zu uns"),
}


#: How often a kind is drawn against twice for the others: names and addresses are the harder ones.
_WEIGHT = {"address": 4, "name": 6}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def surname(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.6:
            s = "".join(r.choice("b br c ch d f g gr j l m n p pr qu r s t tr v".split()) + r.choice("a e i o u ai ou an on eu".split()) for _ in range(r.randint(1, 3)))
            s += r.choice(("", "r", "l", "t", "n", "x", "rd", "lin", "let", "zac", "rel", "nier", "ssac"))
        elif x < 0.8:
            s = "".join(r.choice("k w z sz cz j m n r l st b g h".split()) + r.choice("a e i o u ie y".split()) for _ in range(r.randint(1, 3))) + r.choice(("ski", "k", "mann", "er", "sen", "son", "wicz", "sch", "ler"))
        else:
            s = "".join(r.choice("d n k b t y m s g l nd mb ng".split()) + r.choice("a o i u e é ou".split()) for _ in range(r.randint(2, 3)))
        return s.capitalize() if len(s) > 3 else s.capitalize() + "rin"

    def given(self) -> str:
        """A given name; more than half are in no list."""
        r = self.r
        if r.random() < 0.45:
            return r.choice(sorted(GIVEN)).capitalize()
        s = "".join(r.choice("b c d f g h j k l m n p r s t v w y z th ch sh".split()) + r.choice("a e i o u é ï ie ou".split()) for _ in range(r.randint(1, 3)))
        return (s + r.choice(("", "", "n", "l", "r", "s", "d", "line", "na", "tte", "ric", "mir", "ndra"))).capitalize() if len(s) > 2 else (s + "line").capitalize()

    def town(self) -> str:
        return self.surname()[:9] + self.r.choice(("ville", "court", "ac", "ens", "mont", "olles", "", "burg", "ey"))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        r, given = self.r, self.given()
        if r.random() < 0.1:
            given += "-" + r.choice((self.given(), "Marie", "Pierre", "Luc"))
        sur = self.surname() + ("-" + self.surname() if r.random() < 0.15 else "")
        title = r.choice(("M.", "Monsieur", "Madame", "Mme", "docteur", "Mlle", "Mr", "Dr", "maître", "Herr", "Frau"))
        part = r.choice(_PARTS)
        return r.choice((
            f"{given} {part}{sur}", f"{given} {part}{sur}", f"{given} {sur}", f"{title} {part}{sur}", f"{title} {given} {sur}",
            f"{sur.upper()} {given}", f"{sur.upper()} {given}", f"{given[0]}. {sur}", f"{given} {sur}", f"{given} {sur.upper()}", f"{given.upper()} {sur.upper()}", f"{given} {self.given()} {sur}",
        ))

    def gap(self) -> str:
        return self.r.choice((" ", " ", " ", ", euh, ", " alors ", " ... ", " euh... ", " donc "))

    def phone(self) -> str:
        r = self.r
        kind, d = r.choice("1 2 3 4 5 6 7 9".split()), self.digits(8)
        pairs = [d[i : i + 2] for i in range(0, 8, 2)]
        if r.random() < 0.24:
            words = ["zéro " + spelled(int(kind))]
            for x in pairs:
                words.append("zéro " + spelled(int(x[1])) if x[0] == "0" else spelled(int(x)))
            return " ".join(words)
        if r.random() < 0.2:
            return r.choice((f"+33 {kind} {' '.join(pairs)}", f"+33{kind}{d}", f"0033{kind}{d}", f"+33(0){kind}{d}", f"0033 {kind} {' '.join(pairs)}", f"+33 (0){kind} {' '.join(pairs)}"))
        sep = r.choice((" ", " ", ".", "-", ""))
        parts = [f"0{kind}", *pairs]
        if r.random() < 0.15:
            return f"0{kind}{pairs[0]} {d[2:5]} {d[5:]}"
        if sep == " " and r.random() < 0.25:
            k = r.randint(1, 3)
            return " ".join(parts[: k + 1]) + self.gap() + " ".join(parts[k + 1 :])
        return sep.join(parts)

    def identity(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return self.digits(12)
        if r.random() < 0.3:
            return self.digits(2) + "".join(r.choice("ABCDEFGHKLMNPRT") for _ in range(2)) + self.digits(5)
        dept = r.choice((f"{r.randint(1, 95):02d}", "2A", "2B"))
        body = [r.choice("12"), self.digits(2), f"{r.randint(1, 12):02d}", dept, self.digits(3), self.digits(3)]
        n = int("".join(body).replace("2A", "19").replace("2B", "18"))
        key = f"{97 - n % 97:02d}" if r.random() < 0.6 else self.digits(2)
        sep = r.choice((" ", ".", "", ""))
        return r.choice((sep.join([*body, key]), "".join(body) + " " + key, sep.join([*body, key])))

    def street_name(self) -> str:
        r = self.r
        return r.choice(_STREET_NAMES) if r.random() < 0.5 else "des " + r.choice(("", "Petits ", "Grands ", "Vieux ")) + self.surname() + "s"

    def address(self) -> str:
        r = self.r
        kind, name = r.choice(_STREET_KINDS if r.random() < 0.6 else _RARE_KINDS), self.street_name()
        if kind not in _STREET_KINDS and r.random() < 0.5:
            kind = self.surname().lower().rstrip("sx")  # a local word
            kind = kind if len(kind) > 2 else "venteau"
        suffix = r.choice(("", "", "", "", " bis", " ter", "B", "A"))
        number = f"{r.randint(1, 250)}{suffix}"
        town = f", {r.randint(10, 95)}{self.digits(3)} {self.town()}" if r.random() < 0.3 else ""
        if kind in _STREET_KINDS and r.random() < 0.2:
            return f"{kind} {name} numéro {number}{town}"
        if r.random() < 0.25:
            return f"{spelled(r.randint(1, 99))} {kind} {name}{town}"
        return f"{number}{r.choice(('', '', ','))} {kind} {name}{town}"

    def email(self) -> str:
        r = self.r
        given, sur = r.choice(sorted(GIVEN)), self.surname().lower()
        domain, end = r.choice(("poste", "mail", "boite", "example", "mairie", "depot")), r.choice(("fr", "com", "org", "net", "test", "example", "invalid"))
        if r.random() < 0.2:
            join = r.choice((" point ", " tiret ", " tiret bas ", " underscore ", " plus "))
            local = r.choice((given + join + sur, sur + join + given, sur + self.digits(2), given + " plus " + r.choice(("pro", "sante", "urgence"))))
            return f"{local} arobase {domain} point {end}"
        local = r.choice((f"{given}.{sur}", f"{sur}_{given}", f"{given[0]}{sur}{self.digits(2)}", f"{given}+pro", f"{given}-{sur}", f"{sur}{self.digits(4)}"))
        at = r.choice(("@", "@", "@", " @ ", "(at)", " (arobase) ", " [at] ", " arobase "))
        return f"{local}{at}{domain}.{end}"

    def _trap(self) -> str:
        r = self.r
        return r.choice(_TRAPS).format(
            h=f"{r.randint(0, 23):02d}", m=f"{r.randint(0, 59):02d}", a=r.randint(10, 99), b=r.randint(1, 9), b0=f"{r.randint(5, 12)}0", c=r.randint(100, 400), y=r.randint(1000, 9999),
            six=self.digits(6), seven=self.digits(7), town=self.town(), sn=self.street_name(), sp=spelled(r.randint(2, 40)), count=r.choice(_COUNTS), adj=r.choice(("neufs", "vides", "rouges", "perdus")),
            thing=r.choice(_THINGS), thing2=r.choice(_THINGS_F), verb=r.choice(("attend", "quitte", "longe", "traverse", "rejoint")), measure=r.choice(("mètres", "minutes", "km", "heures", "kilomètres")),
            noun=r.choice(_NOUNS), noun2=r.choice(_NOUNS), noun3=r.choice(_NOUNS), verb_de=r.choice(("brennt", "fehlt", "steht offen", "kommt gleich", "ist nass")),
            shout=" ".join(r.choice(_SHOUTED) if r.random() < 0.65 else r.choice(("", "L'")) + self.surname().upper() for _ in range(r.randint(2, 11))),
        )

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r, frames = self.r, _FRAMES
        parts: list[tuple[str, list]] = []
        for _ in range(r.randint(1, 4)):
            x = r.random()
            if x < 0.5:
                kind = r.choice([k for k in frames for _ in range(_WEIGHT.get(k, 2))])
                value = {"email": self.email, "phone": self.phone, "id_number": self.identity, "address": self.address, "name": self.name}[kind]()
                frame = r.choice(frames[kind])
                at = frame.index("{}")
                parts.append((frame.replace("{}", value), [(at, at + len(value), kind)]))
            else:
                parts.append((self._trap() if x < 0.85 else r.choice(_CALM), []))
        text, spans = "", []
        mode = r.random()
        for s, found in parts:
            if text:
                text += r.choice((". ", ". ", ", ", " ; ", "\n", " et ")) if mode > 0.12 else " "
            if r.random() < 0.08:
                text += r.choice(("euh ", "bah ", "mmh "))
            spans += [(a + len(text), z + len(text), k) for a, z, k in found]
            text += s[:1].upper() + s[1:] if (not text or text[-2:] == ". ") and s[:1].isalpha() and mode > 0.12 else s
        text += "." if mode > 0.12 else ""
        if mode < 0.24:
            text = text.lower()
        elif mode > 0.97 and len(text.upper()) == len(text):
            text = text.upper()
        return text, spans


def labelled(n: int = SENTENCES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    m = _Maker(seed)
    return [m.sentence() for _ in range(n)]
