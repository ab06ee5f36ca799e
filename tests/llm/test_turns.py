import random

import pytest
from conftest import rows

from parolis.llm.lexicon import parse_label, speaker_of
from parolis.llm.speaker_turns import pieces, speaker_turns, split_pieces, turn_heads

SCHEMA = "seg_id bigint, audio_id string, speaker string, start double, end double, text string, words array<struct<word: string, start: double, end: double>>"


@pytest.mark.parametrize(
    ("label", "want"),
    [("1", "requerant1"), (" 0 ", "requerant0"), ("12", "requerant12"), ("Op.", "operateur"), ("op-sdis 1", "operateur"), ("OP_SDIS1", "operateur"), ("Opérateur", "operateur"),
     ("REQUÉRANT0", "requerant0"), ("req. 2", "requerant2"), ("appelant", "requerant1"), (" requerant_3", "requerant3"), ("interv. 1", "intervenant1"), ("Intervenant", "intervenant1"),
     ("?", "inconnu"), ("", "inconnu"), (None, "inconnu"), ("UNKNOWN", "inconnu"), ("voiture", "inconnu")],
)
def test_labels(label, want):
    assert speaker_of(label) == want


def test_no_label_is_none():
    assert parse_label("feu") is None and parse_label("") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("00:01:23,494 --> - Requerant1 : La cheminée fume.\n[OP-SDIS1] Restez là.", [("requerant1", "La cheminée fume."), ("operateur", "Restez là.")]),
        ("Avant. op: euuuh... (bruit)", [("requerant1", "Avant.")]),
        ("dit l'opérateur : non", [("requerant1", "dit l'opérateur : non")]),
        ("le requérant : il tousse", [("requerant1", "le requérant : il tousse")]),
        ("<op> (chien  qui aboie) ben le feu.", [("operateur", "le feu.")]),
        ("[0'15\"] bonjour", [("requerant1", "bonjour")]),
        ("2 : bonjour à 14:30", [("requerant2", "bonjour à 14:30")]),
        ("und *tousse* [BRUIT] hm, bien.", []),
        ("Il va bien là.", [("requerant1", "Il va bien là.")]),
        ("[claquement de porte]", []),
        ("Oui. (sirène au loin) Venez.", [("requerant1", "Oui. Venez.")]),
        ("[musique de fond] *moteur qui cale* {voix lointaine} non", [("requerant1", "non")]),
        ("Il (le voisin) respire mal", [("requerant1", "Il (le voisin) respire mal")]),
        ("00:01:02 bonjour", [("requerant1", "bonjour")]),
        ("bonjour à 00:01:02 précises", [("requerant1", "bonjour à 00:01:02 précises")]),
        ("[voir plan 12] ici", [("requerant1", "[voir plan 12] ici")]),
        ("[ouverte [cris] encore", [("requerant1", "[ouverte encore")]),
        ("Mail x (at) poste.fr, tel +33 (0)6", [("requerant1", "Mail x (at) poste.fr, tel +33 (0)6")]),
        ("", []),
        (None, []),
        ("...", []),
    ],
)
def test_pieces_of_one_text(text, want):
    assert split_pieces(text, "appelant") == want


def test_very_long_text():
    text = "op : " + "le feu brûle " * 50_000 + " [req. 2] non"
    assert len(split_pieces("op : oui euh, (bruit) [req. 1] non " * 20_000, None)) == 40_000
    got = split_pieces(text, None)
    assert [s for s, _ in got] == ["operateur", "requerant2"] and len(got[0][1]) > 600_000


def brute(data):
    """Turn heads by one sorted pass a call."""
    once = {}
    for seg, audio, who, start, _, text, words in data:
        if seg is None or audio is None:
            continue
        t = start if start is not None else min((w[1] for w in words or [] if w[1] is not None), default=None)
        once[audio, seg] = (t, split_pieces(text, who))
    out = []
    for audio in {a for a, _ in once}:
        last = None
        segs = sorted(((t is None, t or 0.0, s, p) for (a, s), (t, p) in once.items() if a == audio))
        for _, _, seg, parts in segs:
            n = 0
            for who, _ in parts:
                if who != last:
                    n += 1
                    out.append((seg, n, who))
                last = who
    return sorted(out, key=lambda t: tuple((True, str(x)) for x in t))


def sample(seed, n=160):
    r = random.Random(seed)
    texts = ["Le feu.", "op : Oui. [req. 1] Non. op > Si.", "euh, (bruit)", "<op> ici. <op> encore.", None, "", "Un mot.", "intervenant 2 : Bien sûr."]
    data = []
    for i in range(n):
        start = r.choice([None, r.uniform(0, 3000), float(r.randint(0, 40))])
        words = r.choice([None, [], [("a", r.uniform(0, 3000), None), ("b", None, None)]])
        data.append((i, r.choice(["x", "x", "y", None]), r.choice(["op", "1", None, "0"]), start, None, r.choice(texts), words))
    return data + data[:15]


@pytest.mark.parametrize("slice_s", [1, 100, 10_000])
def test_against_one_pass(spark, slice_s):
    data = sample(slice_s)
    got = turn_heads(spark.createDataFrame(data, SCHEMA).repartition(5), slice_s=slice_s)
    assert rows(got, "seg_id", "turn_in_seg", "speaker") == brute(data)


def test_whole_turns_and_numbers(spark):
    data = [(2, "c", "op", 700.0, None, "Oui [req. 1] non", None), (1, "c", "Op.", 5.0, None, "Allô euh, ici", None), (3, "c", "1", 1500.0, None, "toujours non", None)]
    got = rows(speaker_turns(spark.createDataFrame(data, SCHEMA)), "turn_no", "speaker", "seg_id", "n_pieces", "text")
    assert got == [(1, "operateur", 1, 2, "Allô ici Oui"), (2, "requerant1", 2, 2, "non toujours non")]


def test_empty_and_clashing_columns(spark):
    assert pieces(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "c", "op", 0.0, None, "Oui", None, 5, "z")], SCHEMA + ", slice int, piece string")
    assert rows(turn_heads(df), "seg_id", "turn_in_seg", "speaker") == [(1, 1, "operateur")]
