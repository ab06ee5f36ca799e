"""Spans of a pluggable entity recogniser, routed, filtered and merged with the rule matches.

No model is bundled: a recogniser is a factory called once a worker that returns a function from texts to lists of
(text, start, end, label). Without one nothing is added, so results stay the same everywhere.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from parolis.functions.text import strip_accents

# Words that carry no content in a quantity, units and numbers in words.
FUNCTION_WORDS = ("sur", "sous", "dans", "vers", "près", "de", "du", "la", "le", "les", "lès")
UNITS = ("mètre", "metre", "mètres", "metres", "km", "kilomètre", "kilometre", "kilomètres", "kilometres")
NUMBER_WORDS = ("un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "vingt", "trente", "quarante", "cinquante", "soixante", "cent", "mille")
# Fragments that make a place match a false positive.
PLACE_NOISE = ("tant que", "tant qu", "pour", "c'est", "c est", "donc", "a un", "le", "la")

SPANS = S.ArrayType(S.StructType([S.StructField("mot", S.StringType()), S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType()), S.StructField("label", S.StringType())]))

Recogniser = Callable[[list[str]], list[list[tuple[str, int, int, str]]]]


def routed(label: Column) -> Column:
    """Category of a recogniser's label; dictionary labels keep their own."""
    auto = lambda root: F.concat(F.lit(root + "_AUTO_"), label)
    return (
        F.when(label.startswith("CISU_"), label).when(label.isin("LOC", "ORG"), auto("LIEU")).when(label.isin("PER", "PERSON"), auto("PERSONNE"))
        .when(label.isin("DATE", "TIME"), auto("TEMPORALITE")).when(label == "CARDINAL", auto("QUANTITE")).when(label == "MISC", auto("DIVERS")).otherwise(auto("AUTRE"))
    )


def noisy(mot: Column) -> Column:
    """Whether a span is too short or only numbers and units after the function words."""
    x = F.lower(F.trim(mot))
    bare = F.regexp_replace(x, r"(?U)[^\w\s]", "")
    words = F.filter(F.split(F.regexp_replace(x, r"(?U)\W+", " "), " "), lambda w: (w != "") & ~w.isin(*FUNCTION_WORDS))
    measure = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*NUMBER_WORDS) | w.isin(*UNITS) | w.rlike(r"^\d+$"))
    return (F.length(bare) <= 2) | measure


def false_place(mot: Column) -> Column:
    """Whether a place match holds one of the fragments of spoken grammar."""
    return F.exists(F.array(*[F.lit(w) for w in PLACE_NOISE]), lambda w: F.contains(F.lower(mot), w))


def recognised(texts: DataFrame, factory: Callable[[], Recogniser] | None, least: int = 3) -> DataFrame:
    """Spans of ``texts`` (``audio_id, text_id, text``): ``audio_id, text_id, category, label, mot, start, end``; shorter
    than ``least`` characters or noisy ones are dropped. Without a factory there are none."""
    if factory is None:
        spans = F.array().cast(SPANS)
    else:

        @F.pandas_udf(SPANS)
        def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = factory()
            for s in batches:
                found = run([t or "" for t in s])
                yield pd.Series([[{"mot": m, "start": a, "end": z, "label": k} for m, a, z, k in f] for f in found])

        spans = spans_of("text")
    x = texts.where("text IS NOT NULL").select("audio_id", "text_id", F.explode(spans).alias("x")).select("audio_id", "text_id", "x.*")
    x = x.withColumn("mot", F.trim("mot")).where((F.length("mot") >= least) & ~noisy(F.col("mot")))
    return x.select("audio_id", "text_id", routed(F.col("label")).alias("category"), "label", "mot", "start", "end")


def merged(rules: DataFrame, recogniser: DataFrame) -> DataFrame:
    """Rule matches and recogniser spans of each call, the first of equal ``(category, lower(mot))``; a span whose text a
    rule found already is dropped. ``source`` is ``rules`` or ``ner``."""
    a = rules.select("audio_id", "text_id", "category", F.lower("mot").alias("mot"), "start", "end", F.lit(0).alias("pass"))
    b = recogniser.select("audio_id", "text_id", "category", F.lower("mot").alias("mot"), "start", "end", F.lit(1).alias("pass"))
    seen = a.select("audio_id", strip_accents(F.col("mot")).alias("key")).distinct()
    b = b.withColumn("key", strip_accents(F.col("mot"))).join(seen, ["audio_id", "key"], "left_anti").drop("key")
    w = Window.partitionBy("audio_id", "category", "mot").orderBy("pass", "text_id", "start")
    x = a.unionByName(b).withColumn("k", F.row_number().over(w)).where("k = 1")
    return x.select("audio_id", "text_id", "category", "mot", "start", "end", F.when(F.col("pass") == 0, "rules").otherwise("ner").alias("source"))
