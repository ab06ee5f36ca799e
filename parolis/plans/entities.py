"""Transcript queries: normalisation, places, domain concepts, error rates, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.functions import rules as R
from parolis.functions import text as T
from parolis.operators import entities as E
from parolis.operators.overlap import attribute_speaker, words_in_window
from parolis.operators.turns import by_count, valid_turns
from parolis.plans.overlap import MARGIN, WINDOW_SQL, annotations_once, timed_words
from parolis.plans.turns import TURNS_SQL
from parolis.runtime import table


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of speech, cleaned of noise, once an id: ``audio_id, text_id, text``."""
    a = table(spark, sf_dir, "annotations").where("audio_id IS NOT NULL AND tier NOT IN ('Ac_ev', 'bruit')")
    a = a.select("audio_id", F.col("ann_id").alias("text_id"), T.clean_annotation(F.col("text")).alias("text")).where("text IS NOT NULL")
    return a.dropDuplicates(["text_id"])


def automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcribed segments, once an id."""
    s = table(spark, sf_dir, "segments").where("audio_id IS NOT NULL AND text IS NOT NULL")
    return s.select("audio_id", F.col("seg_id").alias("text_id"), "text").dropDuplicates(["text_id"])


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reference(spark, sf_dir)
    return r.select("text_id", T.normalize_detect(F.col("text")).alias("detect"), T.normalize_display(F.col("text")).alias("display"))


def clean_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference(spark, sf_dir).select("text_id", "audio_id", "text")


def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("digest"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places named in the sector line of intervention sheets, lower-cased, hyphens as blanks."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    place = F.explode(F.regexp_extract_all("text", F.lit(r"Secteur : ([^\r\n]+)"), 1))
    return d.select(place.alias("place")).select(F.lower(F.trim(F.replace("place", F.lit("-"), F.lit(" ")))).alias("place")).distinct()


def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gazetteer_matches(reference(spark, sf_dir), gazetteer(spark, sf_dir))


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entities(reference(spark, sf_dir))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_spans(spark, sf_dir).groupBy("text_id", "category").agg(F.count("*").alias("n"))


def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.distinct_entities(entity_spans(spark, sf_dir)).select("audio_id", "category", "mot", "n")


def entity_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outcomes(reference(spark, sf_dir), automatic(spark, sf_dir))


def entity_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that the automatic transcript of their call keeps."""
    return entity_outcomes(spark, sf_dir).where("status = 'CORRECT'").select("audio_id", "category", "mot")


def wer_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.concept_error_rates(entity_outcomes(spark, sf_dir))


def wer_domain_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.concept_error_rates(entity_outcomes(spark, sf_dir), "category")


def insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.insertions(reference(spark, sf_dir), automatic(spark, sf_dir))


def entity_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of the automatic transcript with their time and speaker: ``seg_id, category, mot, start_s, end_s, speaker``.

    The time of a concept is that of the words its characters fall on.
    """
    g = table(spark, sf_dir, "segments").where("audio_id IS NOT NULL AND words IS NOT NULL").select("seg_id", "audio_id", "words").dropDuplicates(["seg_id"])
    said = F.array_join(F.transform("words", lambda w: F.coalesce(w["word"], F.lit(""))), " ")
    g = g.withColumn("text", said)
    found = E.entities(g.select("audio_id", F.col("seg_id").alias("text_id"), "text")).join(g.select(F.col("seg_id").alias("text_id"), "words"), "text_id")
    lengths = F.transform("words", lambda w: F.length(F.coalesce(w["word"], F.lit(""))))
    starts = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda acc, n: acc + n + 1))
    ends = F.transform(F.arrays_zip(starts.alias("a"), lengths.alias("n"), F.col("words").alias("w")), lambda x: F.struct(x["a"].alias("a"), (x["a"] + x["n"]).alias("b"), x["w"]["start"].alias("s"), x["w"]["end"].alias("e")))
    on = F.filter(ends, lambda x: (x["b"] > F.col("start")) & (x["a"] < F.col("end")))
    found = found.withColumn("on", on).withColumn("s", F.array_min(F.transform("on", lambda x: x["s"]))).withColumn("e", F.array_max(F.transform("on", lambda x: x["e"])))
    found = found.withColumn("entity_id", F.concat_ws("/", "text_id", "rule_no", "start"))
    who = attribute_speaker(found.where("s IS NOT NULL AND e > s"), valid_turns(table(spark, sf_dir, "turns")))
    out = found.join(who, "entity_id", "left")
    return out.select(F.col("text_id").alias("seg_id"), "category", "mot", F.coalesce(F.round("s", 2), F.lit(0.0)).alias("start_s"), F.coalesce(F.round("e", 2), F.lit(0.0)).alias("end_s"), F.coalesce("speaker", F.lit("INCONNU")).alias("speaker"))


def entity_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.performance_by_root(entity_outcomes(spark, sf_dir)).drop("by_source")


def entity_perceived(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.distinct_entities(entity_spans(spark, sf_dir))
    return E.perceived(found, entity_outcomes(spark, sf_dir)).select("audio_id", "category", "mot", "percu")


def entity_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.distinct_spans(entity_spans(spark, sf_dir)).select("text_id", "category", "start", "end", "rule_no", "mot")


def calls_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_count(valid_turns(table(spark, sf_dir, "turns")))


def hybrid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of annotations, of all speakers together, and whether the words within the margin hold them too."""
    a = annotations_once(spark, sf_dir).where("tier NOT IN ('Ac_ev', 'bruit')")
    near = words_in_window(a, timed_words(spark, sf_dir), MARGIN).withColumnRenamed("text", "hyp")
    return a.join(near, "entity_id").select("entity_id", F.explode(R.retained(F.col("text"), F.col("hyp"))).alias("x")).select("entity_id", "x.*")


def hybrid_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category the concepts of annotations that the words within the margin also hold."""
    x = hybrid_lists(spark, sf_dir)
    kept = F.count(F.when(F.col("kept"), 1))
    return x.groupBy("category").agg(F.count("*").alias("n_expected"), kept.alias("n_found"), F.round(100.0 * kept / F.count("*"), 6).alias("score"))


def wer_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations_once(spark, sf_dir).where("tier NOT IN ('Ac_ev', 'bruit')")
    near = words_in_window(a, timed_words(spark, sf_dir)).withColumnRenamed("text", "hyp")
    return E.segment_error_rates(a.join(near, "entity_id").select("audio_id", T.clean_annotation(F.col("text")).alias("ref"), "hyp").where("ref IS NOT NULL"))


def wer_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = wer_segment(spark, sf_dir)
    n = F.sum("n_words")
    return x.agg(n.alias("n_words"), F.sum("n_segments").alias("n_segments"), F.round(F.sum(F.col("micro_wer") * F.col("n_words")) / n, 6).alias("wer"))


def context_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of the queries, learned from the automatic texts: ``context`` is a category of the concept rules, and a
    word speaks for it (1) where the texts with the word hold the category at least three times as often as all texts do
    and a fiftieth of the category's texts have the word, and against it (-0.5) where they hold it at most a third as
    often although a fiftieth of all texts have the word. Words of fewer than four letters say nothing."""
    texts = automatic(spark, sf_dir).select("audio_id", "text_id", "text")
    held = E.entities(texts).select("text_id", F.col("category").alias("context")).distinct()
    said = texts.select("text_id", F.explode(F.array_distinct(F.split(T.folded_words(F.col("text")), " "))).alias("word")).where(F.length("word") >= 4)
    n_c, n_w = held.groupBy("context").agg(F.count("*").alias("n_c")), said.groupBy("word").agg(F.count("*").alias("n_w"))
    both = said.join(held, "text_id").groupBy("context", "word").agg(F.count("*").alias("n"))
    x = both.join(n_c, "context").join(n_w, "word").crossJoin(texts.agg(F.count("*").alias("total")))  # one row of totals
    pro = (F.col("n") * F.col("total") >= 3 * F.col("n_w") * F.col("n_c")) & (50 * F.col("n") >= F.col("n_c"))
    con = (3 * F.col("n") * F.col("total") <= F.col("n_w") * F.col("n_c")) & (50 * F.col("n_w") >= F.col("total"))
    return x.select("context", "word", F.when(pro, 1.0).when(con, -0.5).alias("weight")).where("weight IS NOT NULL")


#: An entity is doubtful with this fragment, the first contexts and without the others.
DOUBTS = (("fum", ("ACCIDENT",), ("INCENDIE",)), ("brule", (), ("INCENDIE", "TRAUMATISME")))


def _contexts_of(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    r = reference(spark, sf_dir)
    return E.context_scores(E.entities(r), r, context_words(spark, sf_dir), strict, DOUBTS)


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts_of(spark, sf_dir, True)


def context_scores_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts_of(spark, sf_dir, False)


def context_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = context_scores(spark, sf_dir).where("context IS NOT NULL")
    return x.groupBy("context").agg(F.count("*").alias("n"), F.count(F.when(F.col("false_positive"), 1)).alias("n_false_positive"))


QUERIES = {
    "normalize_text": normalize_text, "clean_annotations": clean_annotations, "strip_accents": strip_accents, "gazetteer": gazetteer,
    "gazetteer_match": gazetteer_match, "entity_spans": entity_spans, "entity_counts": entity_counts, "entity_dedup": entity_dedup,
    "entity_outcomes": entity_outcomes, "entity_correct": entity_correct, "wer_domain": wer_domain, "wer_domain_by_category": wer_domain_by_category, "insertions": insertions,
    "entity_roots": entity_roots, "entity_perceived": entity_perceived, "entity_span_dedup": entity_span_dedup, "calls_by_count": calls_by_count, "hybrid_lists": hybrid_lists,
    "entity_speakers": entity_speakers, "hybrid_retention": hybrid_retention, "wer_segment": wer_segment, "wer_global": wer_global,
    "context_words": context_words, "context_scores": context_scores, "context_scores_loose": context_scores_loose, "context_frequency": context_frequency,
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DF = "(" + ", ".join(_quoted(w) for w in T.DISFLUENCIES) + ")"
_NOISE = "(" + ", ".join(_quoted(w) for w in T.NOISE_ONLY) + ")"
_REF = rf"""WITH q AS (SELECT ann_id AS text_id, any_value(audio_id) AS audio_id, trim(any_value(text), E' \t\n\r ') AS raw FROM annotations
  WHERE audio_id IS NOT NULL AND tier NOT IN ('Ac_ev', 'bruit') AND text IS NOT NULL GROUP BY ann_id),
z AS (SELECT text_id, audio_id, trim(regexp_replace(regexp_replace(raw, '(?i)\bund\b|\[bruit\]|\(bruit\)|<bruit>', '', 'g'), '[\s\x{{00a0}}\x{{202f}}\x{{2009}}]+', ' ', 'g')) AS text
  FROM q WHERE lower(raw) NOT IN {_NOISE}),
r AS (SELECT * FROM z WHERE length(text) > 0)"""
_WORDS = r"trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+', ' ', 'g'))"


def _detect(c: str) -> str:
    base = _WORDS.format(c)
    twice = f"replace(replace(' ' || replace({base}, ' ', '  ') || ' ', ' bon  ben ', ' '), ' he  bien ', ' ')"
    return f"array_to_string(list_filter(string_split({twice}, ' '), lambda w: w <> '' AND w NOT IN {_DF}), ' ')"


_AUTO = """, s AS (SELECT seg_id AS text_id, any_value(audio_id) AS audio_id, any_value(text) AS text FROM segments WHERE audio_id IS NOT NULL AND text IS NOT NULL GROUP BY seg_id)"""
_FOLDED = "strip_accents(lower(text))"
_FOUND = ", m AS (" + " UNION ALL ".join(
    f"SELECT text_id, audio_id, '{r.category}' AS category, unnest(regexp_extract_all({_FOLDED}, {_quoted(r.pattern)})) AS mot FROM r" for r in R.RULES
) + ")"


def _spans_of(source: str) -> str:
    """Entities of a relation with their places; what lies between two matches gives the place of the second."""
    rules = " UNION ALL ".join(
        f"SELECT audio_id, text_id, '{r.category}' AS category, {n} AS rule_no, regexp_extract_all(t, {_quoted(r.pattern)}) AS ms, regexp_split_to_array(t, {_quoted(r.pattern)}) AS ps FROM folded"
        for n, r in enumerate(R.RULES)
    )
    total = "coalesce(CAST(list_sum(list_transform({}, lambda x: length(x))) AS INT), 0)"
    return f"""SELECT audio_id, text_id, category, CAST(rule_no AS INT) AS rule_no, ms[i] AS mot, CAST({total.format('ps[1:i]')} + {total.format('ms[1:i-1]')} AS INT) AS start
FROM (WITH folded AS (SELECT audio_id, text_id, strip_accents(lower(nfc_normalize(text))) AS t FROM {source}) {rules}), unnest(range(1, len(ms) + 1)) AS u(i)"""


_ENTITIES = ", e AS (SELECT *, CAST(start + length(mot) AS INT) AS \"end\" FROM (" + _spans_of("r") + "))"
_CONTEXT_WORDS = ", se AS (SELECT DISTINCT text_id, category AS context FROM (" + _spans_of("s") + "))" + f""",
sw AS (SELECT text_id, word FROM (SELECT text_id, unnest(list_distinct(string_split({_WORDS.format('text')}, ' '))) AS word FROM s) WHERE length(word) >= 4),
nc AS (SELECT context, count(*) AS n_c FROM se GROUP BY context), nw AS (SELECT word, count(*) AS n_w FROM sw GROUP BY word),
nb AS (SELECT context, word, count(*) AS n FROM sw JOIN se USING (text_id) GROUP BY context, word),
cw AS (SELECT context, word, CASE WHEN n * total >= 3 * n_w * n_c AND 50 * n >= n_c THEN 1.0::DOUBLE WHEN 3 * n * total <= n_w * n_c AND 50 * n_w >= total THEN -0.5::DOUBLE END AS weight
       FROM nb JOIN nc USING (context) JOIN nw USING (word), (SELECT count(*) AS total FROM s)),
k AS (SELECT * FROM cw WHERE weight IS NOT NULL)"""
_SILENT = "(" + ", ".join(sorted({_quoted(R.fold(w)) for w in E.CONTEXT_STOPWORDS})) + ")"


def _tokens(c: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(strip_accents(lower({c})), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def _scored(strict: bool) -> str:
    """Contexts of each entity by SQL, from the words around it."""
    side = "(SELECT id, context, i, {} AS v FROM tk JOIN k ON {} WHERE weight {} 0 GROUP BY id, context, i)"
    test = "k.word = tk.token" if strict else "contains(tk.token, k.word) OR contains(k.word, tk.token)"
    parts = [side.format("arg_min(weight, word)", test, op) for op in (">", "<=")]
    if not strict:
        parts.append("(SELECT id, context, i, 0.5 * weight AS v FROM pr JOIN k ON contains(pr.pair, k.word) WHERE weight > 0)")
    return f""", en AS (SELECT row_number() OVER () AS id, e.*, r.text FROM e JOIN r USING (text_id)),
b AS (SELECT id, list_slice(t, greatest(len(t) - 7, 1), len(t)) AS t FROM (SELECT id, {_tokens('substring(text, 1, start)')} AS t FROM en)),
a AS (SELECT id, ({_tokens('substring(text, "end" + 1, length(text))')})[1:8] AS t FROM en),
w AS (SELECT id, list_filter(b.t || {_tokens('substring(text, start + 1, "end" - start)')} || a.t, lambda x: x NOT IN {_SILENT}) AS t FROM en JOIN b USING (id) JOIN a USING (id)),
tk AS (SELECT id, i, t[i] AS token FROM w, unnest(range(1, len(t) + 1)) AS u(i)),
pr AS (SELECT id, i, t[i] || ' ' || t[i + 1] AS pair FROM w, unnest(range(1, len(t))) AS u(i)),
h AS (SELECT id, context, round(sum(v), 6) AS score FROM ({' UNION ALL '.join('SELECT * FROM ' + x for x in parts)}) GROUP BY id, context HAVING round(sum(v), 6) > 0 AND count(*) >= 2),
j AS (SELECT id, arg_min(context, (-score, context)) AS context, max(score) AS best, count(*) AS n, sum(score) AS total, list(context) AS names FROM h GROUP BY id),
o AS (SELECT text_id, category, mot, start, context, coalesce(best, 0.0) AS context_score, CAST(coalesce(n, 0) AS INT) AS n_contexts,
      round(least(coalesce(total, 0) / 5.0, 1.0), 6) AS confidence, {' OR '.join(map(_doubt, DOUBTS))} AS false_positive FROM en LEFT JOIN j USING (id))"""


def _doubt(d: tuple[str, tuple, tuple]) -> str:
    has = lambda c: f"list_contains(coalesce(names, []), '{c}')"
    some = [f"contains(mot, '{d[0]}')"] + (["(" + " OR ".join(map(has, d[1])) + ")"] if d[1] else [])
    return "(" + " AND ".join(some + [f"NOT {has(c)}" for c in d[2]]) + ")"


_PLACES = r""", l AS (SELECT DISTINCT lower(trim(replace(unnest(regexp_extract_all(text, 'Secteur : ([^\r\n]+)', 1)), '-', ' '))) AS place FROM documents WHERE text IS NOT NULL)"""

_CORRECT = f""", d AS (SELECT DISTINCT audio_id, category, trim(mot) AS mot, {_detect('trim(mot)')} AS norm FROM m),
h AS (SELECT audio_id, {_detect('text')} AS heard FROM s),
ok AS (SELECT *, EXISTS (SELECT 1 FROM h WHERE h.audio_id = d.audio_id AND contains(h.heard, d.norm)) AS correct FROM d WHERE norm <> '')"""
_HYBRID = WINDOW_SQL(MARGIN).replace("WITH t AS", "WITH y AS (SELECT 1), t AS", 1)
_HYBRID = "WITH near AS (" + _HYBRID + ")" + """, an AS (SELECT ann_id AS entity_id, any_value(text) AS text FROM annotations
  WHERE audio_id IS NOT NULL AND start IS NOT NULL AND "end" > start AND tier NOT IN ('Ac_ev', 'bruit') GROUP BY ann_id),
pr AS (SELECT an.entity_id, strip_accents(lower(coalesce(an.text, ''))) AS r, strip_accents(lower(near.text)) AS h FROM an JOIN near USING (entity_id)),
hl AS (""" + " UNION ALL ".join(
    f"SELECT entity_id, '{x.category}' AS category, CAST({n} AS INT) AS rule_no, trim(regexp_extract(r, {_quoted(x.pattern)})) AS mot, regexp_matches(h, {_quoted(x.pattern)}) AS kept FROM pr WHERE regexp_matches(r, {_quoted(x.pattern)})"
    for n, x in enumerate(R.RULES)
) + ")"

SQL = {
    "entity_roots": _REF + _AUTO + _FOUND + _CORRECT + """ SELECT split_part(category, '_AUTO', 1) AS root, count(*) AS n, count(CASE WHEN correct THEN 1 END) AS n_correct,
  round(100.0 * count(CASE WHEN correct THEN 1 END) / count(*), 6) AS rate FROM ok GROUP BY 1""",
    "entity_perceived": _REF + _AUTO + _FOUND + _CORRECT + """ SELECT audio_id, category, mot, bool_or(coalesce(c.correct, FALSE)) AS percu
FROM (SELECT DISTINCT audio_id, category, trim(mot) AS mot FROM m) LEFT JOIN (SELECT audio_id, mot, correct FROM ok WHERE correct) c USING (audio_id, mot) GROUP BY ALL""",
    "entity_span_dedup": _REF + _ENTITIES + """ SELECT text_id, category, start, "end", min(rule_no) AS rule_no, arg_min(mot, rule_no) AS mot FROM e GROUP BY audio_id, text_id, category, start, "end\"""",
    "calls_by_count": TURNS_SQL + "SELECT audio_id, count(*) AS n FROM t GROUP BY audio_id",
    "hybrid_lists": _HYBRID + " SELECT entity_id, category, rule_no, mot, kept FROM hl",
    "hybrid_retention": _HYBRID + " SELECT category, count(*) AS n_expected, count(CASE WHEN kept THEN 1 END) AS n_found, round(100.0 * count(CASE WHEN kept THEN 1 END) / count(*), 6) AS score FROM hl GROUP BY category",
    "normalize_text": _REF + f" SELECT text_id, {_detect('text')} AS detect, " + r"trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', ' ', 'g')) AS display FROM r",
    "clean_annotations": _REF + " SELECT text_id, audio_id, text FROM r",
    "gazetteer": "WITH r AS (SELECT 1)" + _PLACES + " SELECT place FROM l",
    "gazetteer_match": _REF + _PLACES + f""", n AS (SELECT DISTINCT {_WORDS.format('place')} AS place FROM l),
t AS (SELECT text_id, string_split({_WORDS.format('text')}, ' ') AS t FROM r),
g AS (SELECT text_id, array_to_string(t[i:i+k-1], ' ') AS place FROM t, unnest([1, 2, 3]) AS x(k), unnest(range(1, len(t) - k + 2)) AS u(i))
SELECT text_id, place, count(*) AS n FROM g JOIN n USING (place) WHERE place <> '' GROUP BY text_id, place""",
    "entity_spans": _REF + _ENTITIES + ' SELECT audio_id, text_id, category, rule_no, mot, start, "end" FROM e',
    "context_words": _REF + _AUTO + _CONTEXT_WORDS + " SELECT context, word, weight FROM k",
    "context_scores": _REF + _AUTO + _ENTITIES + _CONTEXT_WORDS + _scored(True) + " SELECT * FROM o",
    "context_scores_loose": _REF + _AUTO + _ENTITIES + _CONTEXT_WORDS + _scored(False) + " SELECT * FROM o",
    "context_frequency": _REF + _AUTO + _ENTITIES + _CONTEXT_WORDS + _scored(True)
    + " SELECT context, count(*) AS n, count(CASE WHEN false_positive THEN 1 END) AS n_false_positive FROM o WHERE context IS NOT NULL GROUP BY context",
    "entity_counts": _REF + _FOUND + " SELECT text_id, category, count(*) AS n FROM m GROUP BY text_id, category",
    "entity_dedup": _REF + _FOUND + " SELECT audio_id, category, trim(mot) AS mot, count(*) AS n FROM m GROUP BY audio_id, category, trim(mot)",
    "entity_correct": _REF + _AUTO + _FOUND + f""", d AS (SELECT DISTINCT audio_id, category, trim(mot) AS mot, {_detect('trim(mot)')} AS norm FROM m),
h AS (SELECT audio_id, {_detect('text')} AS heard FROM s)
SELECT audio_id, category, mot FROM d WHERE norm <> '' AND EXISTS (SELECT 1 FROM h WHERE h.audio_id = d.audio_id AND contains(h.heard, d.norm))""",
    "strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents WHERE text IS NOT NULL",
    "insertions": _REF + _AUTO + _FOUND + f""", vr AS (SELECT DISTINCT audio_id, unnest(string_split({_detect('text')}, ' ')) AS word FROM r),
vs AS (SELECT DISTINCT audio_id, unnest(string_split({_detect('text')}, ' ')) AS word FROM s),
vm AS (SELECT DISTINCT audio_id, unnest(string_split({_detect('mot')}, ' ')) AS word FROM m)
SELECT audio_id, word FROM (SELECT audio_id, word FROM vs EXCEPT SELECT audio_id, word FROM vr EXCEPT SELECT audio_id, word FROM vm)
WHERE length(word) >= 5 AND audio_id IN (SELECT audio_id FROM r)""",
}
