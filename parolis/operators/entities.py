"""Domain concepts in transcripts: extraction, alignment with the automatic transcript, error rates, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolis.functions import rules as R
from parolis.functions import text as T
from parolis.runtime import cut_lineage

#: Least similarity of a substitution, number of context words on each side, least hits, scale of the confidence.
LEAST_RATIO, CONTEXT_WORDS, LEAST_HITS, CONFIDENCE = 0.7, 8, 2, 5.0

# Words that are never insertions.
STOPWORDS = (
    "le", "la", "les", "un", "une", "des", "du", "de", "et", "ou", "mais", "donc", "car", "ce", "cet", "cette", "ces",
    "mon", "ton", "son", "notre", "votre", "leur", "dans", "par", "sur", "pour", "avec", "sans", "chez", "est", "sont",
    "avait", "avais",
)

# Words that say nothing about a context, beside the above.
CONTEXT_STOPWORDS = STOPWORDS + (
    "il", "ne", "que", "qui", "être", "avoir", "à", "au", "aux", "en", "se", "me", "te", "nous", "vous", "y", "lui",
    "moi", "toi", "soi", "là", "ici", "bien", "très", "trop", "plus", "moins", "aussi", "or", "ni",
)

#: Rows a table of contexts may have; it goes to the driver.
CONTEXT_ROWS = 20_000


def entities(texts: DataFrame, rules: tuple = R.RULES) -> DataFrame:
    """All matches in ``texts`` (``audio_id, text_id, text``): ``audio_id, text_id, category, rule_no, mot, start, end``."""
    x = texts.where("text IS NOT NULL").select("audio_id", "text_id", F.explode(R.spans(F.col("text"), rules)).alias("x"))
    return x.select("audio_id", "text_id", "x.*")


def distinct_entities(found: DataFrame) -> DataFrame:
    """The first of equal ``(category, mot)`` of a call in order of rule, text and position."""
    first = F.min(F.struct("rule_no", "text_id", "start", "end")).alias("x")
    x = found.groupBy("audio_id", "category", "mot").agg(first, F.count("*").alias("n"))
    return x.select("audio_id", "category", "mot", "x.*", "n")


def distinct_spans(found: DataFrame) -> DataFrame:
    """The first of equal ``(category, start, end)`` of a text in order of rule."""
    first = F.min(F.struct("rule_no", "mot")).alias("x")
    return found.groupBy("audio_id", "text_id", "category", "start", "end").agg(first).select("audio_id", "text_id", "category", "start", "end", "x.*")


def vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct normalised words of each call: ``audio_id, word``."""
    words = F.split(T.normalize_detect(F.col("text")), " ")
    return texts.select("audio_id", F.explode(words).alias("word")).where("word <> ''").distinct()


def outcomes(reference: DataFrame, automatic: DataFrame, rules: tuple = R.RULES, recognised: DataFrame | None = None) -> DataFrame:
    """Each distinct concept of the reference texts against the automatic texts of its call: ``audio_id, category, mot,
    status, perceived, score``.

    CORRECT where the normalised concept stands in a normalised automatic text, perceived as it is written there (in the
    first such text; as in the reference where only the normalised forms agree); else SUBSTITUTION by a span of a
    recogniser (``recognised``: ``audio_id, text_id, mot, start`` of the automatic texts) of ratio above
    ``LEAST_RATIO``, the first in order of text and place; else by the most similar automatic word (ratio at least ``LEAST_RATIO``, the first in alphabetical order of equals); else DELETION. A concept
    that the automatic transcript splits over two texts is not found in either. The concepts of a call, few and distinct,
    meet its texts in one row a call; only what is left goes to the ratio.
    """
    wanted = distinct_entities(entities(reference, rules)).select("audio_id", "category", "mot")
    wanted = wanted.withColumn("norm", T.normalize_detect(F.col("mot"))).where("norm <> ''")
    per_call = wanted.groupBy("audio_id").agg(F.collect_set("norm").alias("norms"))
    plain = T.strip_accents(F.lower(F.col("text")))
    auto = automatic.where("text IS NOT NULL").select("audio_id", "text_id", "text", plain.alias("plain"), T.normalize_detect(F.col("text")).alias("asr"))
    heard = auto.join(per_call, "audio_id")
    heard = heard.select("audio_id", "text_id", "text", "plain", F.explode(F.filter("norms", lambda n: F.contains(F.col("asr"), n))).alias("norm"))
    at = F.when(F.length("plain") == F.length("text"), F.expr("locate(norm, plain)")).otherwise(0)
    written = F.when(at > 0, F.substr("text", at, F.length("norm")))
    heard = heard.groupBy("audio_id", "norm").agg(F.min(F.struct("text_id", written.alias("written"))).alias("h"))
    heard = heard.select("audio_id", "norm", F.col("h.written").alias("written"), F.lit(True).alias("heard"))
    x = wanted.join(heard, ["audio_id", "norm"], "left")
    lost = x.where("heard IS NULL").select("audio_id", "norm").distinct()
    close = lost.join(vocabulary(automatic), "audio_id")
    # the ratio is at most 2 * shorter / total length: most pairs fall out before Python
    n, m = F.length("norm"), F.length("word")
    close = close.where(2.0 * F.least(n, m) >= LEAST_RATIO * (n + m)).withColumn("r", T.similarity_ratio("norm", "word"))
    w = Window.partitionBy("audio_id", "norm").orderBy(F.desc("r"), "word")
    best = close.where(F.col("r") >= LEAST_RATIO).withColumn("k", F.row_number().over(w)).where("k = 1").select("audio_id", "norm", "word", "r")
    if recognised is not None:
        spans = lost.join(recognised.select("audio_id", "text_id", "start", F.col("mot").alias("word")), "audio_id")
        spans = spans.withColumn("r", T.similarity_ratio("norm", F.lower("word"))).where(F.col("r") > LEAST_RATIO)
        first = spans.groupBy("audio_id", "norm").agg(F.min(F.struct("text_id", "start", "word", "r")).alias("s"))
        first = first.select("audio_id", "norm", F.col("s.word").alias("word"), F.col("s.r").alias("r"))
        best = first.unionByName(best.join(first, ["audio_id", "norm"], "left_anti"))
    x = x.join(best, ["audio_id", "norm"], "left")
    status = F.when(F.col("heard"), "CORRECT").when(F.col("r").isNotNull(), "SUBSTITUTION").otherwise("DELETION")
    return x.select(
        "audio_id", "category", "mot", status.alias("status"), F.when(F.col("heard"), F.coalesce("written", "mot")).otherwise(F.col("word")).alias("perceived"),
        F.when(F.col("heard"), 1.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("score"),
    )


def concept_error_rates(found: DataFrame, by: str = "audio_id") -> DataFrame:
    """Counts of outcomes, ``wer = (S + D) / N`` and ``precision = 100 C / N``."""
    n = F.count("*")
    hit = lambda s: F.count(F.when(F.col("status") == s, 1))
    c, s, d = hit("CORRECT"), hit("SUBSTITUTION"), hit("DELETION")
    return found.groupBy(by).agg(
        n.alias("n"), c.alias("n_correct"), s.alias("n_substituted"), d.alias("n_deleted"), ((s + d) / n).alias("wer"), (100.0 * c / n).alias("precision")
    )


def performance_by_root(found: DataFrame) -> DataFrame:
    """Outcomes by concept root (the category before ``_AUTO``): ``root, n, n_correct, rate, by_source``; ``by_source``
    counts the correct ones by their column ``source`` (``rules`` where there is none)."""
    x = found if "source" in found.columns else found.withColumn("source", F.lit("rules"))
    x = x.withColumn("root", F.split("category", "_AUTO")[0])
    per = x.groupBy("root", "source").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "CORRECT", 1)).alias("c"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("source", "c"))), lambda s: s["c"] > 0)
    out = per.groupBy("root").agg(F.sum("n").alias("n"), F.sum("c").alias("n_correct"), F.map_from_entries(kept).alias("by_source"))
    return out.select("root", "n", "n_correct", F.round(100.0 * F.col("n_correct") / F.col("n"), 6).alias("rate"), "by_source")


def perceived(found: DataFrame, results: DataFrame) -> DataFrame:
    """Entities with ``percu``: whether a correct concept of their call has the same text."""
    ok = results.where("status = 'CORRECT'").select("audio_id", "mot").distinct().withColumn("percu", F.lit(True))
    return found.join(ok, ["audio_id", "mot"], "left").withColumn("percu", F.coalesce("percu", F.lit(False)))


def insertions(reference: DataFrame, automatic: DataFrame, rules: tuple = R.RULES, least: int = 5, stopwords: tuple = STOPWORDS) -> DataFrame:
    """Words of the automatic transcript of a call that its reference has nowhere: ``audio_id, word``; words shorter than
    ``least``, stopwords and words of the call's own concepts are none."""
    words = vocabulary(automatic).join(vocabulary(reference), ["audio_id", "word"], "left_anti")
    own = entities(reference, rules).select("audio_id", F.explode(F.split(T.normalize_detect(F.col("mot")), " ")).alias("word")).distinct()
    words = words.where((F.length("word") >= least) & ~F.col("word").isin(*stopwords))
    called = reference.select("audio_id").distinct()
    return words.join(called, "audio_id", "left_semi").join(own, ["audio_id", "word"], "left_anti")


def gazetteer_matches(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Places named in texts: ``text_id, place, n``. Names (``place``) are compared as sequences of folded words, by one
    equi join with the sequences of every length that a name has; an empty gazetteer matches nothing."""
    names = cut_lineage(places.select(T.folded_words(F.col("place")).alias("place")).where("place <> ''").distinct())
    lengths = sorted(r.n for r in names.select(F.size(F.split("place", " ")).alias("n")).distinct().collect())
    tokens = F.split(T.folded_words(F.col("text")), " ")
    x = texts.select("text_id", tokens.alias("t"))

    def grams_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
        return F.when(F.size("t") >= n, every).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[grams_of(n) for n in lengths or [1]]))
    g = x.where(F.size("t") > 0).select("text_id", F.explode(grams).alias("place"))
    return g.join(names, "place").groupBy("text_id", "place").agg(F.count("*").alias("n"))


def context_tokens(found: DataFrame, texts: DataFrame, words: int = CONTEXT_WORDS) -> DataFrame:
    """Entities with ``tokens``: the folded words of the span and of ``words`` words on either side."""
    x = found.join(texts.select("text_id", "text"), "text_id")
    split = lambda c: F.filter(F.split(T.normalize_display(T.strip_accents(c)), " "), lambda w: w != "")
    before = split(F.substring("text", F.lit(1), F.col("start")))
    after = split(F.expr("substring(text, end + 1, length(text))"))
    own = split(F.expr("substring(text, start + 1, end - start)"))
    last = F.slice(before, F.greatest(F.size(before) - words + 1, F.lit(1)), words)
    return x.withColumn("tokens", F.concat(last, own, F.slice(after, 1, words)))


def _context_words(contexts: DataFrame) -> dict[str, list[tuple[str, float]]]:
    """Words and weights of each context in alphabetical order; a word named twice has the sum of its weights."""
    x = contexts.where("context IS NOT NULL AND word <> '' AND weight IS NOT NULL").groupBy("context", "word").agg(F.sum("weight").alias("weight"))
    rows = x.limit(CONTEXT_ROWS + 1).collect()
    if len(rows) > CONTEXT_ROWS:
        raise ValueError(f"more than {CONTEXT_ROWS} context words")
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.context, r.word)):
        out.setdefault(r.context, []).append((r.word, float(r.weight)))
    return out


def _scores(tokens: Column, strict: bool, contexts: dict[str, list[tuple[str, float]]], stopwords: tuple) -> Column:
    """Array of (context, score, n) of the contexts that hold: score > 0 and at least ``LEAST_HITS`` hits."""
    silent = F.array(*[F.lit(R.fold(w)) for w in stopwords])
    kept = F.filter(tokens, lambda w: ~F.array_contains(silent, w))
    none = F.lit(None).cast("double")

    def listed(words: list) -> Column:
        return F.array(*[F.struct(F.lit(w).alias("w"), F.lit(v).alias("v")) for w, v in words])

    def first_weight(token: Column, words: list) -> Column:
        """Weight of the first word that the token is (strict), or that contains it or is contained in it."""
        if not words:
            return none
        if strict:
            return F.element_at(F.create_map(*[F.lit(x) for w in words for x in w]), token)
        return F.get(F.filter(listed(words), lambda x: F.contains(token, x["w"]) | F.contains(x["w"], token)), F.lit(0))["v"]

    def summed(values: Column) -> tuple[Column, Column]:
        held = F.filter(values, lambda v: v.isNotNull())
        return F.aggregate(held, F.lit(0.0), lambda acc, v: acc + v), F.size(held)

    def weigh(words: list) -> tuple[Column, Column]:
        return summed(F.transform(kept, lambda t: first_weight(t, words)))

    out = []
    for name, words in contexts.items():
        good, bad = [x for x in words if x[1] > 0], [x for x in words if x[1] <= 0]
        (g, n_g), (b, n_b) = weigh(good), weigh(bad)
        score, n = g + b, n_g + n_b
        if not strict and good:
            nexts = F.when(F.size(kept) > 1, F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
            pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), nexts, lambda a, z: F.concat_ws(" ", a, z))
            inside = F.flatten(F.transform(pairs, lambda p: F.filter(listed(good), lambda x: F.contains(p, x["w"]))))
            p, n_p = summed(F.transform(inside, lambda x: 0.5 * x["v"]))
            score, n = score + p, n + n_p
        out.append(F.struct(F.lit(name).alias("context"), F.round(score, 6).alias("score"), n.alias("n")))
    if not out:
        return F.array().cast("array<struct<context:string,score:double,n:int>>")
    return F.filter(F.array(*out), lambda x: (x["score"] > 0) & (x["n"] >= LEAST_HITS))


def context_scores(
    found: DataFrame, texts: DataFrame, contexts: DataFrame, strict: bool = True,
    doubts: tuple[tuple[str, tuple, tuple], ...] = (), stopwords: tuple = CONTEXT_STOPWORDS,
) -> DataFrame:
    """Entities with the contexts around them: ``text_id, category, mot, start, context, context_score, n_contexts,
    confidence, false_positive``; ``context`` is the strongest (null: none; of equals the first by name).

    ``contexts`` (``context, word, weight``) is an input: a positive weight speaks for a context, another against it.
    ``strict`` compares whole words; without it a context word counts when either contains the other (of several the
    first by alphabet, once for and once against), and pairs of neighbouring words count half, once for each word for
    the context they contain. An entity is a likely false positive by a doubt ``(fragment, present, absent)``: its text
    contains the fragment, one of the contexts ``present`` holds (if any is named) and none of ``absent``.
    """
    words = _context_words(contexts)
    x = context_tokens(found, texts).withColumn("c", _scores(F.col("tokens"), strict, words, stopwords))
    total = F.aggregate("c", F.lit(0.0), lambda acc, y: acc + y["score"])
    best = F.array_max(F.transform("c", lambda y, i: F.struct(y["score"].alias("score"), (-i).alias("k"), y["context"].alias("context"))))
    names = F.transform("c", lambda y: y["context"])

    def doubtful(fragment: str, present: tuple, absent: tuple) -> Column:
        holds = lambda which: F.arrays_overlap(names, F.array(*[F.lit(w) for w in which]))
        out = F.contains(F.col("mot"), F.lit(fragment))
        out = out & holds(present) if present else out
        return out & ~holds(absent) if absent else out

    doubt = F.lit(False)
    for d in doubts:
        doubt = doubt | doubtful(*d)
    return x.select(
        "text_id", "category", "mot", "start", best["context"].alias("context"), F.coalesce(best["score"], F.lit(0.0)).alias("context_score"),
        F.size("c").alias("n_contexts"), F.round(F.least(F.greatest(total, F.lit(0.0)) / CONFIDENCE, F.lit(1.0)), 6).alias("confidence"), doubt.alias("false_positive"),
    )


def segment_error_rates(pairs: DataFrame) -> DataFrame:
    """Word error rates of aligned texts (``audio_id, ref, hyp``): per call the mean over segments (``macro_wer``) and
    edits over words (``micro_wer``). Segments whose normalised reference is empty are left out."""
    x = pairs.select("audio_id", T.normalize_detect(F.col("ref")).alias("r"), T.normalize_detect(F.coalesce("hyp", F.lit(""))).alias("h")).where("r <> ''")
    x = x.withColumn("e", T.word_edits("r", "h")).withColumn("n", F.size(F.split("r", " ")))
    return x.groupBy("audio_id").agg(
        F.count("*").alias("n_segments"), F.sum("n").alias("n_words"), F.avg(F.col("e") / F.col("n")).alias("macro_wer"), (F.sum("e") / F.sum("n")).alias("micro_wer")
    )
