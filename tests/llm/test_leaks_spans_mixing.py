import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from parolis.llm.leaks import Bm25Index, leaked_items
from parolis.llm.mixing import fit_lengths, mix_sources, valid_plans
from parolis.llm.shared_spans import difference_cover, shared_share, shared_spans
from parolis.llm.words import words_of

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id int"


def grams(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_words():
    assert words_of("L'Œuvre ÉTÉ_2 ﬁn² é!") == ["l", "oeuvre", "ete", "2", "fin2", "e"] and words_of(None) == []


@pytest.mark.parametrize("shard_items", [5, 2048])
def test_leaks_against_brute_force(spark, shard_items):
    r = random.Random(1)
    vocab = [f"mot{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(3, 25))), 0) for i in range(30)]
    docs = []
    for d in range(150):
        w = r.choices(vocab + ["x", "y"], k=r.randint(0, 120))
        if r.random() < 0.5:
            src = words_of(r.choice(items)[1])
            a = r.randint(0, len(src) - 1)
            at = r.randint(0, len(w))
            w[at:at] = src[a : a + r.choice([6, 7, 8, 9, 20])]
        docs.append((d, " ".join(w).upper().replace("X", " ,x; "), "z"))
    docs += docs[:5] + [(900, None, "z"), (None, items[0][1], "z"), (901, "", "z")]
    want = {(d, i) for d, t, _ in docs for i, u, _ in items if d is not None and grams(t, 8) & grams(u, 8)}
    got = rows(leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), n=8, shard_items=shard_items))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_threshold_is_a_lower_bound_and_long_texts():
    r = random.Random(2)
    items = [(i, " ".join(r.choices("abcdefghijklmnop", k=20))) for i in range(20)]
    index = Bm25Index(items, 12)
    text = "zz " * 5000 + items[3][1] + " zz" * 5000
    assert (0, 3) in index.search([text])
    assert Bm25Index([], 12).search(["a b c"]) == [] and Bm25Index([(1, "a b")], 12).search(["a b c"]) == []


def test_retrieval_equals_full_scoring_and_reads_few_postings():
    r = random.Random(3)
    vocab = [f"common{i % 25}" for i in range(4000)] + [f"rare{i}" for i in range(4000)]
    index = Bm25Index([(i, " ".join(r.choices(vocab, k=r.randint(12, 40)))) for i in range(3000)], 12)
    full = np.zeros((len(index.first) - 1, len(index.item_ids)))
    full[index.key // index.size, index.item] = index.impact
    passages = [[int(w) for w in r.choice(index.words)[:30]] for _ in range(60)] + [r.choices(range(len(full)), k=r.randint(12, 64)) for _ in range(200)]
    want = {(p, i) for p, w in enumerate(passages) for i in np.flatnonzero(full[sorted(set(w))].sum(axis=0) >= 0.999)}
    got = index.retrieve(passages)
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 60
    assert index.read < 0.2 * index.queried


@pytest.mark.parametrize("shard_items", [700, 16_384])
def test_many_items_in_one_scan(spark, shard_items):
    r = random.Random(4)
    vocab = [f"m{i}" for i in range(5000)]
    items = [(i, " ".join(r.choices(vocab, k=15)), 0) for i in range(5000)]
    docs = [(d, " ".join(r.choices(vocab, k=40) + items[d][1].split()[:13] + r.choices(vocab, k=40)), "z") for d in range(300)]
    out = leaked_items(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), shard_items=shard_items)
    assert set(rows(out)) == {(d, d) for d in range(300)} and out.count() == 300
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_answers(spark):
    question = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, question, "blue green"), (2, question + " more", None), (3, question + " less", "")]
    items = spark.createDataFrame(items, "item_id bigint, q string, a string")
    docs = spark.createDataFrame([(1, "well " + question + " is green", "z"), (2, question.upper() + ": blue, green!", "z"), (3, "blue green", "z")], DOCS)
    got = {(x.doc_id, x.item_id): x.answer_share for x in leaked_items(docs, items, item_text="q", answer="a").collect()}
    assert got == {(1, 1): 0.5, (1, 2): None, (1, 3): None, (2, 1): 1.0, (2, 2): None, (2, 3): None}


def test_no_leaks_in_empty_tables(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaked_items(d, i).count() == 0


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_difference_cover(q):
    v, cover = difference_cover(q)
    assert v == q * q + q + 1 and len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


def stretches(docs, length):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in docs:
        spans = []
        for i in range(len(t or "") - length + 1):
            if d is not None and len(where[t[i : i + length]] - {None}) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out |= {(d, a, b) for a, b in spans}
    return out


def span_documents(seed=3):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdéœ😀 ") for _ in range(n))
    shared = [noise(n) for n in (99, 100, 101, 150, 260)]
    docs = [(i, noise(r.randint(0, 200)) + r.choice(shared) + noise(r.randint(0, 150)) + r.choice(shared)) for i in range(25)]
    docs += [(100, shared[4] * 2), (101, docs[0][1]), (102, docs[0][1]), (103, docs[1][1][:170]), (104, None), (105, ""), (106, "x" * 400), (107, "y" * 90)]
    return docs + docs[:3]


@pytest.mark.parametrize("length", [100, 101, 150])
@pytest.mark.parametrize("ways", [{}, {"broadcast_rows": 0}, {"hot_chars": 400}, {"broadcast_rows": 0, "hot_chars": 0}])
def test_spans_against_brute_force(spark, length, ways):
    docs = span_documents()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, pos int").repartition(3)
    got = rows(shared_spans(df, length=length, **ways), "doc_id", "char_start", "char_end")
    assert len(got) == len(set(got)) and set(got) == stretches(docs, length)


def test_boilerplate_in_every_document_and_long_text(spark):
    head = "".join(random.Random(8).choice("abcdef ") for _ in range(300))
    docs = [(i, head + str(i) * 20) for i in range(200)] + [(999, "q" * 3 + head + "".join(random.Random(9).choice("ghij") for _ in range(1_200_000)))]
    got = {(r.doc_id, r.char_start, r.char_end) for r in shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert (999, 3, 303) in got and all(b >= 300 for d, a, b in got) and len({d for d, _, _ in got}) == 201


def test_shares(spark):
    docs = [(1, "ab" * 80), (2, "ab" * 80), (3, "z" * 10), (4, ""), (5, None)]
    got = rows(shared_share(spark.createDataFrame(docs, "doc_id bigint, text string"), length=100))
    assert got == [(1, 160, 160, 1.0), (2, 160, 160, 1.0), (3, 10, 0, 0.0), (4, 0, 0, 0.0)]
    assert shared_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), min_size=1, max_size=8), st.integers(0, 4000), st.integers(1, 4), st.integers(0, 3))
def test_fit_is_exact_where_a_sum_exists(counts, budget, cap, seed):
    fit = fit_lengths(counts, budget, cap, seed)
    whole = sum(n * c for n, c in counts.items())
    assert fit.tokens == fit.passes * whole + sum(n * c for n, c in fit.extra.items()) <= budget
    assert fit.passes + bool(fit.extra) <= cap and all(0 <= c <= counts[n] for n, c in fit.extra.items())
    if whole <= budget * 1 and budget >= cap * whole:
        assert fit.tokens == cap * whole
    rest, left = budget - fit.tokens, {n: c - fit.extra.get(n, 0) for n, c in counts.items()}
    if fit.passes < cap and whole * fit.passes < budget:
        assert not any(n <= rest and c > 0 for n, c in left.items())  # nothing more fits


def test_dirty_plans():
    plans = [(1, "a", 2.0, 3), (1, "a", 1.0, 2), (1, "b", 1.0, None), (1, "c", None, 2), (1, None, 0.5, 1), (2, "a", -1.0, 1), (None, "a", 1.0, 1), (3, "z", float("nan"), 1)]
    assert valid_plans(plans) == {1: {"a": (0.75, 2), "b": (0.25, 1)}}


def test_mix_keeps_caps_and_shares(spark):
    r = random.Random(5)
    docs = [(i, " ".join(["mot"] * r.randint(1, 30)), r.choice("aaab")) for i in range(400)] + [(900, None, "a"), (901, "", "b"), (902, "mot", None), (None, "mot", "a")]
    docs += docs[:7]
    plan = spark.createDataFrame([(1, "a", 0.3, 1), (1, "b", 0.7, 3), (1, "none", 0.2, 2), (2, "a", 1.0, 2)], "plan_id int, source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumnRenamed("x", "y")
    choice, report = mix_sources(df, plan)
    got = choice.collect()
    assert len({(r.plan_id, r.doc_id) for r in got}) == len(got)
    assert max(r.repeats for r in got if r.source == "b") <= 3 and max(r.repeats for r in got if r.plan_id == 1 and r.source == "a") == 1
    share = {(r.plan_id, r.source): r.share for r in report.collect()}
    assert share[1, "a"] == pytest.approx(0.3, abs=0.002) and share[1, "b"] == pytest.approx(0.7, abs=0.002) and share[1, "none"] == 0
    aim = {(r.plan_id, r.source): (r.target_share, r.effective_share) for r in report.collect()}
    assert aim[1, "none"] == (0.166667, 0.0) and aim[1, "a"] == (0.25, 0.3) and all(abs(share[k] - e) < 0.002 for k, (_, e) in aim.items())
    assert share[2, "a"] == 1.0 and all(r.repeats == 2 for r in got if r.plan_id == 2)
    again = {(r.plan_id, r.doc_id, r.repeats) for r in mix_sources(df.repartition(7), plan)[0].collect()}
    assert again == {(r.plan_id, r.doc_id, r.repeats) for r in got}
    empty, _ = mix_sources(df.limit(0), plan)
    assert empty.count() == 0


def test_the_choice_is_kept_at_the_token(spark):
    """Shares by brute force over the choice, caps over all rows, the vocabulary read by the driver alone."""
    r = random.Random(9)
    docs = [(i, " ".join(["mot"] * r.choice([1, 2, 3, 50, 400])), r.choice("aaaaaabc")) for i in range(900)]
    plan = [(1, "a", 0.2, 1), (1, "b", 0.5, 4), (1, "c", 0.3, 2), (2, "b", 0.01, 1), (2, "c", 0.99, 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    choice, report = mix_sources(df, spark.createDataFrame(plan, "plan_id int, source string, target_share double, max_repeats int"), total_tokens=9_000)
    used = {}
    for x in choice.collect():
        assert x.repeats <= {(p, s): c for p, s, _, c in plan}[x.plan_id, x.source]
        used[x.plan_id, x.source] = used.get((x.plan_id, x.source), 0) + x.repeats * x.n_tokens
    for x in report.collect():
        assert x.tokens == used.get((x.plan_id, x.source), 0)
        assert x.tokens in (int(9_000 * x.target_share + 1e-6), x.max_repeats * sum(t.count("mot") for _, t, s in docs if s == x.source))
