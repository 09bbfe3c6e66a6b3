"""Subject areas: mined rules on a small made-up corpus, held-out accuracy, odd cases."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillpanel.llm import subjects as S

TOPICS = {
    "space": (["the orbiter", "a lunar probe", "the docking bay", "solar sails"], ["fired its thrusters", "entered a low orbit", "lost telemetry", "passed the meteor belt"]),
    "food": (["the bakery oven", "a cheese cellar", "sourdough starters", "the noodle stall"], ["ran out of flour", "won a tasting", "added fresh basil", "raised the butter share"]),
}
FILLER = ["Revenue rose to 12 million.", "The board met twice.", "Shares closed higher on Monday.", "A note was added to the file.", "The bakery of ideas stayed shut."]


def _corpus(n, seed, wrong=0.03):
    random.seed(seed)
    docs, labels, truth = [], [], {}
    for k in range(n):
        own = random.choice([[], ["space"], ["food"], ["space", "food"]])
        lines = [f"{random.choice(TOPICS[t][0])} {random.choice(TOPICS[t][1])}.".capitalize() for t in own for _ in range(random.randrange(2, 5))]
        if not own and random.random() < 0.5:
            lines.append("The bakery of ideas stayed shut.")
        lines += random.choices(FILLER, k=4)
        random.shuffle(lines)
        docs.append((k, " ".join(lines), "x"))
        truth[k] = set(own)
        said = own if random.random() > wrong else ["food"]
        labels += [(k, t, 1) for t in said] or [(k, None, 1)]
    return docs, labels, truth


def _frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, subjects string"), spark.createDataFrame(labels, "doc_id long, subject string, text int")


def test_rules_find_the_subjects_of_unlabelled_documents(spark):
    docs, labels, truth = _corpus(400, 1)
    d, lab = _frames(spark, docs, [x for x in labels if x[0] < 300] + labels[:20] + [(9999, "space", 1), (None, "food", 1), (1, "nonsense", 1)])
    rules = S.mine(d, lab, ["food", "space"])
    got = {k: set() for k in truth}
    for r in S.assign(d, rules).collect():
        got[r["doc_id"]].add(r["subject"])
    assert sum(got[k] == truth[k] for k in truth if k >= 300) >= 95


def test_odd_documents(spark):
    docs, labels, _ = _corpus(200, 2)
    d, lab = _frames(spark, docs, labels)
    rules = S.mine(d, lab, ["food", "space"])
    about = "The orbiter fired its thrusters. A lunar probe entered a low orbit."
    odd = [(1, None, ""), (2, "", ""), (3, " \n ", ""), (4, about, ""), (5, about, ""), (6, "Nothing here. " * 50_000 + about, ""), (None, about, ""), (7, "The orbiter fired its thrusters.", "")]
    got = sorted((r["doc_id"], r["subject"]) for r in S.assign(_frames(spark, odd, [])[0], rules).collect())
    assert got == [(4, "space"), (5, "space"), (6, "space")]


def test_no_labels_and_no_documents(spark):
    docs, labels, _ = _corpus(20, 3)
    d, none = _frames(spark, docs, [])
    assert S.assign(d, S.mine(d, none, ["food"])).collect() == []
    nothing, lab = _frames(spark, [], labels)
    assert S.assign(nothing, S.mine(nothing, lab, ["food"])).collect() == []


def test_makeup(spark):
    d = spark.createDataFrame([(1,), (2,)], "doc_id long")
    a = spark.createDataFrame([(1, "food")], "doc_id long, subject string")
    s = spark.createDataFrame([("food",), ("space",), ("food",)], "subject string")
    assert sorted(tuple(r) for r in S.makeup(d, a, s).collect()) == [("food", 1, 0.5), ("space", 0, 0.0)]


def test_sentences():
    assert S.sentences("One two. <p>Three; four</p> 5 6.") == [["one", "two"], ["three", "four"]]
    assert S.sentences(None) == S.sentences("") == S.sentences(" \n\n 12. ") == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB.!?…\"') \n\t1,-\0<>/p_"), max_size=60))
def test_ascii_texts_are_cut_the_same_way(text):
    """A letter beyond ASCII at the end takes the other path."""
    other = S.sentences(text + ". é")
    assert other[-1] == ["é"] and S.sentences(text + ". e") == [*other[:-1], ["e"]]


def test_exceptions_silence_a_rule():
    r = S.Rules({"bakery": 0, "ideas": 1}, {frozenset([0]): [("food", 2.0)]}, {frozenset([0]): {"food": [frozenset([0, 1])]}}, 1.0).index()
    assert r.evidence(["bakery", "bakery"]) == {"food": 2.0}
    assert not r.evidence(["bakery", "ideas"])


def test_patterns_are_those_of_plain_counting(spark):
    """Every pattern grown has the counts of a plain search, and none that may be a rule is missing, whichever shard it is grown in."""
    random.seed(4)
    words = [chr(97 + k) for k in range(24)]
    docs = []
    for k in range(300):
        own = random.choice([["x"], ["y"], ["x", "y"], []])
        docs.append((k, [sorted({random.choice(words[:8] if "x" in own and random.random() < 0.7 else words) for _ in range(5)}) for _ in range(3)], own))
    sentences = [(frozenset(ws), own) for _, ss, own in docs for ws in ss]
    rank = {w: i for i, w in enumerate(words)}
    n = np.array([[sum(w in s for s, _ in sentences), *(sum(w in s and c in own for s, own in sentences) for c in "xy")] for w in words], float)
    sure = (n[:, 1:] + 0.5) / (n[:, :1] + 1)
    points = sure >= S.POINTS
    # All words but the first four may be what a pattern is grown from.
    units = spark.createDataFrame([("\n".join(" ".join(ws) for ws in ss), own) for _, ss, own in docs], "cut string, subjects array<string>")
    rows = (
        units.mapInArrow(S._transactions(rank, 4, {"x": 0, "y": 1}), "shard int, items array<int>, classes array<int>")
        .groupBy("shard").applyInArrow(S._grow(4, sure, points, 4), "items array<int>, n double, joint array<double>").collect()
    )
    got = {frozenset(r["items"]): (r["n"], *r["joint"]) for r in rows}
    assert len(got) == len(rows) > 0
    single = np.where((sure >= S.SURE) & points, sure, 0.0)
    for size in (2, 3):
        for x in itertools.combinations(range(24), size):
            if max(x) < 4:
                continue
            held = [own for s, own in sentences if {words[i] for i in x} <= s]
            counts = (len(held), sum("x" in o for o in held), sum("y" in o for o in held))
            if frozenset(x) in got:
                assert got[frozenset(x)] == counts
            for c in range(2):
                conf = (counts[1 + c] + 0.5) / (counts[0] + 1)
                general = max(single[i, c] for i in x)
                rule = conf >= S.SURE and all(points[i, c] and i >= 4 for i in x) and (not general or conf > general + S.SURER)
                if counts[0] >= 4 and (rule or (general and conf < S.AGAINST)):
                    assert frozenset(x) in got, (x, c)


def test_words_of_few_labelled_documents_are_mined_again(spark):
    """Sentences in another language occur in one labelled document, and beside known ones in many that are not labelled."""
    docs, labels, _ = _corpus(300, 6)
    foreign = ["Die Sonde zündet ihre Düsen.", "Das Segel fängt Wind."]
    about = "The orbiter fired its thrusters. A lunar probe entered a low orbit. "
    docs += [(1000 + k, about + " ".join(foreign), "x") for k in range(40)]
    labels.append((1000, "space", 1))
    d, lab = _frames(spark, docs, labels)
    rules = S.mine(d, lab, ["food", "space"])
    only = _frames(spark, [(1, " ".join(foreign), ""), (2, "Der Hund schläft. Die Katze auch.", "")], [])[0]
    assert [tuple(r) for r in S.assign(only, rules).collect()] == [(1, "space")]
    assert [tuple(r) for r in S.assign(only, S.mine(d, lab, ["food", "space"], max_labelled=301)).collect()] == []


def test_quality_on_held_out_documents(spark):
    docs, labels, _ = _corpus(400, 7, wrong=0)
    d, lab = _frames(spark, docs, labels)
    rules, cut = S.learned(d, lab, ["food", "space"])
    assert {r[0] for r in cut.select("kind").distinct().collect()} == {"mined", "held"}
    (r,) = S.quality(rules, cut.where("kind = 'held'").select(F.lit("en").alias("lang"), "subjects", "cut")).collect()
    assert r["recall"] > 0.95 and r["precision"] > 0.95 and r["n_documents"] == cut.where("kind = 'held'").count()
