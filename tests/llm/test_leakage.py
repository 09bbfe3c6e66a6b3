"""Leakage: the index against plain searches, the operator against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillpanel.llm import leakage as L

texts = st.lists(st.integers(1, 4), max_size=80)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_suffix_array(text):
    t = np.array([*text, 0])
    assert L.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@settings(max_examples=80, deadline=None)
@given(texts, st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=10))
def test_search_and_locate(text, phrases):
    t = np.array([*text, 0])
    index = L.FMIndex(t, 6)
    low, high = index.search(np.array(phrases))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_long_repeats_are_sorted():
    t = np.array([1, 2] * 3000 + [0])
    sa = L.suffix_array(t)
    rank = np.empty(len(t), int)
    rank[sa] = np.arange(len(t))
    assert rank[0] > rank[2] and sorted(sa.tolist()) == list(range(len(t)))


def test_words():
    assert L.words("The <b>U.S.</b> rate: 1,234.5%\nIt’s one-time") == ["the", "u", "s", "rate", "12345", "its", "one", "time"]
    assert L.words(None) == L.words("") == L.words(" .. ") == []


def test_only_tags_are_markup():
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    assert L.words(f"<{' '.join(passage)}>") == passage
    assert L.words("<Alas poor yorick>") == ["alas", "poor", "yorick"] and L.words("a <fox> b") == ["a", "fox", "b"]
    assert L.words("sales < 5 million and the profit > 3") == "sales 5 million and the profit 3".split()
    assert L.words("if a<b and c>d then") == "if a b and c d then".split()
    assert L.words("x <p> y</p><br/>z <A HREF='u v' rel=me >w</a>") == ["x", "y", "z", "w"]
    assert L.words(f'one <img src="{"x" * 500}"> two') == ["one", "two"]
    assert L.words(f'<img alt="{" ".join(passage)}">')[-14:] == passage
    assert L.words("<!-- a hidden note --> b") == ["a", "hidden", "note", "b"]


def test_characters_in_one_form():
    assert L.words("Caf\u00e9 \ufb01rst \uff26ull") == L.words("Cafe\u0301 first Full") == ["caf\u00e9", "first", "full"]


def test_long_texts_give_the_same_numbers():
    text = "A <b>word</b>, 1,234 or fi\ufb01 two. " * 50
    number = {w: k + 3 for k, w in enumerate(sorted(set(L.words(text)))[::2])}
    assert L._numbers(text, number, 100).tolist() == L._numbers(text, number).tolist()


def _brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = L.words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, u in items:
            v = L.words(u)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def _spans(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, source string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in L.leaked_spans(d, i, **options).collect()]


def _vocabulary(n, size=400):
    return [" ".join(random.choice("abcdefg") + str(random.randrange(9)) for _ in range(random.randrange(size))) for _ in range(n)]


def test_matches_brute_force(spark):
    random.seed(6)
    items = list(enumerate(_vocabulary(30, 60)))
    docs = list(enumerate(_vocabulary(60)))
    for k in range(40):
        d, i = random.randrange(60), random.randrange(30)
        w = items[i][1].split()
        a, b = sorted((random.randrange(len(w) + 1), random.randrange(len(w) + 1)))
        docs[d] = (d, docs[d][1] + " " + ", ".join(w[a:b]).upper() + ". " + docs[(d + 1) % 60][1])
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    items += [(100, None), (101, ""), (102, "too short"), (103, items[0][1])]
    for options in ({"phrase": 5}, {"phrase": 5, "shard_words": 50, "block_chars": 500}, {"phrase": 13}):
        got = _spans(spark, docs, items, **options)
        assert {(d, i) for d, i, _, _ in got} == _brute([x for x in docs if x[1]], [x for x in items if x[1]], options["phrase"])
        assert len(got) == len(set(got))


def test_spans_are_merged_and_whole(spark):
    item = " ".join(f"w{k}" for k in range(40))
    text = "x y z " + item + " x " + " ".join(f"w{k}" for k in range(5, 20))
    assert sorted(_spans(spark, [(1, text)], [(7, item)])) == [(1, 7, 3, 42), (1, 7, 44, 58)]


def test_a_very_long_document(spark):
    item = " ".join(f"w{k}" for k in range(20))
    text = "filler words " * 100_000 + item + " more" * 100_000
    assert _spans(spark, [(1, text), (2, "short")], [(7, item)], shard_words=10_000) == [(1, 7, 200_000, 200_019)]


def test_parts_of_a_long_document_lose_nothing(spark):
    random.seed(8)
    item = " ".join(f"w{k}" for k in range(60))
    text = " ".join(random.choice("xyz") for _ in range(95)) + " " + item + " " + " ".join(random.choice("xyz") for _ in range(60))
    for words in (10, 17, 30, 70):
        assert _spans(spark, [(1, text)], [(7, item)], shard_words=words) == [(1, 7, 95, 154)]


def test_empty(spark):
    assert _spans(spark, [], [(1, "a b")]) == [] and _spans(spark, [(1, "a b")], []) == []
