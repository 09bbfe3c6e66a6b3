"""Subject areas of documents by class-association rules.

Sentences of a bounded sample of labelled documents are transactions of words
and of their document's subjects. Parallel FP-growth finds the itemsets that
matter: every shard of items gets the sentences that hold one of its items and
grows patterns of up to three items from their conditional bases, never longer
ones. Itemsets with a subject give rules. A rule that is no surer than a more
general one is redundant and goes; an itemset that contradicts a more general
rule (a word in passing, a figure of speech) is kept as that rule's exception.
A sentence's evidence for a subject is the sum of the weights of the rules it
matches; how much evidence makes a sentence report on a subject is calibrated on
labelled documents held out from mining. Words that few labelled documents have
are mined a second time, together with documents that the first rules find
subjects in. Every document is then scored in one map over the corpus.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.markup import TAG
from quillpanel.runtime import write_table

#: Documents that rules are mined from and calibrated on, at most.
MAX_LABELLED = 20_000
#: A document needs so many sentences that report on a subject.
SENTENCES = 2
#: Confidence from which an itemset is a rule, from which each of its items must point to the rule's subject, and below which it contradicts a rule.
SURE, POINTS, AGAINST = 0.8, 0.6, 0.5
#: Documents in which an itemset must occur for either.
DOCUMENTS = 4
#: Labelled documents from which a word has said what it says; rarer ones are mined again with documents that are not labelled.
ENOUGH = 16
#: A rule must be surer than more general ones by so much.
SURER = 0.05
#: Shards that itemsets are grown in.
SHARDS = 16

_END = re.compile(r"[.!?…][\"”’)\]]*\s+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII letters stay, ends of sentences become line ends, all else blanks.
_LETTERS = "".join("\n" if c == "\0" else c if c.isalpha() else " " for c in map(chr, range(128)))


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, lower case and in order; null and blank texts have none."""
    if not text:
        return []
    text = text.lower()
    if "<" in text:
        text = TAG.sub("\n\n", text)
    cut = _END.split(text)
    if text.isascii():  # the same words, without a pattern
        found = [s.split() for s in "\0".join(s.replace("\0", " ") for s in cut).translate(_LETTERS).split("\n")]
    else:
        found = [_WORD.findall(s) for s in cut]
    return [ws for ws in found if ws]


@dataclass
class Rules:
    """What scoring needs: words by item, rules and exceptions by item, and the calibrated threshold."""

    item: dict[str, int] = field(default_factory=dict)
    #: antecedent (one or more items) -> [(subject, weight)]
    weights: dict[frozenset, list[tuple[str, float]]] = field(default_factory=dict)
    #: antecedent -> subject -> larger itemsets that contradict it
    exceptions: dict[frozenset, dict[str, list[frozenset]]] = field(default_factory=dict)
    threshold: float = math.inf

    def index(self) -> Index:
        return Index(self)

    def of(self, words: frozenset[str]) -> Rules:
        """The rules that speak of ``words`` only."""
        held = {i for w, i in self.item.items() if w in words}
        return Rules(
            {w: i for w, i in self.item.items() if i in held}, {x: v for x, v in self.weights.items() if x <= held},
            {x: {c: [e for e in es if e <= held] for c, es in by.items()} for x, by in self.exceptions.items() if x <= held}, self.threshold,
        )

    def joined(self, more: Rules) -> Rules:
        """These rules and those of ``more``, which are about other words."""
        base = 1 + max(self.item.values(), default=-1)
        move = lambda x: frozenset(i + base for i in x)
        return Rules(
            {w: i + base for w, i in more.item.items()} | self.item, self.weights | {move(x): v for x, v in more.weights.items()},
            self.exceptions | {move(x): {c: [move(e) for e in es] for c, es in by.items()} for x, by in more.exceptions.items()}, self.threshold,
        )


class Index:
    """Rules laid out for scoring: only words that a rule or an exception speaks of are looked up."""

    def __init__(self, rules: Rules):
        self.threshold = rules.threshold
        held = {i for x in rules.weights for i in x} | {i for by in rules.exceptions.values() for es in by.values() for e in es for i in e}
        self.item = {w: i for w, i in rules.item.items() if i in held}
        self.of: dict[int, list[tuple]] = defaultdict(list)
        for x, weights in rules.weights.items():
            against = rules.exceptions.get(x, {})
            self.of[min(x)].append((x, [(c, w, against.get(c, ())) for c, w in weights]))

    def evidence(self, words: Sequence[str]) -> dict[str, float]:
        """Per subject the weights of the rules matched; a rule counts as often as the sentence has different words of its items."""
        get, count = self.item.get, {}
        for w in set(words):
            i = get(w)
            if i is not None:
                count[i] = count.get(i, 0) + 1
        total: dict[str, float] = {}
        items = count.keys()
        for i in count:
            for x, weights in self.of.get(i, ()):
                if len(x) == 1:
                    times = count[i]
                elif x <= items:
                    times = sum(count[j] for j in x) / len(x)
                else:
                    continue
                for subject, weight, against in weights:
                    if not any(e <= items for e in against):
                        total[subject] = total.get(subject, 0.0) + weight * times
        return total

    def subjects(self, found: Sequence[Sequence[str]], threshold: float | None = None) -> list[str]:
        """The subjects that enough of the sentences report on, in order."""
        least = self.threshold if threshold is None else threshold
        count: dict[str, int] = {}
        for words in found:
            for subject, e in self.evidence(words).items():
                if e >= least:
                    count[subject] = count.get(subject, 0) + 1
        return sorted(s for s, n in count.items() if n >= SENTENCES)


def mine(documents: DataFrame, labels: DataFrame, subjects: Sequence[str], max_labelled: int = MAX_LABELLED, support: float = 2e-4, least_count: int = 4) -> Rules:
    """Rules mined from at most ``max_labelled`` labelled documents (those with the least hash of their id).

    ``documents`` is ``(doc_id, text)``, ``labels`` is ``(doc_id, subject)``; a
    null subject says the document has none. Labels of unknown subjects or
    documents are set aside. Without labels there are no rules. Where there are
    fewer labelled documents, others fill the sample up for the second mining.
    """
    return learned(documents, labels, subjects, max_labelled, support, least_count)[0]


def learned(documents: DataFrame, labels: DataFrame, subjects: Sequence[str], max_labelled: int = MAX_LABELLED, support: float = 2e-4, least_count: int = 4) -> tuple[Rules, DataFrame]:
    """``mine``, with the sample it learned from, cut into sentences: ``(doc_id, kind, subjects, cut)``.

    ``kind`` is ``mined``, ``held`` (out, for calibration) or ``other`` (not labelled).
    """
    subjects = list(subjects)
    known = F.col("subject").isin(subjects)
    documents, labels = documents.select("doc_id", "text"), labels.select("doc_id", "subject")
    per_doc = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(known, F.col("subject")))).alias("subjects"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    held = F.when(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0, "held").otherwise("mined")
    sample = write_table(per_doc.orderBy(*order).limit(max_labelled).select("doc_id", held.alias("kind"), "subjects"), "labelled")  # at most max_labelled short rows
    room = max_labelled - sample.count()
    others = documents.where("doc_id is not null").select("doc_id").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti").orderBy(*order).limit(max(0, room))
    chosen = sample.unionByName(others.select("doc_id", F.lit("other").alias("kind"), F.array().cast("array<string>").alias("subjects")))
    texts = documents.join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "kind", "subjects", "text")
    cut = write_table(texts.mapInArrow(_cut, "doc_id bigint, kind string, subjects array<string>, cut string"), "sentences")
    mined = cut.where("kind = 'mined'").select("doc_id", "cut", "subjects")
    rules, common = grown(mined, subjects, support, least_count)
    rules.threshold = _calibrated(rules, cut.where("kind = 'held'"))
    found = cut.where("kind = 'other'").select("doc_id", "cut").mapInArrow(_found_by(rules), "doc_id bigint, cut string, subjects array<string>")
    more, _ = grown(mined.unionByName(found), subjects, support, least_count, common)
    return rules.of(common).joined(more), cut


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as lines of words, a line a sentence, so that they are cut once."""
    for b in batches:
        lines = ["\n".join(" ".join(ws) for ws in sentences(t.as_py())) for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lines, pa.string())], ["doc_id", "kind", "subjects", "cut"])


def _lines(cut: str) -> list[list[str]]:
    return [s.split(" ") for s in cut.split("\n")] if cut else []


def _found_by(rules: Rules):
    """Documents that the rules find subjects in, with these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = rules.index()
        for b in batches:
            rows = [(d, c, s) for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (s := index.subjects(_lines(c)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["doc_id", "cut", "subjects"])

    return run


_MASK = (1 << 63) - 1


def _count(subjects: list[str], but: frozenset[str]):
    """Per word its sentences, those with each subject, its documents, and a mark of which sentences they are; as the word '' all sentences."""
    place = {c: k for k, c in enumerate(subjects)}
    width = len(subjects) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = {}
        for b in batches:
            for doc, cut, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = [2 + place[c] for c in cs]
                lines = _lines(cut)
                for w in ("", *set().union(*lines).difference(but)):
                    if w not in tally:
                        tally[w] = [0] * width
                    tally[w][-1] += 1
                for n, ws in enumerate(lines):
                    mark = ((doc * 1_000_003 + n) * 0x9E3779B97F4A7C15 & _MASK) * 0xC2B2AE3D27D4EB4F >> 17 & _MASK
                    for w in ("", *set(ws).difference(but)):
                        row = tally[w]
                        row[0] += 1
                        row[1] ^= mark
                        for k in own:
                            row[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([r[1] for r in tally.values()], pa.int64()), pa.array([[r[0], *r[2:]] for r in tally.values()], pa.list_(pa.int64()))], ["word", "mark", "n"])

    return run


def grown(units: DataFrame, subjects: list[str], support: float, least_count: int, but: frozenset[str] = frozenset()) -> tuple[Rules, frozenset[str]]:
    """Rules of ``units`` ``(doc_id, cut, subjects)`` on words other than ``but``, and the words that it has enough documents of.

    Words, itemsets and their counts come from a bounded sample and so are bounded.
    """
    width = len(subjects) + 2
    rows = units.mapInArrow(_count(subjects, but), "word string, mark bigint, n array<bigint>")
    found = rows.groupBy("word").agg(F.expr("bit_xor(mark)").alias("mark"), *[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(width)]).where(F.col("n0") >= F.when(F.col("word") != "", least_count).otherwise(0)).collect()  # words of the bounded sample
    counts = {r["word"]: (r["mark"], *[r[f"n{k}"] for k in range(width)]) for r in found}
    n = counts.pop("", (0,) * (width + 1))
    least = max(least_count, math.ceil(support * n[1]))
    rules, groups, stats = Rules(), {}, []
    for w in sorted(counts):
        _, k, *by, _ = counts[w]
        if k < least:
            continue
        lift = max((c / k / (a / n[1]) for c, a in zip(by, n[2:-1]) if a), default=0)
        if k > 0.05 * n[1] and lift < 2 and max(by, default=0) < SURE * k:
            continue  # says nothing and is everywhere
        # Words that occur in the very same sentences are one item.
        rules.item[w] = groups.setdefault(counts[w], len(groups))
        if rules.item[w] == len(stats):
            stats.append((k, *by))
    common = frozenset(w for w, c in counts.items() if c[1] >= least and c[-1] >= ENOUGH)
    if not stats:
        return rules, common
    single = np.array(stats, np.float64)
    sure = (single[:, 1:] + 0.5) / (single[:, :1] + 1)
    points = sure >= POINTS
    # Items in the order of growing: those that point to a subject last, so that each pattern is grown from one of them.
    pointing = (single[:, 1:] >= POINTS * single[:, :1]).any(axis=1)
    rank = np.empty(len(stats), np.int64)
    rank[np.lexsort((-single[:, 0], pointing))] = np.arange(len(stats))
    of_rank = np.argsort(rank)
    first = int((~pointing).sum())
    by_rank = {w: int(rank[i]) for w, i in rules.item.items()}
    patterns = (
        units.select("cut", "subjects").mapInArrow(_transactions(by_rank, first, {c: k for k, c in enumerate(subjects)}), "shard int, items array<int>, classes array<int>")
        .groupBy("shard").applyInArrow(_grow(first, sure[of_rank], points[of_rank], least), "items array<int>, n double, joint array<double>").collect()  # patterns of the bounded sample
    )
    kept: dict[frozenset, dict[int, float]] = defaultdict(dict)
    for i in range(len(stats)):
        for c in np.flatnonzero((sure[i] >= SURE) & points[i] & pointing[i]).tolist():
            kept[frozenset([i])][c] = float(sure[i, c])
    several = {frozenset(int(of_rank[r]) for r in p["items"]): (p["n"], p["joint"]) for p in patterns}
    conf = {x: [(j + 0.5) / (k + 1) for j in joint] for x, (k, joint) in several.items()}
    for x in sorted(conf, key=lambda x: (len(x), sorted(x))):
        for c, p in enumerate(conf[x]):
            general = [kept[y][c] for y in _parts(x) if c in kept.get(y, ())]
            if p >= SURE and all(points[i, c] and pointing[i] for i in x) and (not general or p > max(general) + SURER):
                kept[x][c] = p
    against = [(y, c, x) for x, ps in conf.items() for y in _parts(x) for c in kept.get(y, ()) if ps[c] < AGAINST]
    # Sentences of a document are alike; documents are what makes an itemset sure.
    seen = _by_document(units, rules.item, [*kept, *{x for _, _, x in against}], subjects)
    for y, c, x in against:
        n_docs, n_joint = seen.get(x, (0, {}))[0], seen.get(x, (0, {}))[1].get(subjects[c], 0)
        if n_docs > DOCUMENTS and _bound(n_joint, n_docs, 1.0) < AGAINST:
            rules.exceptions.setdefault(y, {}).setdefault(subjects[c], []).append(x)
    base = math.log(SURE / (1 - SURE))
    for x, cs in kept.items():
        n_docs, n_joint = seen.get(x, (0, {}))
        weights = [(subjects[c], math.log(p / (1 - p)) - base + 0.1) for c, p in cs.items() if n_docs >= DOCUMENTS and _bound(n_joint.get(subjects[c], 0), n_docs, -1.0) >= AGAINST]
        if weights:
            rules.weights[x] = weights
    return rules, common


def _transactions(rank: dict[str, int], first: int, place: dict[str, int]):
    """Group-dependent transactions: a sentence's items, in the order of growing, for every shard that one of its pointing items belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, items, classes = [], [], []
            for cut, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = [place[c] for c in cs]
                for ws in _lines(cut):
                    found = sorted({i for w in ws if (i := rank.get(w)) is not None})
                    upto = {}  # shard -> items up to the last that it grows from
                    for k, i in enumerate(found):
                        if i >= first:
                            upto[i % SHARDS] = k + 1
                    for s, k in upto.items():
                        shards.append(s)
                        items.append(found[:k])
                        classes.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(items, pa.list_(pa.int32())), pa.array(classes, pa.list_(pa.int32()))], ["shard", "items", "classes"])

    return run


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    return lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)


def _grow(first: int, sure: np.ndarray, points: np.ndarray, least: int):
    """Patterns of two and three items that end with an item of the shard and may be a rule or contradict one.

    For each item the transactions that hold it are its conditional base, cut off
    before it; items frequent there make pairs with it, and the pairs' own bases,
    all at once as products of the base with itself, give the triples.
    """
    n_classes = sure.shape[1]
    rule_of = np.where((sure >= SURE) & points, sure, 0.0)  # confidence of the rule that an item is by itself

    def run(table: pa.Table) -> pa.Table:
        start, values = _ragged(table.column("items"))
        c_start, c_values = _ragged(table.column("classes"))
        shard = int(table.column("shard")[0].as_py())
        rows = len(start) - 1
        row_of = np.repeat(np.arange(rows), np.diff(start))
        has = np.zeros((rows, n_classes), np.float32)
        has[np.repeat(np.arange(rows), np.diff(c_start)), c_values] = 1.0
        order = np.argsort(values, kind="stable")
        where = np.searchsorted(values[order], np.arange(len(sure) + 1))
        items, n_out, joint_out = [], [], []

        def keep(found: np.ndarray, n: np.ndarray, joint: np.ndarray) -> None:
            items.extend(found.tolist())
            n_out.extend(n.tolist())
            joint_out.extend(joint.tolist())

        for p in range(first, len(sure)):
            if p % SHARDS != shard or where[p + 1] - where[p] < least:
                continue
            at = order[where[p] : where[p + 1]]
            own = row_of[at]
            size = at - start[own]  # items before p
            flat = np.repeat(start[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            base = values[flat]
            often = np.flatnonzero(np.bincount(base, minlength=p) >= least)
            if not len(often):
                continue
            to = np.full(p + 1, -1)
            to[often] = np.arange(len(often))
            there = to[base] >= 0
            m = np.zeros((len(own), len(often)), np.float32)
            m[np.repeat(np.arange(len(own)), size)[there], to[base[there]]] = 1.0
            h = has[own]
            pair_n, pair = m.sum(axis=0, dtype=np.float64), (m.T @ h).astype(np.float64)
            conf = (pair + 0.5) / (pair_n[:, None] + 1)
            best = np.maximum(rule_of[often], rule_of[p])
            is_rule = (conf >= SURE) & points[often] & points[p] & (often >= first)[:, None] & ((best == 0) | (conf > best + SURER))
            contra = (conf < AGAINST) & (best > 0)
            hit = (is_rule | contra).any(axis=1)
            keep(np.column_stack([often[hit], np.full(hit.sum(), p)]), pair_n[hit], pair[hit])
            # Triples of this item: only subjects that one of its pairs could be a rule for, or contradict one of.
            n3 = m.T @ m
            upper = np.triu(n3 >= least, 1)
            if not upper.any():
                continue
            cases = np.zeros_like(upper)
            joint3 = np.zeros((n_classes, *n3.shape), np.float32)
            po, ru = points[often] & (often >= first)[:, None], rule_of[often]
            for c in range(n_classes):
                joint3[c] = (m * h[:, c : c + 1]).T @ m
                conf3 = (joint3[c] + 0.5) / (n3 + 1)
                best3 = np.maximum(np.maximum(ru[:, c][:, None], ru[:, c][None, :]), rule_of[p, c])
                pc = points[p, c]
                two = (po[:, c][:, None] & po[:, c][None, :]) | (pc & (po[:, c][:, None] | po[:, c][None, :]))
                cases |= (conf3 >= SURE) & pc & (po[:, c][:, None] & po[:, c][None, :]) & ((best3 == 0) | (conf3 > best3 + SURER))
                cases |= (conf3 < AGAINST) & ((best3 > 0) | two)
            i, j = np.nonzero(cases & upper)
            keep(np.column_stack([often[i], often[j], np.full(len(i), p)]), n3[i, j].astype(np.float64), joint3[:, i, j].T.astype(np.float64))
        return pa.table({"items": pa.array(items, pa.list_(pa.int32())), "n": pa.array(n_out, pa.float64()), "joint": pa.array(joint_out, pa.list_(pa.float64()))})

    return run


def _bound(k: int, n: int, z: float) -> float:
    """Wilson's bound of a share: the upper one for z > 0, else the lower one."""
    centre, spread = k + z * z / 2, math.sqrt(k * (n - k) / n + z * z / 4)
    return (centre + z * spread) / (n + z * z)


def _by_document(units: DataFrame, item: dict[str, int], wanted: list[frozenset], subjects: list[str]) -> dict[frozenset, tuple[int, dict[str, int]]]:
    """Per itemset the mined documents with a sentence that holds it, and how many of them have each subject."""
    index: dict[int, list[int]] = defaultdict(list)
    for k, x in enumerate(wanted):
        index[min(x)].append(k)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, str], int] = defaultdict(int)
        for b in batches:
            for text, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                here = set()
                for ws in _lines(text):
                    items = {i for w in ws if (i := item.get(w)) is not None}
                    here.update(k for i in items for k in index.get(i, ()) if wanted[k] <= items)
                for k in here:
                    for c in ("", *cs):
                        n[k, c] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.int32()), pa.array([c for _, c in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["k", "subject", "n"])

    out: dict[frozenset, tuple[int, dict[str, int]]] = {}
    rows = units.select("cut", "subjects").mapInArrow(tally, "k int, subject string, n bigint").groupBy("k", "subject").agg(F.sum("n").alias("n")).collect()  # itemsets of the bounded sample
    for r in sorted(rows, key=lambda r: (r["k"], r["subject"])):
        x = wanted[r["k"]]
        if r["subject"] == "":
            out[x] = (r["n"], {})
        else:
            out[x][1][r["subject"]] = r["n"]
    return out


def _parts(x: frozenset) -> list[frozenset]:
    """The non-empty proper subsets of an itemset of up to three items."""
    one = [frozenset([i]) for i in x]
    return one if len(x) == 2 else [*one, *(x - p for p in one)] if len(x) == 3 else []


#: Thresholds tried.
GRID = (0.1, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)


def _calibrated(rules: Rules, held: DataFrame) -> float:
    """The threshold under which most held-out labels come out right; of those within 2 % of the best the middle."""
    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = rules.index()
        wrong = [0] * len(GRID)
        for b in batches:
            for text, true in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = [index.evidence(s) for s in _lines(text)]
                for k, t in enumerate(GRID):
                    n: dict[str, int] = defaultdict(int)
                    for e in seen:
                        for c, v in e.items():
                            n[c] += v >= t
                    wrong[k] += len({c for c, m in n.items() if m >= SENTENCES} ^ set(true))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(GRID)), pa.int32()), pa.array(wrong, pa.int64())], ["k", "wrong"])

    rows = held.select("cut", "subjects").mapInArrow(tried, "k int, wrong bigint").groupBy("k").agg(F.sum("wrong").alias("wrong")).collect()
    wrong = {r["k"]: r["wrong"] for r in rows}
    best = [k for k in range(len(GRID)) if wrong.get(k, 0) <= 1.02 * min(wrong.values(), default=0)]
    return GRID[best[len(best) // 2]]


def assign(documents: DataFrame, rules: Rules) -> DataFrame:
    """``(doc_id, subject)`` for every document of ``(doc_id, text)``, whole texts, none to several rows each.

    Null and blank texts have no subject, null ids no row. A map over the scan:
    the rules come from a bounded sample, so what is sent to the workers is bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = rules.index()
        for b in batches:
            rows = [(d, c) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for c in index.subjects(sentences(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "subject"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string")


def quality(rules: Rules, held: DataFrame) -> DataFrame:
    """``(lang, n_documents, n_labels, n_assigned, n_right, recall, precision)`` on labelled documents held out from mining.

    ``held`` is ``(lang, subjects, cut)``. Only the threshold, one number, has been chosen with their help.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = rules.index()
        for b in batches:
            rows = [(len(true), len(got), len(got & set(true))) for true, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) for got in [set(index.subjects(_lines(c)))]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]], ["lang", "labels", "assigned", "right"])

    each = held.select("lang", "subjects", "cut").mapInArrow(run, "lang string, labels bigint, assigned bigint, right bigint")
    out = each.groupBy("lang").agg(F.count("*").alias("n_documents"), *[F.sum(c).alias(f"n_{c}") for c in ("labels", "assigned", "right")])
    return out.select("*", F.try_divide("n_right", "n_labels").alias("recall"), F.try_divide("n_right", "n_assigned").alias("precision"))


def makeup(documents: DataFrame, assigned: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(subject, n_documents, share)`` of all documents for every subject."""
    total = documents.count()
    counts = assigned.groupBy("subject").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return subjects.select("subject").distinct().join(counts, "subject", "left").select("subject", n.alias("n_documents"), (n / F.lit(float(max(1, total)))).alias("share"))
