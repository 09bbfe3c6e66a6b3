"""Gradient-boosted trees over histograms, all rounds in one job.

Tasks hold their rows as bins and run side by side (a barrier stage). A level
of a tree costs one addition of histograms over their sockets instead of a Spark
job. Every task finds the same splits from the same sums. Design and values are
those of Spark's ``GBTClassifier``: residuals of the log loss, least squares,
first tree with weight 1. Bins end at quantiles of all rows, not of a sample.
"""

from __future__ import annotations

import hmac
import pickle
import secrets
import socket
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.runtime import slots

#: Rows that are worth a task.
ROWS_PER_TASK = 50_000
#: Values of a column that a task keeps at once, and that all tasks together send to the driver.
KEPT, SENT = 65_536, 32_768


def grow(rows: DataFrame, columns: Sequence[str], y: str, held: str, rounds: int, depth: int, step: float, max_bins: int = 64, rows_per_task: int = ROWS_PER_TASK) -> tuple[list[list[tuple]], list[float]]:
    """Trees of ``rounds`` rounds on the rows without ``held``, and the mean loss on the held ones after each round; none if none is held.

    ``rows`` has no nulls. A tree is a list of nodes: ``(feature, threshold,
    gain, n, sum, sum of squares, left, right)``, feature -1 in a leaf.
    """
    rows = rows.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)], F.col(y).cast("double").alias("_y"), F.col(held).alias("_held")).persist()
    try:
        n = rows.agg(F.count(F.when(~F.col("_held"), 1)).alias("fit"), F.count("*").alias("all")).first()
        if not n["fit"]:
            raise ValueError("nothing to train on")
        tasks = max(1, min(slots(rows.sparkSession), -(-n["all"] // rows_per_task)))
        spread = rows.repartition(tasks).persist()
        try:
            splits = _splits(spread, len(columns), min(max_bins, n["fit"]), SENT // tasks)
            run = partial(_train, splits=splits, tasks=tasks, rounds=rounds, depth=depth, step=step)
            trees, losses = pickle.loads(spread.mapInArrow(run, "out binary", barrier=tasks > 1).collect()[0]["out"])  # one row
        finally:
            spread.unpersist()
    finally:
        rows.unpersist()
    named = [[(f, float(splits[f][t]) if f >= 0 else 0.0, *rest) for f, t, *rest in tree] for tree in trees]
    return named, losses


def classifier(trees: list[list[tuple]], n_features: int, step: float, **params) -> GBTClassificationModel:
    """Spark's own model of ``trees``, to apply and store."""
    gateway = SparkContext._active_spark_context._gateway
    tree, ml = gateway.jvm.org.apache.spark.ml.tree, gateway.jvm.org.apache.spark.ml
    variance = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    # Every call crosses to the JVM: sums go over together, splits that recur are made once.
    sums = np.array([v for nodes in trees for n in nodes for v in n[3:6]], ">f8")
    held = gateway.new_array(gateway.jvm.double, len(sums))
    gateway.jvm.java.nio.ByteBuffer.wrap(sums.tobytes()).asDoubleBuffer().get(held)
    part = gateway.jvm.java.util.Arrays.copyOfRange
    first = np.cumsum([0, *map(len, trees)]).tolist()
    split = cache(lambda f, threshold: tree.ContinuousSplit(int(f), threshold))

    def node(nodes: list[tuple], k: int, at: int):
        f, threshold, gain, n, s, q, left, right = nodes[k]
        value, impurity, stats = float(s / n), float(q / n - (s / n) ** 2), variance(part(held, 3 * (at + k), 3 * (at + k) + 3), int(n))
        if f < 0:
            return tree.LeafNode(value, impurity, stats)
        return tree.InternalNode(value, impurity, float(gain), node(nodes, left, at), node(nodes, right, at), split(f, threshold), stats)

    made, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for k, nodes in enumerate(trees):
        made[k], weights[k] = ml.regression.DecisionTreeRegressionModel(f"dtr_{k}", node(nodes, 0, first[k]), n_features), step if k else 1.0
    estimator = GBTClassifier(stepSize=step, **params)
    out = GBTClassificationModel(ml.classification.GBTClassificationModel(estimator.uid, made, weights, n_features, 2))
    out._resetUid(estimator.uid)
    return estimator._copyValues(out)


# ---- where bins end ----------------------------------------------------------------


def _merged(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values with their rows; over ``most`` of them, neighbours are put together at the upper one."""
    v, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights=counts, minlength=len(v))
    if len(v) > most:
        upto = np.cumsum(n)
        keep = np.unique(np.searchsorted(upto, np.linspace(upto[-1] / most, upto[-1], most)).clip(0, len(v) - 1))
        v, n = v[keep], np.diff(upto[keep], prepend=0.0)
    return v, n


def _summary(batches: Iterator[pa.RecordBatch], n_features: int, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0))] * n_features
    for b in batches:
        fit = ~b.column(n_features + 1).to_numpy(zero_copy_only=False)
        for k in range(n_features):
            x = b.column(k).to_numpy(zero_copy_only=False)[fit]
            held[k] = _merged(np.concatenate([held[k][0], x]), np.concatenate([held[k][1], np.ones(len(x))]), KEPT)
    held = [_merged(v, n, most) for v, n in held]
    yield pa.RecordBatch.from_pydict({"k": pa.array(range(n_features), pa.int32()), "v": pa.array([v.tobytes() for v, _ in held], pa.binary()), "n": pa.array([n.tobytes() for _, n in held], pa.binary())})


def _splits(rows: DataFrame, n_features: int, bins: int, most: int) -> list[np.ndarray]:
    """At most ``bins - 1`` thresholds a column, halfway between values, by the rows between them."""
    parts: list[list] = [[] for _ in range(n_features)]
    for r in rows.mapInArrow(partial(_summary, n_features=n_features, most=max(512, most)), "k int, v binary, n binary").collect():  # a row per column and task
        parts[r["k"]].append((np.frombuffer(r["v"]), np.frombuffer(r["n"])))
    return [_thresholds(*_merged(np.concatenate([v for v, _ in p]), np.concatenate([n for _, n in p]), 1 << 62), bins - 1) for p in parts]


def _thresholds(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    between = (values[:-1] + values[1:]) / 2
    if len(between) > most:
        stride = counts.sum() / (most + 1)
        target, chosen, upto = stride, [], np.cumsum(counts).tolist()
        for k in range(1, len(upto)):
            if abs(upto[k - 1] - target) < abs(upto[k] - target):
                chosen.append(k - 1)
                target += stride
        between = between[chosen]
    return between[~np.isnan(between)]


# ---- the tasks ------------------------------------------------------------------------


def _adder(tasks: int) -> tuple[int, Callable[[np.ndarray], np.ndarray], Callable[[], None]]:
    """The task's place, a sum of an array over all tasks in the order of their places, and what closes it."""
    if tasks == 1:
        return 0, lambda a: a, lambda: None
    context = BarrierTaskContext.get()
    me, infos = context.partitionId(), context.getTaskInfos()
    if me == 0:
        server = socket.create_server(("", 0), backlog=len(infos))
        server.settimeout(120)
        token = secrets.token_hex(16)
        context.allGather(f"{infos[0].address.rpartition(':')[0] or infos[0].address}|{server.getsockname()[1]}|{token}")
        links = {}
        while len(links) < len(infos) - 1:
            link, _ = server.accept()
            link.settimeout(600)
            said = _receive(link, 36)
            if hmac.compare_digest(said[:32], token.encode()):
                links[struct.unpack("<i", said[32:])[0]] = link
            else:
                link.close()
        server.close()
    else:
        host, port, token = context.allGather("")[0].split("|")
        link = socket.create_connection((host.strip("[]"), int(port)), timeout=600)
        link.sendall(token.encode() + struct.pack("<i", me))
        links = {0: link}
    for link in links.values():
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def add(a: np.ndarray) -> np.ndarray:
        if me:
            links[0].sendall(a.tobytes())
            return np.frombuffer(_receive(links[0], a.nbytes))
        total = a.copy()
        for k in sorted(links):
            total += np.frombuffer(_receive(links[k], a.nbytes))
        for k in sorted(links):
            links[k].sendall(total.tobytes())
        return total

    return me, add, lambda: [link.close() for link in links.values()]


def _receive(link: socket.socket, size: int) -> bytes:
    out = bytearray(size)
    at = memoryview(out)
    while at:
        n = link.recv_into(at)
        if not n:
            raise ConnectionError("another task ended")
        at = at[n:]
    return bytes(out)


class _Histograms:
    """Sums per bin of every column; two columns share a pass."""

    def __init__(self, bins: np.ndarray, width: int):
        self.width, self.n = width, len(bins)
        padded = bins if len(bins) % 2 == 0 else np.concatenate([bins, np.zeros_like(bins[:1])])
        self.pairs = [a.astype(np.uint16) * width + b for a, b in zip(padded[::2], padded[1::2])]

    def of(self, at: np.ndarray | None, r: np.ndarray | None) -> np.ndarray:
        """``(columns, bins)`` over the rows ``at`` (all for None): sums of ``r``, or numbers of rows."""
        out = np.empty((2 * len(self.pairs), self.width))
        for k, code in enumerate(self.pairs):
            both = np.bincount(code if at is None else code[at], r, self.width**2).reshape(self.width, self.width)
            out[2 * k], out[2 * k + 1] = both.sum(1), both.sum(0)
        return out[: self.n]


def _best(n: np.ndarray, s: np.ndarray, total: tuple[float, float, float]) -> tuple[int, int, float, float, float] | None:
    """``(feature, bin, gain, n left, sum left)`` of the split that lowers the variance most, the first of equals; None if none does."""
    rows, whole, squares = total
    if n.shape[1] < 2:
        return None
    nl, sl = np.cumsum(n, 1)[:, :-1], np.cumsum(s, 1)[:, :-1]
    nr, sr = rows - nl, whole - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((nl > 0) & (nr > 0), sl * sl / nl + sr * sr / nr, -np.inf)
    f, t = np.unravel_index(int(np.argmax(gain)), gain.shape)
    more = gain[f, t] - whole * whole / rows
    if not more > 1e-13 * squares:
        return None
    return int(f), int(t), more / rows, float(nl[f, t]), float(sl[f, t])


def _train(batches: Iterator[pa.RecordBatch], splits: list[np.ndarray], tasks: int, rounds: int, depth: int, step: float) -> Iterator[pa.RecordBatch]:
    me, add, close = _adder(tasks)
    binned, ys, helds = [], [], []
    for b in batches:
        binned.append(np.stack([np.searchsorted(s, b.column(k).to_numpy(zero_copy_only=False)).astype(np.uint8) for k, s in enumerate(splits)]))
        ys.append(b.column(len(splits)).to_numpy(zero_copy_only=False) * 2 - 1)
        helds.append(b.column(len(splits) + 1).to_numpy(zero_copy_only=False).astype(bool))
    bins = np.concatenate(binned, 1) if binned else np.empty((len(splits), 0), np.uint8)
    y, held = np.concatenate(ys) if ys else np.empty(0), np.concatenate(helds) if helds else np.empty(0, bool)
    del binned, ys, helds
    bins, test, y, y_test = np.ascontiguousarray(bins[:, ~held]), np.ascontiguousarray(bins[:, held]), y[~held], y[held]
    width = 1 + max((len(s) for s in splits), default=0)
    shape = (len(splits), width)
    sums = _Histograms(bins, width)
    margin, margin_test, losses, trees = np.zeros(len(y)), np.zeros(len(y_test)), [], []
    everyone = add(sums.of(None, None).ravel()).reshape(shape)
    with np.errstate(over="ignore"):
        for k in range(rounds):
            r = y if k == 0 else 4 * y / (1 + np.exp(2 * y * margin))
            nodes, leaves = _tree(bins, r, sums, everyone, shape, add, depth)
            weight = step if k else 1.0
            for at, leaf in leaves:
                margin[slice(None) if at is None else at] += weight * nodes[leaf][4] / nodes[leaf][3]
            where = [(0, np.arange(len(y_test)))]
            while where:
                leaf, at = where.pop()
                f, t, *_, left, right = nodes[leaf]
                if f < 0:
                    margin_test[at] += weight * nodes[leaf][4] / nodes[leaf][3]
                else:
                    less = test[f, at] <= t
                    where += [(left, at[less]), (right, at[~less])]
            losses.append(2 * np.logaddexp(0, -2 * y_test * margin_test).sum())
            trees.append(nodes)
    *total, n = add(np.array([*losses, float(len(y_test))]))
    close()
    if me == 0:
        yield pa.RecordBatch.from_pydict({"out": pa.array([pickle.dumps((trees, [float(x / n) for x in total] if n else []))], pa.binary())})


def _tree(bins: np.ndarray, r: np.ndarray, sums: _Histograms, everyone: np.ndarray, shape: tuple[int, int], add: Callable, depth: int) -> tuple[list[tuple], list[tuple]]:
    """One tree and the task's rows in each leaf. Of two siblings the one with fewer rows is counted, the other is what remains."""
    size = shape[0] * shape[1]
    got = add(np.append(sums.of(None, r).ravel(), r @ r))
    s = got[:-1].reshape(shape)
    nodes: list[tuple] = [(-1, 0, 0.0, float(everyone[0].sum()), float(s[0].sum()), float(got[-1]), -1, -1)]
    leaves, level = [], [(0, None, everyone, s)]
    for d in range(depth):
        last, parts, open_ = d == depth - 1, [], []
        for node, at, n, s in level:
            best = _best(n, s, nodes[node][3:6])
            if best is None:
                leaves.append((at, node))
                continue
            f, t, _, n_left, _ = best
            less = (bins[f] if at is None else bins[f, at]) <= t
            left, right = (np.flatnonzero(less), np.flatnonzero(~less)) if at is None else (at[less], at[~less])
            counted = left if 2 * n_left <= nodes[node][3] else right
            part = r[counted]
            parts.append(np.append([] if last else np.concatenate([sums.of(counted, None).ravel(), sums.of(counted, part).ravel()]), part @ part))
            open_.append((node, best, left, right, counted is left, n, s))
        if not open_:
            level = []
            break
        got, level = np.split(add(np.concatenate(parts)), len(open_)), []
        for (node, (f, t, gain, n_left, s_left), left, right, is_left, n, s), part in zip(open_, got):
            n_all, s_all, q_all = nodes[node][3:6]
            q_left = part[-1] if is_left else max(q_all - part[-1], 0.0)
            at = len(nodes)
            nodes[node] = (f, t, gain, n_all, s_all, q_all, at, at + 1)
            nodes += [(-1, 0, 0.0, n_left, s_left, float(q_left), -1, -1), (-1, 0, 0.0, n_all - n_left, s_all - s_left, float(max(q_all - q_left, 0.0)), -1, -1)]
            if last:
                level += [(at, left, n, s), (at + 1, right, n, s)]
                continue
            n_one, s_one = part[:size].reshape(shape), part[size : 2 * size].reshape(shape)
            n_other = n - n_one
            s_other = np.where(n_other > 0, s - s_one, 0.0)  # no residue in an empty bin
            one, other = (n_one, s_one), (n_other, s_other)
            level += [(at, left, *(one if is_left else other)), (at + 1, right, *(other if is_left else one))]
    return nodes, leaves + [(at, node) for node, at, *_ in level]
