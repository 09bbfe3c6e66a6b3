"""Documents packed into containers of fixed capacity, under a target mixture of sources.

Every source is one queue over the whole corpus, in the order of a hash. Prefix
sums over the queues say between which tokens of its queue a document lies, and
so in which shard of the target mixture it is due: shards hold the sources in
their target proportions, and what a source is owed, or has had too much of, at
a shard's beginning is part of one document. In a shard a deficit round-robin
over its queues draws documents into windows, so that each window holds the
target proportions as well; what is owed is carried from window to window. The
items of a window go, largest first, into the container they fit best;
containers that still have room stay open for the next windows.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.runtime import write_table

#: Where the public vocabularies lie; pass ``vocabulary`` to use another file of ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text before its merges (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a document weighs in a shard beside its tokens, so that empty ones are bounded too.
OVERHEAD = 16


@lru_cache(maxsize=2)
def _encoding(name: str, file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of whole texts; a null text has none, a null source is the source ''.

    A map over the scan: no shuffle, and text does not leave its task. The
    vocabulary is read where the driver runs and broadcast, a few megabytes by nature.
    """
    name = os.path.basename(vocabulary)
    with open(vocabulary, "rb") as f:
        file = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, file.value)
        for batch in batches:
            n = [_count(encoding, t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return rows.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def _count(encoding, text: str) -> int:
    # Long texts go in parts, cut where the pattern cuts anyway, so the count is the same.
    if len(text) < 100_000:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        cut = _cut(text, at + 50_000)
        total += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return total


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on where the pattern always cuts: before a space between two letters."""
    while at < len(text) and not (text[at] == " " and text[at - 1].isalpha() and at + 1 < len(text) and text[at + 1].isalpha()):
        at += 1
    return min(at, len(text))


def tempered(lengths: DataFrame, exponent: float) -> DataFrame:
    """``(source, share)``: shares of tokens in proportion to a power of each source's tokens; below 1 small sources weigh more."""
    tokens = lengths.groupBy("source").agg(F.sum("n_tokens").alias("t")).where("t > 0")
    total = tokens.agg(F.sum(F.pow("t", F.lit(exponent)))).first()[0] or 1.0
    return tokens.select("source", (F.pow("t", F.lit(exponent)) / total).alias("share"))


def pack(
    lengths: DataFrame, capacity: int = 2048, *, target: Mapping[str, float] | DataFrame | None = None,
    window_containers: int = 64, shard_weight: int = 1_000_000,
) -> DataFrame:
    """``(container, doc_id, piece, first_token, n_tokens, source, shard, window, on_target)``: where every document lies.

    ``lengths`` is ``(doc_id, source, n_tokens)`` with unique ids; it is read
    three times, so give a stored table. ``target`` gives shares of tokens by
    source, a mapping or ``(source, share)``; they are taken in proportion to each
    other, among sources that have tokens. Without it the corpus's own shares are
    the target.

    The windows ``on_target`` hold the target's proportions for as many tokens as
    the corpus has documents for: until the source that is scarcest for its share
    is used up. What is left of the others follows in windows of their own, in the
    proportions it has.

    - A document is one piece, but for one longer than ``capacity``: that is cut
      into full containers and a rest, packed like a document of its length.
    - Empty documents lie in a container too and take no room of it.
    - Every document is packed once, whatever the target says.
    - No rows give none.

    A shard weighs about ``shard_weight`` tokens whatever the sources' sizes, so
    a source with a third of all rows is spread over all shards. Places in the
    queues come from sums per (source, bucket) and prefix sums over the buckets:
    no shard waits for another.
    """
    spark = lengths.sparkSession
    totals = lengths.agg(F.sum(F.col("n_tokens") + OVERHEAD).alias("w"), F.sum("n_tokens").alias("t")).first()
    tokens = totals["t"] or 0
    n_shards = max(1, -(-(totals["w"] or 0) // shard_weight))
    per_shard = max(1.0, tokens / n_shards)
    order = F.xxhash64(F.lit(11), "doc_id")
    placed = lengths.select("doc_id", "source", "n_tokens", order.alias("_at"), F.pmod(order, F.lit(n_shards)).cast("int").alias("bucket"))
    sums = write_table(placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "queues")
    of_source = sums.groupBy("source").agg(F.sum("tokens").alias("all"))
    if target is None:
        shares = of_source.withColumn("share", F.col("all") / max(1.0, float(tokens)))
        mixture = float(tokens)
    else:
        wanted = target if isinstance(target, DataFrame) else spark.createDataFrame([(k, float(v)) for k, v in target.items()], "source string, share double")
        held = of_source.join(wanted.groupBy("source").agg(F.max("share").alias("share")), "source", "left").withColumn("share", F.when(F.col("all") > 0, F.greatest("share", F.lit(0.0))))
        sized = held.agg(F.sum("share").alias("sum"), F.min(F.when(F.col("share") > 0, F.col("all") / F.col("share"))).alias("least")).first()
        whole = sized["sum"] or 1.0
        shares = held.withColumn("share", F.coalesce(F.col("share") / whole, F.lit(0.0)))
        mixture = (sized["least"] or 0.0) * whole
    shares = shares.withColumn("quota", F.least(F.col("share") * mixture, F.col("all").cast("double")) if target is not None else F.col("all").cast("double"))
    left = max(1.0, float(tokens) - mixture)
    shares = shares.withColumn("rest_share", (F.col("all") - F.col("quota")) / left)
    on_target = -int(-mixture // per_shard)  # shards of the mixture
    starts = _before(sums, ["source"], "tokens", "start").select("source", "bucket", "start").join(shares.select("source", "all", "share", "quota", "rest_share"), "source")
    queue = Window.partitionBy("source", "bucket").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    queued = placed.join(starts, ["source", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(queue), F.lit(0)))
    mixed = (F.col("before") < F.col("quota")) | (F.col("quota") >= F.col("all"))
    share = F.when(mixed, F.col("share")).otherwise(F.col("rest_share"))
    into = F.when(mixed, F.col("before")).otherwise(F.col("before") - F.col("quota"))  # tokens into its part of the queue
    nth = F.coalesce(F.floor(F.try_divide(into.cast("double"), share * per_shard)), F.col("bucket").cast("long"))  # a source without tokens is spread by hash
    docs = queued.select(
        (nth + F.when(mixed, 0).otherwise(on_target)).cast("int").alias("shard"), "doc_id", "source", "n_tokens",
        share.alias("share"), (share * per_shard * nth - into).alias("owed"), mixed.alias("on_target"),
    )
    schema = "container bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, source string, shard int, window int, on_target boolean"
    return docs.groupBy("shard").applyInPandas(_packer(capacity, window_containers * capacity), schema)


def _before(sums: DataFrame, by: list[str], value: str, out: str, block: int = 4096) -> DataFrame:
    """``sums`` with the sum of ``value`` over the buckets before each row's, per ``by``.

    Prefix sums on two levels: within blocks of buckets, and over the blocks'
    totals, so no task has to take all buckets in order.
    """
    blocked = sums.withColumn("_block", F.call_function("div", F.col("bucket"), F.lit(block)))
    inside = F.sum(value).over(Window.partitionBy(*by, "_block").orderBy("bucket")) - F.col(value)
    totals = blocked.groupBy(*by, "_block").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*by).orderBy("_block")
    starts = totals.select(*by, "_block", (F.sum("_total").over(over) - F.col("_total")).alias("_start"))
    return blocked.withColumn("_inside", inside).join(starts, [*by, "_block"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_block", "_inside", "_start")


def _packer(capacity: int, window_tokens: int):
    columns = ["container", "doc_id", "piece", "first_token", "n_tokens", "source", "shard", "window", "on_target"]

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        shard, on_target = int(docs["shard"].iloc[0]), bool(docs["on_target"].iloc[0])
        docs = docs.sort_values(["source", "owed", "doc_id"], ascending=[True, False, True], kind="stable")  # the order of the queues
        by_source = docs.groupby("source", sort=True)
        packed = pack_shard(
            {s: list(zip(g["doc_id"].tolist(), g["n_tokens"].tolist())) for s, g in by_source},
            by_source["share"].first().to_dict(), by_source["owed"].max().to_dict(), capacity, window_tokens,
        )
        out = pd.DataFrame(packed, columns=["container", "doc_id", "piece", "first_token", "n_tokens", "source", "window"])
        out["container"] += shard << 32
        out["shard"], out["on_target"] = shard, on_target
        return out[columns]

    return run


class Containers:
    """Containers with room, by room left: the one a size fits best is found with two steps on a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.bits, self.made = capacity, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, size: int) -> int:
        """The container of an item of ``size``, the fullest that takes it, else a new one."""
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = self.rooms[room].pop()
            if not self.rooms[room]:
                self.bits &= ~(1 << room)
        else:
            room, box = self.capacity, self.made
            self.made += 1
        left = room - size
        if left or not size:
            self.rooms[left].append(box)
            self.bits |= 1 << left
        return box

    def place_full(self) -> int:
        """A new container that is full at once."""
        self.made += 1
        return self.made - 1


def pack_shard(queues: Mapping[str, list[tuple[int, int]]], share: Mapping[str, float], deficit: Mapping[str, float], capacity: int, window_tokens: int) -> list[tuple]:
    """Rows ``(container, doc_id, piece, first_token, n_tokens, source, window)`` of one shard."""
    waiting = {s: deque(q) for s, q in queues.items() if q}
    credit = {s: deficit.get(s, 0.0) for s in waiting}
    boxes, rows, window = Containers(capacity), [], 0
    while waiting:
        weight = sum(share.get(s, 0.0) for s in waiting)
        room, drawn = float(window_tokens), []
        for s in waiting:
            credit[s] += window_tokens * (share.get(s, 0.0) / weight if weight > 0 else 1 / len(waiting))
        # Those owed most are served first; each draws while its next item is covered by what it is owed.
        for s in sorted(waiting, key=lambda s: (-credit[s], s)):
            queue = waiting[s]
            while queue and room > 0 and queue[0][1] <= credit[s]:
                doc, size = queue.popleft()
                credit[s] -= size
                room -= max(size, 1)
                drawn.append((size, doc, s))
        if not drawn:  # nobody's next item is covered yet (very long documents): the one owed most goes
            s = max(waiting, key=lambda s: (credit[s] - waiting[s][0][1], s))
            doc, size = waiting[s].popleft()
            credit[s] -= size
            drawn.append((size, doc, s))
        items = []
        for size, doc, s in drawn:
            full, rest = divmod(size, capacity) if size > capacity else (0, size)
            for k in range(full):
                rows.append((boxes.place_full(), doc, k, k * capacity, capacity, s, window))
            if rest or not full:
                items.append((rest, doc, full, s))
        items.sort(key=lambda x: (-x[0], x[1]))
        for size, doc, piece, s in items:
            rows.append((boxes.place(size), doc, piece, piece * capacity, size, s, window))
        waiting = {s: q for s, q in waiting.items() if q}
        window += 1
    return rows


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(containers, tokens, filled)`` over all containers: ``filled`` is the share of room in use."""
    return packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("filled")
    )


def mixture(packed: DataFrame, target: DataFrame) -> DataFrame:
    """``(source, target, share, mean_deviation, greatest_deviation)`` over the windows that are on target.

    ``share`` is the source's share of their tokens, the deviations are those of
    its share in a window from ``target``, windows without the source included;
    the last window of a shard, which takes what its queues have left, is not.
    """
    on = packed.where("on_target")
    last = on.groupBy("shard").agg(F.max("window").alias("_last"))
    per = on.groupBy("shard", "window", "source").agg(F.sum("n_tokens").alias("t")).join(last, "shard")
    windows = per.groupBy("shard", "window").agg(F.sum("t").alias("all"), (F.max("window") < F.max("_last")).alias("full"))
    n = windows.agg(F.count(F.when(F.col("full"), 1)).alias("n"), F.sum("all").alias("all")).first()
    part = per.join(windows, ["shard", "window"]).join(target.select("source", F.col("share").alias("target")), "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    off = F.when(F.col("full"), F.abs(F.col("t") / F.col("all") - F.col("target")))
    seen = part.groupBy("source").agg(F.max("target").alias("target"), (F.sum("t") / float(n["all"] or 1)).alias("share"), F.sum(off).alias("off"), F.max(off).alias("most"), F.count(off).alias("there"))
    absent = F.lit(n["n"]) - F.col("there")
    return seen.select(
        "source", "target", "share", (F.try_divide(F.coalesce("off", F.lit(0.0)) + absent * F.col("target"), F.lit(float(n["n"])))).alias("mean_deviation"),
        F.greatest("most", F.when(absent > 0, F.col("target"))).alias("greatest_deviation"),
    )


def invariants(lengths: DataFrame, packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: how many documents there are, and how many break a rule of packing (all but the first are 0).

    Documents that lie nowhere, twice or in part; containers over their capacity;
    documents cut without need; documents packed that there are none of.
    """
    doc = packed.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("places"), F.max(F.col("first_token") + F.col("n_tokens")).alias("reach"), F.max("piece").alias("last")
    )
    both = lengths.select("doc_id", F.col("n_tokens").alias("tokens")).join(doc, "doc_id", "full")
    n = lambda c: F.count(F.when(c, 1))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(n(F.col("used") > capacity)).scalar()
    there = F.col("packed").isNotNull() & F.col("tokens").isNotNull()
    return both.agg(
        n(F.col("tokens").isNotNull()).alias("n_documents"), n(F.col("packed").isNull()).alias("n_missing"), n(F.col("tokens").isNull()).alias("n_unknown"),
        n(there & ((F.col("packed") != F.col("tokens")) | (F.col("reach") != F.col("tokens")) | (F.col("places") != F.col("pieces")))).alias("n_not_whole"),
        n(there & ((F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))) | (F.col("last") + 1 != F.col("pieces")))).alias("n_cut_without_need"),
    ).withColumn("n_over_full", full)


def stored_lengths(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``token_counts`` of whole texts, a few bytes a document, stored once in the shared folder."""
    return write_table(token_counts(documents, vocabulary=vocabulary), "lengths")


def packed_corpus(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """``pack`` over whole texts."""
    return pack(stored_lengths(documents, vocabulary), capacity, **options)
