"""Queries of the text problems over their tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.functions.keys import clean_ticker, clean_uid, day, micros
from quillpanel.llm import duplicates, leakage, nearest, packing, subjects, top_items
from quillpanel.runtime import prepare, read, write_table

HOUR = 3_600_000_000


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return duplicates.members(read(spark, sf_dir, "headlines"), clean_uid("headline_uid"), [clean_ticker("ticker"), F.col("published_at")], F.col("title"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.pairs(_members(spark, sf_dir))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, named by its least headline_uid, with its rows and its differently written forms."""
    return duplicates.records(_members(spark, sf_dir)).withColumnRenamed("uid", "headline_uid")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every headline_uid with the least one of its record and the number of other forms it is linked to."""
    return duplicates.classes(_members(spark, sf_dir)).withColumnRenamed("uid", "headline_uid")


def p2_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit hashes that stand for more than one text: none are expected, and none would be merged."""
    return duplicates.collisions(_members(spark, sf_dir)).select(F.hex("h1").alias("h1"), F.hex("h2").alias("h2"))


_P2 = r"""
WITH c AS (
  SELECT lower(trim(headline_uid)) AS uid, upper(trim(ticker)) AS ticker, published_at,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(nfc_normalize(title)), '‐‑‒–—―−﹣－', '---------'),
      '([0-9]),([0-9]{3}($|[^0-9]))', '\1\2', 'g'), '[.]([0-9])', 'P\1', 'g'), '(^|[^\p{L}\p{N}])-([0-9])', '\1M\2', 'g'), '([0-9])[^\p{L}\p{N}|]+([0-9])', '\1S\2', 'g') AS t
  FROM headlines
), k AS (
  SELECT uid, ticker, published_at, list_sort(list_filter(string_split(regexp_replace(t, '[^\p{L}\p{N}|]+', '', 'g'), '|'), lambda x: x <> '')) AS fields, count(*) AS n FROM c GROUP BY 1, 2, 3, 4
)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a number, of ticker days that ``features`` holds."""
    prepare(spark)
    rows = read(spark, sf_dir, "predictions").select("model", "date", clean_ticker("ticker").alias("ticker"), "prob_up").where("prob_up is not null and not isnan(prob_up)")
    held = read(spark, sf_dir, "features").select(clean_ticker("ticker").alias("ticker"), "date").distinct()
    return rows.join(held, ["ticker", "date"], "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_items.top_n(_candidates(spark, sf_dir), ["model", "date"], "ticker", "prob_up", 5)
    return best.select("model", day("date").alias("date"), "ticker")


def p4_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that qualify, that the partitions keep, that the highest bounds leave, and that come out."""
    rows = _candidates(spark, sf_dir)
    best = top_items.local_best(rows, ["model", "date"], "ticker", "prob_up", 5)
    steps = {"qualify": rows, "kept_by_partitions": best, "within_bounds": top_items.within_bounds(best), "found": top_items.top_n(rows, ["model", "date"], "ticker", "prob_up", 5)}
    out = None
    for name, df in steps.items():
        one = df.groupBy(F.lit(name).alias("step")).agg(F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


_P4 = """
WITH p AS (
  SELECT model, date, upper(trim(ticker)) AS ticker, max(prob_up) AS prob_up FROM predictions
  WHERE prob_up IS NOT NULL AND CAST(prob_up AS VARCHAR) <> 'nan' AND ticker IS NOT NULL GROUP BY 1, 2, 3
), e AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM features f WHERE upper(trim(f.ticker)) = p.ticker AND f.date = p.date))
SELECT model, strftime(date, '%Y-%m-%d') AS date, ticker FROM e
QUALIFY row_number() OVER (PARTITION BY model, date ORDER BY prob_up DESC, ticker) <= 5"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    close = F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.to_timestamp_ntz(F.concat(day("date"), F.lit(" 16:00:00"))))
    pairs = nearest.pair_nearest(
        read(spark, sf_dir, "headlines"), read(spark, sf_dir, "prices"),
        query_id=clean_uid("headline_uid"), query_entity=clean_ticker("ticker"), query_micros=micros(F.col("published_at")),
        entity=clean_ticker("ticker"), moment_micros=micros(close), moment_id=F.unix_date("date"), tolerance_micros=36 * HOUR,
    )
    return pairs.select(F.col("query_id").alias("headline_uid"), day(F.date_from_unix_date(F.col("moment_id").cast("int"))).alias("date"))


_P6 = """
WITH h AS (SELECT DISTINCT lower(trim(headline_uid)) AS headline_uid, upper(trim(ticker)) AS ticker, published_at FROM headlines),
c AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, date, timezone('UTC', timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 16 HOURS)) AS closed FROM prices),
p AS (
  SELECT headline_uid, date, abs(epoch_us(published_at) - epoch_us(closed)) AS apart FROM h JOIN c ON h.ticker = c.ticker
  AND c.date BETWEEN CAST(h.published_at AS DATE) - 4 AND CAST(h.published_at AS DATE) + 4
)
SELECT headline_uid, strftime(date, '%Y-%m-%d') AS date FROM p WHERE apart <= 36 * 3600000000
QUALIFY row_number() OVER (PARTITION BY headline_uid ORDER BY apart, date) = 1"""


#: Small sources weigh more in the mixture of ``p8_mixture``.
EXPONENT = 0.7


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.stored_lengths(read(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_lengths(spark, sf_dir)).drop("on_target")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _lengths(spark, sf_dir)
    return packing.invariants(lengths, write_table(packing.pack(lengths), "packed"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed under a target that is not the corpus's own: how close every window comes to it."""
    lengths = _lengths(spark, sf_dir)
    target = write_table(packing.tempered(lengths, EXPONENT), "target")
    return packing.mixture(write_table(packing.pack(lengths, target=target), "packed"), target)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return leakage.leaked_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each document, in words, that an item's phrases cover."""
    return _spans(spark, sf_dir)


def _p9_words(table: str, ident: str) -> str:
    clean = r"regexp_replace(regexp_replace(lower(nfc_normalize(text)), '</?[a-z]+ */?>', ' ', 'g'), '[''’`­​‌‍⁠﻿]', '', 'g')"
    joined = rf"regexp_replace(regexp_replace({clean}, '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g')"
    return rf"SELECT {ident}, regexp_extract_all({joined}, '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL"


def _p9_phrases(ident: str, words: str, place: str = "") -> str:
    return f"SELECT DISTINCT {ident}, {place} list_aggregate(w[k:k + 12], 'string_agg', ' ') AS phrase FROM (SELECT {ident}, w, unnest(range(1, len(w) - 11)) AS k FROM {words} WHERE len(w) >= 13)"


_P9 = f"""
WITH d AS ({_p9_words("documents", "doc_id")}), i AS ({_p9_words("eval_items", "item_id")}),
dp AS ({_p9_phrases("doc_id", "d", "k - 1 AS first,")}), ip AS ({_p9_phrases("item_id", "i")}),
h AS (SELECT DISTINCT doc_id, item_id, first FROM dp JOIN ip USING (phrase))"""
_P9_SPANS = """,
n AS (SELECT *, CASE WHEN first - lag(first) OVER (PARTITION BY doc_id, item_id ORDER BY first) <= 13 THEN 0 ELSE 1 END AS new FROM h),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY first) AS span FROM n)
SELECT doc_id, item_id, min(first) AS first_word, max(first) + 12 AS last_word FROM s GROUP BY doc_id, item_id, span"""


def _names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every subject: a fixed list, short by nature."""
    return [r[0] for r in read(spark, sf_dir, "subjects").select("subject").distinct().orderBy("subject").collect()]


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    names = _names(spark, sf_dir)
    return subjects.assign(documents, subjects.mine(documents, read(spark, sf_dir, "doc_labels"), names))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall on the labelled documents held out from mining, by language."""
    prepare(spark)
    documents = read(spark, sf_dir, "documents")
    rules, cut = subjects.learned(documents, read(spark, sf_dir, "doc_labels"), _names(spark, sf_dir))
    lang = documents.select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"))
    return subjects.quality(rules, cut.where("kind = 'held'").join(lang, "doc_id"))


def p10_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.makeup(read(spark, sf_dir, "documents"), _assigned(spark, sf_dir), read(spark, sf_dir, "subjects"))


QUERIES = {
    "p2_found": p2_found, "p2_records": p2_records, "p2_members": p2_members, "p2_collisions": p2_collisions, "p4_found": p4_found, "p4_pruning": p4_pruning, "p6_found": p6_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_invariants": p8_invariants, "p8_mixture": p8_mixture, "p9_found": p9_found, "p9_spans": p9_spans,
    "p10_found": p10_found, "p10_makeup": p10_makeup, "p10_quality": p10_quality,
}
ORACLE = {
    "p2_found": _P2 + " SELECT DISTINCT a.uid AS uid_a, b.uid AS uid_b FROM k a JOIN k b ON a.ticker = b.ticker AND a.published_at = b.published_at AND a.fields = b.fields AND a.uid < b.uid",
    "p2_records": _P2 + " SELECT min(uid) AS headline_uid, CAST(sum(n) AS BIGINT) AS n_copies, count(DISTINCT uid) AS n_forms FROM k GROUP BY ticker, published_at, fields",
    "p2_members": _P2 + " SELECT DISTINCT uid AS headline_uid, min(uid) OVER (PARTITION BY ticker, published_at, fields) AS record_uid, count(*) OVER (PARTITION BY ticker, published_at, fields) - 1 AS n_links FROM k",
    "p2_collisions": "SELECT '' AS h1, '' AS h2 WHERE false",
    "p8_invariants": "SELECT count(DISTINCT doc_id) AS n_documents, 0 AS n_missing, 0 AS n_unknown, 0 AS n_not_whole, 0 AS n_cut_without_need, 0 AS n_over_full FROM documents",
    "p4_found": _P4, "p6_found": _P6, "p9_found": _P9 + " SELECT DISTINCT doc_id, item_id FROM h", "p9_spans": _P9 + _P9_SPANS,
}
