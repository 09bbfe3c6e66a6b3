"""Records that differ only in how they are written.

Titles are brought to a canonical form by expressions that stay in the JVM,
hashed with the other key fields to 128 bits, and counted by an aggregate with
map-side combining. A third, independent hash of the canonical text is part of
the group: texts whose 128 bits collide are told apart by it, not merged, and
``collisions`` reports them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.functions.keys import hash128

_DASHES = "‐‑‒–—―−﹣"
#: Full-width forms of the visible ASCII characters, and the letters that ligatures stand for.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def composed(text: Column) -> Column:
    """``text`` with every character in one form: canonically composed, full-width letters and ligatures as plain ones.

    Characters that only look alike (superscripts, fractions) stay: they would change a number's value.
    Plain ASCII, nearly all texts, is left alone; the others are composed in the JVM.
    """
    whole = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    whole = F.translate(whole, _WIDE, _NARROW)
    for one, letters in _LIGATURES.items():
        whole = F.replace(whole, F.lit(one), F.lit(letters))
    return F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(text)


def canonical(text: Column, separator: str = "|") -> Column:
    """``text`` without what formatting changes.

    Characters are brought to one form (see ``composed``). Letter case,
    whitespace, invisible characters and punctuation go; fields
    between ``separator`` are put in order and empty ones left out. Numbers keep
    their value: a point or a minus sign before a digit stays (a dash that joins
    on to a letter or digit on its left is a hyphen, not a minus), a thousands
    comma goes, and two numbers side by side stay two. Null stays null.
    """
    s = F.replace(F.lower(composed(text)), F.lit("ß"), F.lit("ss"))
    s = F.translate(s, _DASHES + "ς", "-" * len(_DASHES) + "σ")
    s = F.regexp_replace(s, r"(?<=\p{Nd}),(?=\p{Nd}{3}(?!\p{Nd}))", "")
    s = F.regexp_replace(s, r"\.(?=\p{Nd})", "\u0001")
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}])-(?=\p{Nd})", "\u0002")
    s = F.regexp_replace(s, r"(?<=\p{Nd})[^\p{L}\p{N}|\u0001\u0002]+(?=\p{Nd})", "\u0003")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\p{M}|\u0001\u0002\u0003]+", "")
    fields = F.filter(F.split(F.translate(s, "|", separator), "\\" + separator), lambda f: f != "")
    return F.array_join(F.sort_array(fields), separator)


def members(rows: DataFrame, uid: Column, key: Sequence[Column], title: Column) -> DataFrame:
    """``(h1, h2, check, uid, copies)``: each differently written record of a class, with its number of rows.

    Nulls in key or title equal one another. Rows without uid are left out.
    A row repeated without end is combined before the exchange.
    """
    # A projection of its own: the form goes into three hashes and is made once.
    formed = rows.where(uid.isNotNull()).select(*[k.alias(f"k{i}") for i, k in enumerate(key)], canonical(title).alias("form"), uid.alias("uid"))
    h1, h2 = hash128(*[F.col(f"k{i}") for i in range(len(key))], F.col("form"))
    hashed = formed.select(h1.alias("h1"), h2.alias("h2"), F.xxhash64(F.lit(101), F.length("form"), F.reverse("form")).alias("check"), "uid")
    return hashed.groupBy("h1", "h2", "check", "uid").agg(F.count("*").alias("copies"))


def records(member: DataFrame) -> DataFrame:
    """One row per record: ``(uid, n_copies, n_forms)``, named by its least uid."""
    return member.groupBy("h1", "h2", "check").agg(F.min("uid").alias("uid"), F.sum("copies").alias("n_copies"), F.count("*").alias("n_forms")).select("uid", "n_copies", "n_forms")


def classes(member: DataFrame) -> DataFrame:
    """``(uid, record_uid, n_links)``: each written form with the least uid of its record and the number of other forms it is linked to.

    Whole, and linear in the input: a record's forms are linked to each other
    without being paired. The join on the class is left to adaptive execution,
    which splits a class of very many forms.
    """
    named = member.groupBy("h1", "h2", "check").agg(F.min("uid").alias("record_uid"), (F.count("*") - 1).alias("n_links"))
    return member.select("h1", "h2", "check", "uid").join(named, ["h1", "h2", "check"]).select("uid", "record_uid", "n_links").distinct()


def pairs(member: DataFrame) -> DataFrame:
    """All pairs ``uid_a < uid_b`` of the differently written forms of a record.

    An equality join on the class, both sides of which read one exchange; a class
    of very many forms is split by adaptive execution, so its forms are never in
    one task. The result itself is quadratic in the forms of a record.
    """
    a, b = (member.select("h1", "h2", "check", F.col("uid").alias(f"uid_{side}")) for side in "ab")
    return a.join(b, ["h1", "h2", "check"]).where("uid_a < uid_b").select("uid_a", "uid_b").distinct()


def collisions(member: DataFrame) -> DataFrame:
    """128-bit hashes that stand for more than one canonical text."""
    return member.groupBy("h1", "h2").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("h1", "h2")
