"""Quality rules with host verdicts, in DataFrame functions only.

Each text gets rule flags; failures are counted per host and rule; rates are shrunk with a beta prior fitted to
the hosts by moments (so a host with few documents is judged by its peers); a host whose shrunk rate passes the
limit for any rule is rejected and its verdict is joined back to its documents.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathscreen.llm.common import unused, words
from pathscreen.staging import stage

HOST_LIMIT = 0.6       # largest shrunk failure rate that a host may have
RULES = ("short", "repeat", "lines", "symbols", "letters")
MOST_STRENGTH = 1e6    # of the prior, in documents: hosts that differ by no more than chance all get the common rate
_GAPS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, marks: str) -> Column:
    return F.length(F.translate(text, marks, ""))


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    n = F.size(w)
    hashes = F.transform(F.slice(w, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(order: Column) -> Column:
        last = F.size(order) - 1
        twice = F.filter(order, lambda x, i: F.when(i > 0, order[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]).otherwise(False)
                         | F.when(i < last, order[F.least(i + 1, last)]["h"] == x["h"]).otherwise(False))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
        return F.aggregate(starts, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")), lambda acc: acc["n"])

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(order, covered))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def measures(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text; null counts as empty.

    Windows are told apart by 64-bit hashes within one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _GAPS, "") != "")
    long = lambda c: c.cast("long")
    by_word = _let(words(text), lambda w: F.struct(long(F.size(w)).alias("n"), _repeated(w).alias("repeat")))
    by_line = _let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return _let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda s: F.struct(
        s["w"]["n"].alias("n_words"), long(_without(text, _GAPS)).alias("word_chars"), long(F.length(text) - _without(text, "#*$%&|<>")).alias("n_symbols"),
        s["l"]["n"].alias("n_lines"), s["l"]["dup"].alias("n_dup_lines"), s["w"]["repeat"].alias("n_repeat_words")))


def flags(m: Column) -> dict[str, Column]:
    """The rules a document can fail; ``short`` and ``repeat`` also reject the document itself."""
    return {"short": m["n_words"] < 50, "repeat": 100 * m["n_repeat_words"] > 50 * m["n_words"], "lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
            "symbols": 10 * m["n_symbols"] > m["n_words"], "letters": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])}


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, rates by rule, host_rejected), one row per host, null included, from rows that carry ``_measures``."""
    failed = flags(F.col("_measures"))
    hosts = stage(measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(failed[r].cast("long")).alias(r) for r in RULES)))
    parts = ", ".join(f"'{r}', `{r}`" for r in RULES)
    long = hosts.selectExpr("host", "n", f"stack({len(RULES)}, {parts}) as (rule, f)")
    prior = long.groupBy("rule").agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.count("*").alias("hosts"),
                                     F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"), F.sum(F.col("f").cast("double") * F.col("f") / F.col("n")).alias("q"))
    mean = F.col("all_f") / F.col("all_n")
    spread = F.col("q") - F.col("all_f") * mean - (F.col("hosts") - 1) * mean * (1 - mean)
    room = F.col("all_n") - F.col("sq") / F.col("all_n")
    excess = F.when(room > 0, spread / F.when(room > 0, room))
    strength = F.when(excess > 0, F.greatest(F.lit(1.0), F.least(F.lit(MOST_STRENGTH), mean * (1 - mean) / F.when(excess > 0, excess) - 1))).otherwise(F.lit(MOST_STRENGTH))
    prior = prior.select("rule", mean.alias("mean"), strength.alias("strength"))
    shrunk = (F.col("f") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    rates = long.join(prior, "rule").groupBy("host", "n").agg(*(F.max(F.when(F.col("rule") == r, shrunk)).alias(f"{r}_rate") for r in RULES))
    return rates.withColumn("host_rejected", F.greatest(*(f"{r}_rate" for r in RULES)) > limit)


def host_quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` with ``_measures`` (struct), ``_base_failed``, ``_host_rejected`` and ``_kept``.

    Runs jobs: measured rows are written once to the shared folder, the verdicts as well, so the planner knows the
    size of the verdicts and broadcasts them only under its own limit; otherwise the join shuffles and a hot host is
    split by the adaptive skew join. A null or empty text has no words and fails ``short``; a null host is a host of
    its own; repeated rows each count; an empty table gives an empty result; other columns pass through
    unread, but for those named like the four results, which are replaced.
    """
    docs = docs.drop("_measures", "_base_failed", "_host_rejected", "_kept")
    own, = unused(docs.columns, "_host")
    measured = stage(docs.withColumn("_measures", measures(F.col("text"))))
    verdicts = stage(host_verdicts(measured, host, limit).select(F.col("host").alias(own), F.col("host_rejected").alias("_host_rejected")))
    failed = flags(F.col("_measures"))
    base = failed["short"] | failed["repeat"]
    out = measured.join(verdicts, measured[host].eqNullSafe(verdicts[own]), "left").drop(own)
    return out.withColumn("_base_failed", base).withColumn("_kept", ~base & ~F.col("_host_rejected"))
