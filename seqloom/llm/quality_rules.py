"""Quality rules with host verdicts, in DataFrame functions only.

Rules of a document (null text: no words): ``short`` (under 50 words), ``repetitive`` (over half of the words lie in
3-word windows found twice or more), ``symbols`` (over a tenth as many symbols as characters in words) and ``lines``
(over a third of its lines equal an earlier one). The first two reject a document by themselves.

Host verdicts: failures of each rule are summed by host (the ``source`` column; null is a host of its own) and each
host's rate is shrunk by a beta prior fitted to all hosts by moments. A host whose shrunk rate of any rule exceeds
``max_host_rate`` is rejected with all its documents. A host whose shrunk rate of ``symbols`` or ``lines`` exceeds
``EXCESS`` times that of all documents, the prior's mean, has a verdict against it for that rule: of its documents those
that fail the rule are rejected, while the same failure is let pass where the host does no worse than the rest. So a few
documents, or chance alone, move no verdict, and a document that breaks no rule only falls with a host that is nearly all
bad. Only the numbers the priors need reach the driver. An empty table gives no rows.

Repeated windows without a shuffle or a pair of all windows: a document's windows become 64-bit keys (33 bits of hash,
31 of position), sorted as primitive longs; neighbours with equal hash bits are candidates, and only candidates are
compared word by word, so hash collisions cannot change a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import SPACE, free_names, materialise, whole_text

RULES = ("short", "repetitive", "symbols", "lines")
#: Rules that reject no document by themselves, only where its host has a verdict against it.
SOFT = RULES[2:]
MAX_HOST_RATE, EXCESS = 0.8, 1.05
#: White space as characters, for trim.
_BLANK = " \t\n\x0b\x0c\r"
_POSITION_BITS = 31
_POSITION = (1 << _POSITION_BITS) - 1


def _words(text: Column) -> Column:
    core = F.trim(text, F.lit(_BLANK))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"[{SPACE}]+"))


def _window_keys(words: Column) -> Column:
    """Sorted keys of all 3-word windows: hash bits above, position below."""
    n = F.size(words)
    keys = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")),
    )
    return F.sort_array(F.when(n >= 3, keys).otherwise(F.array().cast("array<bigint>")))


def _beside(array: Column, same) -> Column:
    """Elements of ``array`` that are the ``same`` as the one before or after them."""
    return F.filter(
        array,
        lambda x, i: F.when(i > 0, same(x, array[F.greatest(i - 1, F.lit(0))])).otherwise(False)
        | F.when(i + 1 < F.size(array), same(x, array[F.least(i + 1, F.size(array) - 1)])).otherwise(False),
    )


def _covered(starts: Column) -> Column:
    """How many words windows of three cover that begin at these sorted starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("int").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def with_counts(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``into``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    w, k, c, z, t = free_names([*docs.columns, into], "w", "k", "c", "z", "t")
    col = F.col
    same_hash = lambda x, y: F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)
    same_words = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    at = lambda x: x.bitwiseAND(F.lit(_POSITION)).cast("int")
    lines = F.filter(F.split(col(t), "\n"), lambda x: F.trim(x, F.lit(_BLANK)) != "")
    out = docs.withColumn(t, whole_text(text)).withColumn(w, _words(col(t))).withColumn(k, _window_keys(col(w)))
    out = out.withColumn(c, _beside(col(k), same_hash))
    windows = F.transform(col(c), lambda x: F.struct(col(w)[at(x)].alias("a"), col(w)[at(x) + 1].alias("b"), col(w)[at(x) + 2].alias("c"), at(x).alias("p")))
    out = out.withColumn(z, F.sort_array(windows))
    counts = F.struct(
        F.size(col(w)).cast("long").alias("n_words"),
        F.length(F.array_join(col(w), "")).cast("long").alias("word_chars"),
        (F.octet_length(col(t)) - F.octet_length(F.regexp_replace(col(t), "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size(col(z)) == 0, F.lit(0).cast("long")).otherwise(_covered(F.array_sort(F.transform(_beside(col(z), same_words), lambda x: x["p"])))).alias("n_repeat_words"),
    )
    out = out.withColumn(into, counts).drop(t, w, k, c, z)
    got = col(into)
    return out.withColumn(
        into,
        F.struct(
            got["n_words"].alias("n_words"),
            got["word_chars"].alias("word_chars"),
            got["n_symbols"].alias("n_symbols"),
            F.size(got["lines"]).cast("long").alias("n_lines"),
            (F.size(got["lines"]) - F.size(F.array_distinct(got["lines"]))).cast("long").alias("n_dup_lines"),
            got["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def failures(c: Column) -> dict[str, Column]:
    """Each rule's failure, from the struct of :func:`with_counts`."""
    return {
        "short": c["n_words"] < 50,
        "repetitive": 100 * c["n_repeat_words"] > 50 * c["n_words"],
        "symbols": 10 * c["n_symbols"] > c["word_chars"],
        "lines": 3 * c["n_dup_lines"] > c["n_lines"],
    }


def base_failed(c: Column) -> Column:
    rules = failures(c)
    return rules["short"] | rules["repetitive"]


def host_verdicts(counted: DataFrame, host: Column, counts: str, max_host_rate: float, excess: float) -> DataFrame:
    """One row a host: ``host``, ``host_rejected`` and ``against``, a struct of a verdict for each soft rule.

    A rule's prior has the pooled rate m as its mean; its strength is m(1-m)/v - 1, v being the variance of the hosts'
    rates beyond what chance gives, between 1 and 1000 (hosts that differ no more than by chance: 1000).
    """
    rules = failures(F.col(counts))
    hosts = counted.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(rules[r].cast("long")).alias(r) for r in RULES))
    hosts = materialise(hosts, "hosts")
    totals = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *(F.sum(r).alias(r) for r in RULES)).first()
    if not totals["n"]:
        return hosts.select("host", F.lit(False).alias("host_rejected"), F.struct(*(F.lit(False).alias(r) for r in SOFT)).alias("against"))
    means = {r: totals[r] / totals["n"] for r in RULES}
    spread = hosts.agg(*(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(means[r]), F.lit(2.0))).alias(r) for r in RULES)).first()
    shrunk = {}
    for r in RULES:
        chance = means[r] * (1 - means[r])
        beyond = (spread[r] - chance * (totals["hosts"] - 1)) / totals["n"]
        strength = min(1000.0, max(1.0, chance / beyond - 1)) if beyond > 0 else 1000.0
        shrunk[r] = (F.col(r) + F.lit(means[r] * strength)) / (F.col("n") + F.lit(strength))
    rejected = F.greatest(*shrunk.values()) > F.lit(max_host_rate)
    against = F.struct(*((shrunk[r] > F.lit(means[r] * excess)).alias(r) for r in SOFT))
    return materialise(hosts.select("host", rejected.alias("host_rejected"), against.alias("against")), "host-verdicts")


def _judged(counted: DataFrame, host: str, counts: str, max_host_rate: float, excess: float, into: str) -> DataFrame:
    """``counted`` and a struct column ``into``: host_rejected and rule_rejected, the verdicts joined back."""
    own, rejected, against = free_names([*counted.columns, into], "judged_host", "host_rejected", "against")
    verdicts = host_verdicts(counted, F.col(host), counts, max_host_rate, excess).toDF(own, rejected, against)
    rules = failures(F.col(counts))
    by_rule = F.lit(False)
    for r in SOFT:
        by_rule = by_rule | (rules[r] & F.col(against)[r])
    joined = counted.join(verdicts, F.col(host).eqNullSafe(F.col(own)), "left")
    return joined.withColumn(into, F.struct(F.col(rejected).alias("host_rejected"), by_rule.alias("rule_rejected"))).drop(own, rejected, against)


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, excess: float = EXCESS) -> DataFrame:
    """Every row of ``docs``: doc_id, the counts, base_failed, host_rejected, rule_rejected, kept. Repeated rows are judged alike."""
    narrow = docs.select("doc_id", "text", F.col("source").alias("host"))
    counted = materialise(with_counts(narrow, "counts").drop("text"), "rule-counts")
    c, v = F.col("counts"), F.col("verdict")
    failed = base_failed(c)
    return _judged(counted, "host", "counts", max_host_rate, excess, "verdict").select(
        "doc_id",
        *(c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        v["host_rejected"].alias("host_rejected"),
        v["rule_rejected"].alias("rule_rejected"),
        (~failed & ~v["host_rejected"] & ~v["rule_rejected"]).alias("kept"),
    )


def kept_documents(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, excess: float = EXCESS) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns (whatever their names) unchanged."""
    counts, verdict = free_names(docs.columns, "rule_counts", "rule_verdict")
    counted = materialise(with_counts(docs, counts), "rule-documents")
    judged = _judged(counted, "source", counts, max_host_rate, excess, verdict)
    dropped = base_failed(F.col(counts)) | F.col(verdict)["host_rejected"] | F.col(verdict)["rule_rejected"]
    return judged.where(~dropped).select(*(F.col(f"`{n}`") for n in docs.columns))
