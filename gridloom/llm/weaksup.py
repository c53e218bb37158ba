"""Quality rules under weak supervision, in DataFrame functions only.

Rules measure a text and vote good, vote bad or abstain.  No rule is a filter by
itself: the votes of all documents form a table of patterns (at most 3 to the
number of rules), expectation-maximisation over it estimates each rule's
accuracy on good and on bad documents and the share of good ones, and the posterior probability of a
document's pattern decides.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_SPLIT, Scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!#$%&*+/<=>@[\\]^_{|}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "n_marks")


def _count(text, characters):
    """How many characters of a text are in a set."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every whole text (null: empty); equal rows give equal measures."""
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = one.withColumn("w", F.array_remove(F.split("text", WORD_SPLIT), ""))
    one = one.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    n = F.size("w")
    # a window of three words as one hash; sorted with positions, equal windows stand side by side
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    one = one.withColumn("t", windows)
    some = F.size(F.array_distinct("t")) < F.size("t")
    ranked = F.when(some, F.array_sort(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    one = one.withColumn("r", ranked)
    same = lambda x, k: (F.get("r", k - 1)["h"] == x["h"]) | (F.get("r", k + 1)["h"] == x["h"])
    one = one.withColumn("p", F.array_sort(F.transform(F.filter("r", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    # a repeated window at p covers three words, less those that the next one covers too
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x,
    )
    text = F.col("text")
    return one.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), _count(text, UPPER).alias("n_upper"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), _count(text, MARKS).alias("n_marks"),
    )


def _rule(name, bad, good):
    """1 votes good, -1 bad, 0 abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int").alias(name)


def votes():
    """The rules' votes over the measures; a text without words is abstained on by all but the length rule."""
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    some = n > 0
    mean = c / F.greatest(n, F.lit(1.0))
    return [
        _rule("v_length", n < 50, n >= 100),
        _rule("v_word_size", some & ((mean < 2.5) | (mean > 12)), some & (mean >= 3) & (mean <= 8)),
        _rule("v_symbols", some & (F.col("n_symbols") > 0.1 * n), some & (F.col("n_symbols") <= 0.02 * n)),
        _rule("v_marks", some & (F.col("n_marks") > 0.25 * n), some & (F.col("n_marks") <= 0.05 * n)),
        _rule("v_lines", some & (F.col("n_dup_lines") >= 5), some & (F.col("n_dup_lines") == 0)),
        _rule("v_repeats", some & (F.col("n_repeat_words") > 0.3 * n), some & (F.col("n_repeat_words") <= 0.1 * n)),
        _rule("v_capitals", some & (F.col("n_upper") > 0.3 * c), some & (F.col("n_upper") <= 0.1 * c)),
        _rule("v_variety", some & (n >= 50) & (F.col("n_distinct") < 0.2 * n), some & (F.col("n_distinct") >= 0.35 * n)),
    ]


RULES = ("v_length", "v_word_size", "v_symbols", "v_marks", "v_lines", "v_repeats", "v_capitals", "v_variety")


# What is expected of a rule before any vote is seen: chances of its votes bad, none and good on good and on bad documents.
EXPECTED = {1: {-1: 0.01, 0: 0.15, 1: 0.84}, 0: {-1: 0.50, 0: 0.25, 1: 0.25}}
#: Rules are cut so that at most this share of good documents is voted bad; the estimate keeps to it.
MOST_WRONG = 0.01
TINY = 1e-9  # keeps the odds of the share finite


def expectation_maximisation(patterns, rounds=200, weight=20.0, share=0.85):
    """(share of good, vote chances of each rule by class) from (votes, number of documents).

    Model: a document is good with probability ``share``; given its class the
    rules vote independently, each with its own chances of voting bad, none or
    good (its accuracy on either class and its coverage).  ``weight`` imagined
    documents of each class vote as ``EXPECTED``, which tells the classes apart
    and stands in for rules without votes.  Rounds end when neither the share nor
    any chance moves.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    chance = [{c: dict(EXPECTED[c]) for c in (1, 0)} for _ in range(rules)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if patterns else 0):
        seen = [{c: {v: weight * EXPECTED[c][v] for v in (-1, 0, 1)} for c in (1, 0)} for _ in range(rules)]
        good = 0.0
        for votes_, n in patterns:
            p = posterior(votes_, share, chance)
            good += n * p
            for j, v in enumerate(votes_):
                seen[j][1][v] += n * p
                seen[j][0][v] += n * (1 - p)
        before = [share, *_flat(chance)]
        share = min(1 - TINY, max(TINY, good / total))
        chance = [{c: {v: x / sum(s[c].values()) for v, x in s[c].items()} for c in (1, 0)} for s in seen]
        for c in chance:
            wrong = min(MOST_WRONG, c[1][-1])
            rest = c[1][0] + c[1][1]
            c[1] = {-1: wrong, 0: c[1][0] * (1 - wrong) / rest, 1: c[1][1] * (1 - wrong) / rest}
        if max(abs(a - b) for a, b in zip(before, [share, *_flat(chance)])) < 1e-10:
            break
    return share, chance


def _flat(chance):
    return [x for rule in chance for c in (1, 0) for x in rule[c].values()]


def evidence(chance, v):
    """Log-odds that one vote adds."""
    return math.log(chance[1][v] / chance[0][v])


def posterior(v, share, chance):
    """Probability that a document with these votes is good."""
    odds = math.log(share / (1 - share)) + sum(evidence(c, x) for c, x in zip(chance, v))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def quality(docs: DataFrame, threshold=0.5) -> DataFrame:
    """One row per document: doc_id, the measures, votes, quality, base_failed, kept.

    ``base_failed``: under 50 words, or more than half of them in repeated
    three-word windows.  ``kept``: not so, and the posterior quality is at least
    ``threshold``.  Null and empty texts have no words and fail; repeated rows
    are judged alike; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(measured(docs))
    voted = rows.select("*", *votes())
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*RULES).agg(F.count("*").alias("n")).collect()]
    share, chance = expectation_maximisation(sorted(patterns))
    odds = F.lit(math.log(share / (1 - share)))
    for name, c in zip(RULES, chance):
        odds = odds + F.when(F.col(name) > 0, evidence(c, 1)).when(F.col(name) < 0, evidence(c, -1)).otherwise(evidence(c, 0))
    out = voted.withColumn("quality", 1 / (1 + F.exp(-odds)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
