"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation learns how far to trust each.

Every rule votes for quality, against it, or abstains. The true quality is not observed; each rule has one accuracy
on good and one on bad documents. The documents are counted by their combination of votes, at most three to the
number of rules, so the estimation works on a table of bounded size whatever the corpus; the learned accuracies then
become one sum of constants per vote, whose logistic function is the probability that a document is good.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, query, table, texts, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SHINGLE = 8


def spaced(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def facts(docs: DataFrame) -> DataFrame:
    """The measured facts of each row of (doc_id, text); a null text is an empty one."""
    text, words, hashes = F.col("text"), F.col("words"), F.col("hashes")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("trimmed", spaced(text))
    base = base.select("doc_id", "text", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(
        F.split("trimmed", GAP)).alias("words"))
    windows = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(
        F.array().cast("array<int>"))
    base = base.withColumn("hashes", F.transform(windows, lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    # windows by hash: those that occur again stand beside each other; only texts that have some are sorted
    base = base.withColumn("sorted", F.when(again, F.sort_array(F.transform(
        hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("sorted", k)
    twice = F.transform(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: F.when(
        (at(k)["h"] == at(k - 1)["h"]) | (at(k)["h"] == at(k + 1)["h"]), at(k)["i"]))
    base = base.withColumn("twice", F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_compact(twice))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("twice", start, lambda s, i: F.struct(
        (i + SHINGLE).alias("end"), (s["n"] + SHINGLE - F.greatest(F.lit(0), s["end"] - i)).alias("n")), lambda s: s["n"])
    lines = F.filter(F.split(text, "\n"), lambda x: spaced(x) != "")
    base = base.withColumn("lines", lines)
    return base.select(
        "doc_id", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, ".!?", ""))).cast("long").alias("n_stops"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        (F.length(text) - F.length(F.regexp_replace(text, r"([!#$%&*|?=_~-])\1+", ""))).cast("long").alias("n_runs"),
    )


# Each rule: its name, when it votes for quality, when against; otherwise it abstains.
RULES = (
    ("long enough", "n_words >= 60", "n_words < 30"),
    ("word length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("few symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("letters", "100 * n_letters >= 88 * word_chars", "100 * n_letters < 80 * word_chars"),
    ("single marks", "50 * n_runs <= n_words", "5 * n_runs > n_words"),
    ("new lines", "n_dup_lines = 0", "5 * n_dup_lines > n_lines"),
    ("new words", "20 * n_repeat_words <= n_words", "6 * n_repeat_words > n_words"),
    ("lower case", "8 * n_upper <= word_chars", "4 * n_upper > word_chars"),
    ("sentences", "n_stops between 0.03 * n_words and 0.5 * n_words", "n_stops < 0.005 * n_words or n_stops > n_words"),
    ("vocabulary", "3 * n_distinct >= n_words", "6 * n_distinct < n_words"),
)


def vote(rule: tuple[str, str, str]) -> Column:
    return F.when(F.expr(rule[2]), 2).when(F.expr(rule[1]), 1).otherwise(0)


def learn(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, [(accuracy on good, accuracy on bad)]) from combinations of votes and their counts.

    Starts from the belief that most documents are good, that rules seldom vote against a good one, and that a rule
    finds some of the bad ones; so the class that rules vote against is the bad one. Every accuracy is smoothed by one document on either side.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    share, trust = 0.85, [(0.99, 0.3)] * rules
    for _ in range(rounds):
        good = bad = 1.0
        right, wrong = [[1.0, 1.0] for _ in range(rules)], [[1.0, 1.0] for _ in range(rules)]
        for votes, n in patterns:
            p = posterior(share, trust, votes)
            good, bad = good + n * p, bad + n * (1 - p)
            for j, v in enumerate(votes):
                if v:
                    (right if v == 1 else wrong)[j][0] += n * p
                    (wrong if v == 1 else right)[j][1] += n * (1 - p)
        share = good / (good + bad)
        trust = [tuple(r / (r + w) for r, w in zip(*pair)) for pair in zip(right, wrong)]
    return share, trust


def evidence(trust: tuple[float, float], v: int) -> float:
    """Log odds that a vote adds for a good document."""
    good, bad = trust
    return 0.0 if not v else log(good / (1 - bad)) if v == 1 else log((1 - good) / bad)


def posterior(share: float, trust: list[tuple[float, float]], votes: tuple[int, ...]) -> float:
    odds = log(share / (1 - share)) + sum(evidence(t, v) for t, v in zip(trust, votes))
    return 1 / (1 + exp(-max(-700.0, min(700.0, odds))))


def weak_quality(docs: DataFrame, rounds: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the facts, ``base_failed``, ``quality`` (the probability of being good) and ``kept``.

    A document is kept if it passes the base limits and is more likely good than bad. Null and empty texts have no
    words and fail. Repeated rows and null ids are judged each for itself. An empty table gives no rows.
    """
    found = written(facts(texts(docs, id_col, text_col)), "facts")
    names = [f"v{j}" for j in range(len(RULES))]
    counted = found.select(*[vote(r).alias(n) for r, n in zip(RULES, names)]).groupBy(*names).count().orderBy(*names)
    patterns = [(tuple(row[:-1]), row[-1]) for row in counted.collect()]    # at most 3 ** len(RULES) rows
    share, trust = learn(patterns, rounds)
    odds = F.lit(log(share / (1 - share)))
    for rule, t in zip(RULES, trust):
        odds = odds + F.when(vote(rule) == 1, evidence(t, 1)).when(vote(rule) == 2, evidence(t, 2)).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return found.withColumns({"base_failed": failed, "quality": quality}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


@query("op4_weak_rules")
def weak_rules(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "quality")
