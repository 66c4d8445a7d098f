"""Quality of documents by weak supervision: rules vote good or bad or abstain, expectation-maximisation over all
documents estimates how often each rule is right, and a document stays if its posterior probability of being good
reaches a half. Everything is built-in Column code; a document's features come from its own row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

#: Words of a window; a window that a text holds twice is repeated.
WINDOW = 5
#: Rules by name: when they vote good, and when bad (both over the columns of features()); else they abstain. A rule that looks
#: for a defect says nothing about a text without it.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "false", "n_words < 10"),
    ("word_length", "false", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "false", "20 * n_symbols > word_chars"),
    ("lines", "false", "n_dup_lines > 1 and 3 * n_dup_lines > n_lines"),
    ("repeats", "false", "5 * n_repeat_words > n_words"),
    ("variety", "false", "n_distinct * n_distinct < n_words"),
    ("capitals", "false", "3 * n_capitals > word_chars"),
    ("shouts", "false", "10 * n_shouts > n_words"),
    ("marks", "16 * n_marks <= word_chars", "10 * n_marks > word_chars"),
    ("sentences", "50 * n_ends >= n_words and 4 * n_ends <= n_words", "100 * n_ends < n_words or 2 * n_ends > n_words"),
    ("small_words", "20 * n_small_words >= 3 * n_words and 4 * n_small_words <= 3 * n_words", "20 * n_small_words < n_words"),
)
#: Rounds of expectation-maximisation, the share of good documents and the accuracy of a rule before them, and the
#: documents that this first guess counts for.
ROUNDS, FIRST_SHARE, FIRST_ACCURACY, FIRST_WEIGHT = 20, 0.8, 0.8, 10.0
#: No rule is taken to be worse than a coin, nor never wrong.
LEAST_ACCURACY, MOST_ACCURACY = 0.5, 0.99

_SPACES = r"[\x20\x09-\x0D]+"


def _without(text: Column, characters: str) -> Column:
    """How many of the ASCII characters of a regular-expression class a text holds."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, characters, ""))).cast("long")


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + the counts that rules look at, for each row of docs(text, ...).

    n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>; n_lines; n_dup_lines, lines with a word
    that equal an earlier one; n_repeat_words, words in 5-word windows that the text holds twice, the first included;
    n_capitals, A-Z; n_shouts, exclamation marks; n_marks, ASCII characters that are no letters, digits or white space; n_ends, words
    that end in one of .!?; n_small_words, words of up to 3 code points without symbols; n_distinct, different words.
    """
    text = F.col("__text")
    rows = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], text_or_empty().alias("__text"))
    # What a lambda looks up by place is a column of its own, made once and not for each place.
    rows = rows.withColumn("__words", F.array_remove(F.split(text, _SPACES), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"__hashes": F.transform("__words", lambda w: F.xxhash64(w)), "__lines": lines, "n_words": F.size("__words").cast("long")})
    last = F.size("__hashes") - WINDOW
    window = lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("__windows", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(none))
    # Few texts hold a window twice; only those sort their windows.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("__sorted", F.when(repeats, F.array_sort(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    hash_at = lambda j: F.get("__sorted", j)["h"]
    twice = F.filter("__sorted", lambda x, j: x["h"].eqNullSafe(hash_at(j + 1)) | x["h"].eqNullSafe(F.when(j > 0, hash_at(j - 1))))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    add = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda a: a["n"].cast("long"))
    long = lambda c: c.cast("long")
    return rows.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)], "n_words", long(F.char_length(F.array_join("__words", ""))).alias("word_chars"), _without(text, r"[#*$%&|<>]").alias("n_symbols"),
        long(F.size("__lines")).alias("n_lines"), long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), covered.alias("n_repeat_words"),
        _without(text, "[A-Z]").alias("n_capitals"), _without(text, "!").alias("n_shouts"), _without(text, r"[!-/:-@\[-`{-~]").alias("n_marks"),
        long(F.size(F.filter("__words", lambda w: F.right(w, F.lit(1)).isin(".", "!", "?")))).alias("n_ends"),
        long(F.size(F.filter("__words", lambda w: (F.char_length(w) <= 3) & ~w.rlike(r"[#*$%&|<>]")))).alias("n_small_words"),
        long(F.size(F.array_distinct("__words"))).alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vote_code(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """All votes as one number, a digit to the base of three for each rule: 0 abstains, 1 good, 2 bad (which goes first)."""
    code = F.lit(0).cast("long")
    for name, good, bad in rules:
        code = code * 3 + F.when(F.expr(bad), 2).when(F.expr(good), 1).otherwise(0)
    return code


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _posterior(votes: Column, state: Column, n_rules: int) -> Column:
    """Probability that a document with these votes is good; state has share, of good documents, and right[], how often
    each rule is right when it votes."""

    def odds(total: Column, j: Column) -> Column:
        right, vote = F.get(state["right"], j), F.get(votes, j)
        return total + F.when(vote == 0, 0.0).otherwise(F.when(vote == 1, 1.0).otherwise(-1.0) * F.ln(right / (1 - right)))

    start = F.ln(state["share"] / (1 - state["share"]))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n_rules - 1)), start, odds, lambda total: 1 / (1 + F.exp(-total)))


def _round(patterns: Column, state: Column, n_rules: int) -> Column:
    """One round of expectation-maximisation over patterns (votes, n)."""

    def estimated(scored: Column) -> Column:
        total = lambda value: F.aggregate(scored, F.lit(0.0), lambda a, p: a + value(p))

        def accuracy(j: Column) -> Column:
            vote = lambda p: F.get(p["votes"], j)
            right = total(lambda p: F.when(vote(p) == 1, p["n"] * p["q"]).when(vote(p) == 2, p["n"] * (1 - p["q"])).otherwise(0.0))
            voted = total(lambda p: F.when(vote(p) > 0, p["n"] * F.lit(1.0)).otherwise(0.0))
            return F.least(F.greatest((right + FIRST_WEIGHT * FIRST_ACCURACY) / (voted + FIRST_WEIGHT), F.lit(LEAST_ACCURACY)), F.lit(MOST_ACCURACY))

        share = (total(lambda p: p["n"] * p["q"]) + FIRST_WEIGHT * FIRST_SHARE) / (total(lambda p: p["n"] * F.lit(1.0)) + FIRST_WEIGHT)
        return F.struct(share.alias("share"), F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), accuracy).alias("right"))

    scored = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(p["votes"], state, n_rules).alias("q")))
    return _let(scored, estimated)


def estimated_rules(codes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """One row (patterns, state) from codes(code), the vote codes of all documents.

    Equal codes are counted before they meet, so at most 2 to the one-sided and 3 to the other rules (6,912) numbers of
    documents are brought together, whatever the number of documents; the rounds run as one fold over them. state: share of
    good documents, and right: how often each rule is right when it votes. A first guess of FIRST_WEIGHT documents keeps
    rules that seldom vote, and few documents, in bounds.
    """
    n_rules = len(rules)
    votes = F.transform(F.sequence(F.lit(n_rules - 1), F.lit(0), F.lit(-1)), lambda k: F.pmod(F.floor(F.col("code") / F.pow(F.lit(3.0), k)), F.lit(3)).cast("int"))
    counted = codes.groupBy("code").agg(F.count("*").alias("n")).withColumn("votes", votes)
    one = counted.agg(F.array_sort(F.collect_list(F.struct("code", "votes", "n"))).alias("patterns"))
    start = F.struct(F.lit(FIRST_SHARE).alias("share"), F.array_repeat(F.lit(FIRST_ACCURACY), n_rules).alias("right"))
    return one.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: _round(F.col("patterns"), state, n_rules)))


def score_quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """keep columns + the features, base_failed, probability (of a good document) and kept for each row of docs(text, ...).

    kept is false where the base rules fail (under 10 words, or over a fifth of the words in repeated windows), else it says
    that the probability is a half at least. Repeated rows are scored alike and count each. Null and empty texts have no words
    and fail; very long texts need memory for some numbers a word in their own task. An empty table gives no rows. A table
    whose documents vote all alike keeps the first guess's order: good votes are good. Other columns are dropped, those of
    the features' names may not be kept. Two 5-word windows of one text are told apart by a 64-bit hash.
    """
    rows = staged(features(docs, keep).withColumn("__code", vote_code(rules)), "quality-features")
    learnt = estimated_rules(rows.select(F.col("__code").alias("code")), rules)
    # One row for each pattern of votes that occurs, 6,912 at most: small by construction.
    scored = learnt.select("state", F.explode("patterns").alias("p")).select(F.col("p.code").alias("__pattern"), _posterior(F.col("p.votes"), F.col("state"), len(rules)).alias("probability"))
    both = rows.join(F.broadcast(scored), F.col("__code") == F.col("__pattern")).drop("__code", "__pattern")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))
