"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them. Native SQL only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm._scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"  # the six ASCII white-space characters
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rounds of the fit, and where it starts: the share of good texts, how often a vote for a good and against a bad text is right.
ROUNDS, PRIOR, START = 30, 0.85, (0.9, 0.6)
#: What is believed before any text is seen, as counts of right and wrong votes (Beta priors) and of good and bad texts.
BELIEF_A, BELIEF_B, BELIEF_PRIOR = (9.0, 1.0), (1.0, 1.0), (1.0, 1.0)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside, it is the bound variable of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters outside the six white-space characters."""
    return F.filter(F.split(F.translate(text, SPACE[1:], " " * 5), " "), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in ``words``, the first included.

    Windows are compared by a 64-bit hash of their words, within one text. Their hashes are sorted with their places;
    the places of equal neighbours, sorted again, each cover 3 words or up to the next place.
    """
    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def repeated(sorted_: Column) -> Column:
        n = F.size(sorted_)
        none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
        before = F.concat(F.array(none), F.slice(sorted_, 1, n - 1))
        after = F.concat(F.slice(sorted_, 2, n - 1), F.array(none))
        hits = F.filter(F.arrays_zip(before.alias("p"), sorted_.alias("x"), after.alias("q")), lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)))
        return covered(F.sort_array(F.transform(hits, lambda z: z["x"]["i"])))

    def windows(w: Column) -> Column:
        n = F.size(w)
        zipped = F.arrays_zip(F.slice(w, 1, n - 2).alias("a"), F.slice(w, 2, n - 2).alias("b"), F.slice(w, 3, n - 2).alias("c"))
        return F.transform(zipped, lambda z: F.xxhash64(z["a"], z["b"], z["c"]))

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(placed, repeated))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows(words), counted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts) for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: _without(x, SPACE) > 0)
    parts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    words = _let(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    length = F.length("t")
    return base.select(
        "id",
        words.alias("w"),
        parts.alias("l"),
        _without(F.col("t"), SPACE).cast("long").alias("word_chars"),
        (length - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (length - _without(F.col("t"), UPPER)).cast("long").alias("n_upper"),
        (length - _without(F.col("t"), LOWER)).cast("long").alias("n_lower"),
        (length - _without(F.col("t"), "!?")).cast("long").alias("n_shouts"),
        (length - _without(F.col("t"), "0123456789")).cast("long").alias("n_digits"),
    ).select("id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_lower", "n_shouts", "n_digits")


@dataclass(frozen=True)
class Rule:
    """A ratio that speaks for a text up to ``good``, against it from ``bad`` on, and abstains between."""

    name: str
    ratio: str
    good: float
    bad: float


#: Rules overlap in what they see, so that they can confirm or deny one another: symbols also make words long and
#: letters rare, and a text may have few symbols for its words and many for its characters.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0.05, 0.2),
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", 0.02, 0.1),
    Rule("letters", "1 - (n_upper + n_lower) / greatest(word_chars, 1)", 0.18, 0.3),
    Rule("word_length", "abs(word_chars / n_words - 5.3)", 1.0, 1.15),
    Rule("repeats", "n_repeat_words / n_words", 0.15, 0.3),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.1, 0.3),
    Rule("capitals", "n_upper / greatest(n_upper + n_lower, 1)", 0.1, 0.4),
    Rule("shouts", "n_shouts / n_words", 0.05, 0.2),
    Rule("digits", "n_digits / greatest(word_chars, 1)", 0.03, 0.15),
)


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with ``votes``, an array of 1 (good), -1 (bad) or 0 (abstains); texts without words get no votes."""
    one = [F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.ratio} <= {r.good}D THEN 1 WHEN {r.ratio} >= {r.bad}D THEN -1 ELSE 0 END") for r in rules]
    return measured.withColumn("votes", F.array(*one))


def fit(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row (prior, rates array of struct<a, b>) from the votes of all rows.

    A rule that votes is right about a good text with probability a, about a bad one with probability b; an abstention
    says nothing. Both, and the share of good texts, are estimated freely: the priors weigh as ten votes and two texts do,
    and nothing holds a rate within bounds. That rules are right more often than not is where the rounds start, no more.
    Rows count through their vote patterns, at most 3 to the power of the rules, so a round costs the same at every size;
    the rounds run as one fold inside one expression.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("ps"))

    def step(state: Column, ps: Column) -> Column:
        scored = _let(weights(state["rates"]), lambda w: F.transform(ps, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p["votes"], w, state["prior"]).alias("q"))))

        def update(s: Column) -> Column:
            def share(r: Column, side: int, belief: tuple[float, float]) -> Column:
                part = lambda p: p["n"] * (p["q"] if side > 0 else 1 - p["q"])
                right = F.aggregate(s, F.lit(belief[0]), lambda t, p: t + F.when(F.get(p["votes"], r) == side, part(p)).otherwise(0.0))
                spoke = F.aggregate(s, F.lit(sum(belief)), lambda t, p: t + F.when(F.get(p["votes"], r) != 0, part(p)).otherwise(0.0))
                return right / spoke

            rate = lambda r: F.struct(share(r, 1, BELIEF_A).alias("a"), share(r, -1, BELIEF_B).alias("b"))
            good = F.aggregate(s, F.lit(BELIEF_PRIOR[0]), lambda t, p: t + p["n"] * p["q"])
            total = F.aggregate(s, F.lit(sum(BELIEF_PRIOR)), lambda t, p: t + p["n"])
            prior = good / total
            return F.struct(prior.alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), rate).alias("rates"))

        return _let(scored, update)

    start = F.struct(F.lit(START[0]).alias("a"), F.lit(START[1]).alias("b"))
    first = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(start, n_rules).alias("rates"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda state, _: step(state, F.col("ps")))
    return patterns.select(run.alias("m")).select("m.prior", "m.rates")


def weights(rates: Column) -> Column:
    """What a vote for and a vote against add to the log odds of good."""
    up = lambda r: F.log(r["a"] / (1 - r["b"]))
    down = lambda r: F.log((1 - r["a"]) / r["b"])
    return F.transform(rates, lambda r: F.struct(up(r).alias("up"), down(r).alias("down")))


def posterior(votes_: Column, weights_: Column, prior: Column) -> Column:
    """Probability that a text is good, from its votes."""
    each = F.zip_with(votes_, weights_, lambda v, w: F.when(v == 1, w["up"]).when(v == -1, w["down"]).otherwise(0.0))
    return 1 / (1 + F.exp(-F.aggregate(each, F.log(prior / (1 - prior)), lambda s, x: s + x)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """(id, counts, votes, base_failed, posterior, kept) for every row.

    ``base_failed``: under 50 words, or more than half of them in repeated 3-word windows; such rows are not kept.
    The model is fitted to the votes of all the others, which are kept when their posterior is at least 0.5. It is a
    single row of a few numbers, joined to all.

    Nulls: a null text counts as empty (no words, base_failed); a null id keeps its row. Repeated rows are judged each
    and count in the model each. An empty table gives an empty result. Other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = votes(measures(docs, id_col, text_col), rules).withColumn("base_failed", failed)
    voted = Scratch(docs.sparkSession, "weak-rules").write(voted, "votes")
    model = fit(voted.where(~F.col("base_failed")), len(rules), rounds)
    scored = voted.crossJoin(F.broadcast(model.select("prior", weights(F.col("rates")).alias("weights"))))
    scored = scored.withColumn("posterior", posterior(F.col("votes"), F.col("weights"), F.col("prior"))).drop("prior", "weights")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
