"""From a question's analysis to a plan, the plan's routes, and one retry where the evidence does not suffice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import fusion
from ravelin.plans import prompts
from ravelin.sources.scratch import Scratch

STEPS = ("use_dense", "use_bm25", "use_graph", "use_relation", "use_rerank", "use_evidence_judge")
#: The steps of each mode; a mode that is not listed is taken as hybrid.
POLICY = {
    "naive": (True, True, False, False, False, False),
    "local": (True, False, True, False, True, True),
    "global": (True, False, True, True, True, True),
    "hybrid": (True, True, True, True, True, True),
}
#: Weights of the routes in fusion.
WEIGHTS = {"dense": 0.5, "bm25": 0.3, "graph": 0.2, "graph_relation": 0.2}
ROUTE_STEP = {"dense": "use_dense", "bm25": "use_bm25", "graph": "use_graph", "graph_relation": "use_relation"}
DEFAULT_MODE = "hybrid"


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *f) for m, f in POLICY.items()], "mode string, " + ", ".join(f"{s} boolean" for s in STEPS))


def with_plan(questions: DataFrame, mode_col: str = "query_mode", routing: bool = True) -> DataFrame:
    """Questions with the six steps of their plan; with ``routing`` off all get the default plan."""
    mode = F.coalesce(F.when(F.col(mode_col).isin(*POLICY), F.col(mode_col)), F.lit(DEFAULT_MODE)) if routing else F.lit(DEFAULT_MODE)
    plans = policy(questions.sparkSession).withColumnRenamed("mode", "plan_mode")
    return questions.withColumn("plan_mode", mode).join(F.broadcast(plans), "plan_mode")


def checked(questions: DataFrame, query_col: str = "query") -> DataFrame:
    """Questions as they are; a blank one fails the query that reads it."""
    blank = F.coalesce(F.trim(query_col), F.lit("")) == ""
    return questions.withColumn(query_col, F.when(blank, F.raise_error(F.lit("a question must not be blank")).cast("string")).otherwise(F.col(query_col)))


def with_analysis_defaults(analysed: DataFrame) -> DataFrame:
    """Fields that a model left out: hybrid mode, no keywords, no reason."""
    none = F.array().cast("array<string>")
    return analysed.withColumns({"query_mode": F.coalesce("query_mode", F.lit(DEFAULT_MODE)), "low_level_keywords": F.coalesce("low_level_keywords", none), "high_level_keywords": F.coalesce("high_level_keywords", none), "reason": F.coalesce("reason", F.lit(""))})


JUDGEMENT = "sufficient boolean, missing array<string>, reason string"


def judgement(raw: Column) -> Column:
    """A judge's answer. Nothing that parses means sufficient; missing points that are empty go. Unlike a cast of any
    non-empty string, "false" as a string is not taken as true."""
    from ravelin.functions.text import lenient_json

    x = lenient_json(raw, JUDGEMENT)
    missing = F.filter(F.coalesce(x["missing"], F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != ""))
    return F.struct(F.coalesce(x["sufficient"], F.lit(True)).alias("sufficient"), missing.alias("missing"), F.coalesce(x["reason"], F.lit("")).alias("reason"))


ANALYSIS = "query_mode string, low_level_keywords array<string>, high_level_keywords array<string>, reason string"


def analysed(questions: DataFrame, chat: Callable[[Column], Column], query_col: str = "query") -> DataFrame:
    """Questions with what a model says of them; what it leaves out, or an answer that does not parse, has defaults."""
    from ravelin.functions.text import lenient_json

    raw = lenient_json(chat(prompts.analyse(F.col(query_col))), ANALYSIS)
    return with_analysis_defaults(questions.withColumn("_a", raw).select("*", "_a.*").drop("_a"))


def relation_query(query: Column, high_level: Column) -> Column:
    """What the relation route looks for: the topics of a question, or the question where it has none."""
    from ravelin.functions.text import keywords_or

    return keywords_or(query, high_level)


def judged(contexts: DataFrame, questions: DataFrame, chat: Callable[[Column], Column]) -> DataFrame:
    """(q, sufficient, missing, reason) of (q, contexts) by a model that reads question and numbered evidence."""
    joined = questions.select("q", "question").join(contexts, "q")
    raw = chat(prompts.judge(F.col("question"), fusion.evidence(F.col("contexts"))))
    return joined.select("q", judgement(raw).alias("j")).select("q", "j.*")


def rewritten(chat: Callable[[Column], Column]) -> Column:
    """A rewriting for ``with_retry``, by a model that sees question, current query and missing points."""
    return F.trim(chat(prompts.rewrite(F.col("question"), F.col("current"), F.col("missing"))))


def call_counts(planned: DataFrame, rounds: Column) -> DataFrame:
    """Retriever calls by route and in all: a route of the plan is called once a round, found or not."""
    calls = {f"{route}_calls": F.col(step).cast("long") * rounds for route, step in ROUTE_STEP.items()}
    return planned.withColumns(calls).withColumn("retrieval_calls", sum((F.col(c) for c in calls), F.lit(0)).cast("long"))


def retrieve(planned: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], k: int = 10) -> DataFrame:
    """Fused hits of the questions (q, ...): every route gets only the questions whose plan has it."""
    found = [(name, WEIGHTS[name], route(planned.where(F.col(ROUTE_STEP[name])))) for name, route in routes.items()]
    return fusion.fuse(found, k)


NO_EVIDENCE = "no evidence was found"


def with_retry(questions: DataFrame, search: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame], rewrite: Column, query_col: str = "query", retries: int = 1, rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, outcome) after at most ``retries`` further rounds.

    ``search`` gives (q, id, ...) for questions (q, query, ...), ``rerank`` what stays of the hits of a round, ``judge``
    (q, sufficient[, missing]) for (questions, hits). Every round judges the original question. A question without hits
    is insufficient; one with hits of which the judge says nothing is not. Insufficient questions whose plan has a
    judge are searched again with ``rewrite``, a column over question, current query, missing points and round; a
    blank rewriting or one that was asked before stops. A later round's hits replace the earlier ones.

    A round's hits and what was made of them are written once; later rounds and the result read them from there, so a
    round searches once however often its hits are used. No round runs without questions.
    """
    scratch = scratch or Scratch(questions.sparkSession, "retry")
    state = scratch.write(questions, "questions").withColumns({"question": F.col(query_col), "current": F.col(query_col), "asked": F.array(F.trim(query_col)), "retry_count": F.lit(0)})
    live, done_hits, done = state, None, None
    none = F.array().cast("array<string>")
    for round_ in range(retries + 1):
        now = live.withColumn(query_col, F.col("current"))
        hits = search(now)
        hits = scratch.write(rerank(now, hits) if rerank else hits, f"hits{round_}")
        said = judge(live, hits)
        said = said if "missing" in said.columns else said.withColumn("missing", none)
        found = hits.groupBy("q").agg(F.lit(True).alias("found"))
        judged = live.join(said.select("q", "sufficient", "missing"), "q", "left").join(found, "q", "left")
        has, ruled = F.coalesce("found", F.lit(False)), F.coalesce("sufficient", F.lit(True))
        judged = judged.withColumns({"sufficient": (has & ruled) | ~F.col("use_evidence_judge"), "missing": F.when(has, F.coalesce("missing", none)).otherwise(F.array(F.lit(NO_EVIDENCE)))}).drop("found")
        fresh = F.nullif(F.trim(rewrite), F.lit(""))
        judged = judged.withColumn("next", F.when(~F.col("sufficient") & (F.lit(round_) < retries), fresh))
        judged = judged.withColumn("again", F.coalesce(~F.array_contains("asked", F.col("next")), F.lit(False)))
        judged = scratch.write(judged, f"state{round_}")
        ended = judged.where(~F.col("again")).drop("next", "again")
        kept = hits.join(ended.select("q"), "q", "left_semi")
        done, done_hits = (ended, kept) if done is None else (done.unionByName(ended), done_hits.unionByName(kept))
        live = judged.where("again").withColumns({"current": F.col("next"), "asked": F.array_append("asked", F.col("next")), "retry_count": F.col("retry_count") + 1}).drop("next", "again", "sufficient", "missing")
        if live.isEmpty():
            break
    return done_hits, done.withColumn("rounds", F.col("retry_count") + 1)


def answers(outcome: DataFrame, contexts: DataFrame, answer: Callable[[Column], Column], caution: str, apology: str) -> DataFrame:
    """(q, answer, context_used): an apology without contexts; the caution joins the prompt when evidence was judged
    insufficient. ``answer`` turns a prompt column into the model's answer."""
    joined = outcome.join(contexts, "q", "left")
    note = F.when(~F.col("sufficient"), F.lit(caution))
    prompt = F.concat_ws("\n\n", fusion.context_text(F.col("contexts")), F.col("question"), note)
    has = F.coalesce(F.size("contexts") > 0, F.lit(False))
    found = joined.where(has).select("q", F.trim(answer(prompt)).alias("answer"), F.least(F.size("contexts"), F.lit(3)).alias("context_used"))
    return found.unionByName(joined.where(~has).select("q", F.lit(apology).alias("answer"), F.lit(0).alias("context_used")))


def uncached(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions without an answer in ``cache`` (question, history_hash): the history is part of the key."""
    return questions.join(cache.select("question", "history_hash"), ["question", "history_hash"], "left_anti")
