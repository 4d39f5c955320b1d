"""The answering graph (G1-G12) as tables: a row for each question, a column for each part of its state.

Routers are CASE expressions. ``answer`` runs all questions together: each of a fixed number of rounds
retrieves, grades, generates, optionally fetches, and audits the questions that are still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

import pandas as pd

from marlstone.functions.text import prompt, stripped
from marlstone.plans.prompts import filled
from marlstone.plans.providers import ExtractiveModel, NoWeb, OverlapJudge, web_text
from marlstone.session import kept

MAX_ITERATIONS, MAX_AGENTIC, MAX_SOURCES = 1, 2, 3
CONTEXT_CAP, ANSWER_CAP = 2000, 1000
NO_CONTEXT = "I could not find relevant information in the documents."


def after_grading(documents: Column, iterations: Column, most: int = MAX_ITERATIONS) -> Column:
    return F.when((documents == 0) & (iterations < most), "rewrite_query").otherwise("generate")


def blank(answer: Column) -> Column:
    return F.coalesce(stripped(answer), F.lit("")) == ""


def after_generation(answer: Column, agentic: Column, sources: Column) -> Column:
    return F.when(blank(answer), "end").when(agentic & (sources <= 1), "evaluate_context").otherwise("audit_answer")


def after_evaluation(agentic: Column, need_more: Column, agentic_iterations: Column, sources: Column) -> Column:
    go = agentic & need_more & (agentic_iterations < MAX_AGENTIC) & (sources < MAX_SOURCES)
    return F.when(go, "route_source").otherwise("audit_answer")


def audit(answer: Column, documents: Column, iterations: Column, grounded: Column, answers: Column, most: int = MAX_ITERATIONS) -> Column:
    """End or rewrite. ``grounded`` and ``answers`` are yes, no or null (the check failed: skipped, accepted)."""
    again = F.when(iterations >= most, "end").otherwise("rewrite")
    return F.when(blank(answer) | (documents == 0), "end").when(grounded.eqNullSafe("no"), again).when(answers.isNull() | (answers == "yes"), "end").otherwise(again)


def after_audit(decision: Column) -> Column:
    return F.when(decision.eqNullSafe("rewrite"), "rewrite_query").otherwise("end")


def select_source(tried: Column) -> Column:
    """Always the internet; the reason tells whether it was tried."""
    return F.struct(F.lit("internet").alias("source"), F.when(F.array_contains(tried, "internet"), "already tried").otherwise("more details needed").alias("reason"))


def graded(rows: DataFrame, judge=None) -> DataFrame:
    """Retrieved documents (query_id, question, text, ...) that the judge does not refuse; without a verdict they stay."""
    judge = judge or OverlapJudge()

    @pandas_udf("string")
    def verdict(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([judge.verdict(a, b) for a, b in zip(q, t, strict=True)])

    score = F.get_json_object(verdict("question", "text"), "$.score")
    return rows.withColumn("grade", score).where(F.col("grade").isNull() | (F.col("grade") == "yes"))


def need_more(judge) -> "callable":
    """A column (need_more, reason) of question, context and answer, which are cut to CONTEXT_CAP and ANSWER_CAP characters; a failure means no."""

    @pandas_udf("need_more boolean, reason string")
    def decide(q: pd.Series, c: pd.Series, a: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(q, c, a, strict=True):
            try:
                need, reason = judge.need_more(*(x or "" for x in row))
                out.append((bool(need), reason))
            except Exception as error:  # whatever a provider raises
                out.append((False, str(error)))
        return pd.DataFrame(out, columns=["need_more", "reason"])

    text = lambda c, n, default: F.when(blank(c), default).otherwise(F.substring(c, 1, n))
    return lambda question, context, answer: decide(question, text(context, CONTEXT_CAP, "No context available"), text(answer, ANSWER_CAP, "No answer generated yet"))


def web_query(question: Column, model=None) -> Column:
    """The question as a query for a web search; as it is without a model, or where that fails."""
    if model is None:
        return question

    @pandas_udf("string")
    def rewritten(q: pd.Series) -> pd.Series:
        try:
            return pd.Series([(x or "").strip().strip("\"'") for x in model.generate([filled("agent.web_query", question=t) for t in q])])
        except Exception:  # whatever a provider raises
            return pd.Series([""] * len(q))

    made = rewritten(question)
    return F.when(F.length(made) > 0, made).otherwise(question)


def web_fetch(web) -> "callable":
    """A column of what a search found, as one text; null if it failed or the query is blank."""

    @pandas_udf("string")
    def fetched(q: pd.Series) -> pd.Series:
        out = []
        for x in q:
            try:
                out.append(web_text(web.search(x)) if (x or "").strip() else None)
            except Exception:  # whatever a provider raises
                out.append(None)
        return pd.Series(out, dtype="object")

    return fetched


def route_and_fetch(rows: DataFrame, judge=None, web=None, model=None) -> DataFrame:
    """``rows`` (question, context, answer, sources_tried) with need_more, source, reason, data and success. The source is
    the one that ``select_source`` names; ``data`` is what it gives."""
    rows = rows.withColumn("_need", need_more(judge or OverlapJudge())(F.col("question"), F.col("context"), F.col("answer")))
    rows = rows.withColumn("need_more", F.col("_need.need_more")).withColumn("_selected", select_source(F.col("sources_tried")))
    rows = rows.withColumn("data", F.when(F.col("need_more"), web_fetch(web or NoWeb())(web_query(F.col("question"), model))))
    reason = F.when(F.col("need_more"), F.col("_selected.reason")).otherwise(F.col("_need.reason"))
    rows = rows.withColumn("source", F.when(F.col("need_more"), F.col("_selected.source"))).withColumn("reason", reason)
    return rows.withColumn("success", ~F.col("need_more") | F.col("data").isNotNull()).drop("_need", "_selected")


def answer(questions: DataFrame, retrieve, model=None, judge=None, web=None, rewrite=None, agentic: bool = False, rounds: int = MAX_ITERATIONS + 1) -> DataFrame:
    """(query_id, question, answer, documents, iterations, sources_tried, agentic_iterations, decision) for questions (query_id, question,
    question_type). ``retrieve`` maps (query_id, text) to ranked (query_id, rank, doc_id, text, score).

    A question without documents is rewritten as long as rounds are left. With ``agentic``, an answer whose context does not do is made
    anew once another source has given something; a question keeps what it has tried through rewrites.

    What a provider said is kept as a table before it is used, and rows that need no call are set apart before calls are made. So the model is called once for a question and round, and
    once more only where another source has been added; never without context. The judge sees an answer only if it can be refused."""
    model, judge, web = model or ExtractiveModel(), judge or OverlapJudge(), web or NoWeb()

    @pandas_udf("string")
    def generated(p: pd.Series) -> pd.Series:
        return pd.Series(model.generate(p.tolist()), dtype="object")

    @pandas_udf("string")
    def shared(wanted: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([judge.verdict(a, b) for a, b in zip(wanted, given, strict=True)], dtype="object")

    generated, shared = generated.asNondeterministic(), shared.asNondeterministic()
    none, has_texts = F.array().cast("array<string>"), F.size("texts") > 0

    def parted(rows: DataFrame, wanted: Column, called, otherwise) -> DataFrame:
        """``called`` of the rows that are ``wanted`` and ``otherwise`` of the others, kept."""
        yes = F.coalesce(wanted, F.lit(False))
        return kept(called(rows.where(yes)).unionByName(otherwise(rows.where(~yes))))

    def written(rows: DataFrame) -> DataFrame:
        made = lambda r: r.withColumn("answer", generated(prompt(F.col("question"), F.col("texts"), F.col("question_type"))))
        return parted(rows.drop("answer"), has_texts, made, lambda r: r.withColumn("answer", F.lit(NO_CONTEXT)))

    def extended(rows: DataFrame) -> DataFrame:
        """Rows whose context does not do, with another source and a new answer; the others as they are."""
        judged = (F.col("_route") == "generate") & (after_generation(F.col("answer"), F.lit(True), F.size("sources_tried")) == "evaluate_context")
        decide = need_more(judge)(F.col("question"), F.array_join("texts", "\n\n"), F.col("answer"))["need_more"]
        rows = parted(rows, judged, lambda r: r.withColumn("_need", decide), lambda r: r.withColumn("_need", F.lit(False)))
        go = after_evaluation(F.lit(True), F.col("_need"), F.col("agentic_iterations"), F.size("sources_tried")) == "route_source"
        source = F.array_union("sources_tried", F.array(select_source(F.col("sources_tried"))["source"]))
        fetched = lambda r: r.withColumns({"_found": web_fetch(web)(F.col("question")), "sources_tried": source})
        rows = parted(rows, go, fetched, lambda r: r.withColumn("_found", F.lit(None).cast("string")))
        more = rows.where("_found is not null").withColumns({"texts": F.concat("texts", F.array("_found")), "agentic_iterations": F.col("agentic_iterations") + 1})
        return kept(written(more.drop("_need", "_found")).unionByName(rows.where("_found is null").drop("_need", "_found")))

    def audited(rows: DataFrame) -> DataFrame:
        """With ``_grounded`` and ``_fits`` where an answer can be refused."""
        checks = {"_grounded": F.get_json_object(shared("answer", F.array_join("texts", " ")), "$.score"), "_fits": F.get_json_object(shared("question", "answer"), "$.score")}
        null = F.lit(None).cast("string")
        open_ = ~blank(F.col("answer")) & has_texts & (F.col("iterations") < rounds - 1)
        return parted(rows, open_, lambda r: r.withColumns(checks), lambda r: r.withColumns({"_grounded": null, "_fits": null}))

    kept_columns = ["query_id", "question", "question_type", "iterations", "sources_tried", "agentic_iterations"]
    open_rows = kept(questions.select(
        "query_id", "question", F.col("question").alias("asked"), F.coalesce("question_type", F.lit("factual")).alias("question_type"), F.lit(0).alias("iterations"),
        F.array(F.lit("vector_db")).alias("sources_tried"), F.lit(0).alias("agentic_iterations"),
    ))
    done = None
    for turn in range(rounds):
        hits = retrieve(open_rows.select("query_id", F.col("asked").alias("text")))
        kept_hits = graded(hits.join(open_rows.select("query_id", F.col("asked").alias("question")), "query_id"), judge)
        listed = kept_hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("d"))
        rows = open_rows.join(listed.select("query_id", F.col("d.text").alias("texts"), F.col("d.doc_id").alias("documents")), "query_id", "left")
        rows = kept(rows.withColumns({"texts": F.coalesce("texts", none), "documents": F.coalesce("documents", F.array().cast("array<bigint>"))}))
        last = turn == rounds - 1
        rows = written(rows.withColumn("_route", after_grading(F.size("texts"), F.col("iterations"), rounds - 1)))
        rows = audited(extended(rows) if agentic else rows)
        empty = (F.size("texts") == 0) & (not last) & (F.col("_route") == "rewrite_query")
        decision = F.when(empty, "rewrite").otherwise(audit(F.col("answer"), F.size("texts"), F.col("iterations"), F.col("_grounded"), F.col("_fits"), rounds - 1))
        rows = rows.withColumn("decision", decision)
        ended = rows if last else rows.where("decision = 'end'")
        out = ended.select("query_id", "question", "answer", "documents", "iterations", "sources_tried", "agentic_iterations", F.lit("end").alias("decision"))
        done = out if done is None else done.unionByName(out)
        if not last:
            asked = rewrite(F.col("asked")) if rewrite else F.col("asked")
            again = rows.where("decision = 'rewrite'").withColumn("asked", asked).withColumn("iterations", F.col("iterations") + 1)
            open_rows = kept(again.select(*kept_columns, "asked"))
    return done
