"""The agent over tables: many questions' plans, steps, results, verdicts and retries at once.

Every stage is a DataFrame transformation; a table of runs goes through at most ``TRIES`` rounds, each of which searches,
answers and judges all runs that are still open. Model clients are plug-ins (``clients.ask``), called in batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators.clients import LanguageModel, ask
from ragloom.session import kept

TRIES = 4
HYBRID, FULLTEXT = "hybrid_search", "fulltext_search"
TOP_K, MOST_K, SECOND_K, MOST_STEPS = 40, 100, 20, 3
#: Fixed texts.
NO_DATA = "抱歉，经过多轮检索仍未能找到足够可靠的信息来准确回答您的问题。建议您：\n1. 尝试换一种方式描述问题\n2. 检查知识库中是否包含相关文档\n3. 如果问题涉及多个概念，可以拆分为单独的问题分别提问"
WARN_PARSE = "⚠️ 回答质量校验遇到异常，建议核实关键信息或换一种方式提问。"
WARN_NO_SCORES = "⚠️ 回答质量校验未通过（已重试 %d 次），请谨慎参考。"
WARN_FACTS = "⚠️ 回答中可能存在事实性错误（%s 评分 %d/5），建议直接查阅原始文档确认。"
WARN_SUPPORT = "⚠️ 部分回答内容缺乏文档依据（%s 评分 %d/5），建议对关键结论进行二次确认。"
WARN_FAIR = "💡 回答质量中等（最低维度 %d/5），部分信息可能不够准确。"
WARN_GOOD = "回答质量尚可，但仍有提升空间（最低维度 %d/5）。"
#: What the next try changes: lowest dimension, try; more results and their most; less weight of the vectors; tool; whose query.
RULES = [
    ("groundedness", 0, 0, 100, 0.2, None, "step"), ("groundedness", 1, 0, 100, 0.2, None, "step"), ("groundedness", 2, 20, 80, 0.0, FULLTEXT, "step"),
    ("relevance", 0, 20, 100, 0.0, None, "step"), ("relevance", 1, 40, 100, 0.0, None, "step"), ("relevance", 2, 60, 100, 0.0, None, "original"),
    ("consistency", 0, 10, 80, 0.1, None, "step"), ("consistency", 1, 10, 80, 0.1, None, "step"), ("consistency", 2, 10, 80, 0.1, None, "step"),
]
RULE = "lowest string, level int, more int, most int, less double, new_tool string, whose string"
Search = Callable[[DataFrame], DataFrame]


def intent(kind: Column, n_sub: Column) -> Column:
    return F.when((kind == "keyword") | ((kind == "semantic") & (n_sub == 1)), "simple").otherwise("complex")


def lowest(*names: str) -> Column:
    """The name of the first of these columns that holds the least value; null if one is null."""
    out = F.lit(names[-1])
    for n in reversed(names[:-1]):
        out = F.when(F.col(n) == F.least(*names), F.lit(n)).otherwise(out)
    return F.when(sum((F.col(n) for n in names), F.lit(0)).isNotNull(), out)


def adjust(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The next try's steps, by ``RULES``; steps(run_id, step, id, tool, query, top_k, vector_weight, depends_on),
    verdicts(run_id, retry, relevance, groundedness, consistency, original).

    From the third retry on a run has one step, the original question over everything; without scores its steps stay, a
    missing one of them counts as 5.
    """
    dims = ("groundedness", "relevance", "consistency")
    verdicts = verdicts.withColumns({d: F.when(F.coalesce(*dims).isNotNull(), F.coalesce(d, F.lit(5))) for d in dims})
    rules = F.broadcast(steps.sparkSession.createDataFrame(RULES, RULE))  # nine rows
    judged = verdicts.select("run_id", "retry", "original", lowest(*dims).alias("lowest"), F.least("retry", F.lit(2)).alias("level"))
    rows = steps.join(judged, "run_id").join(rules, ["lowest", "level"], "left")
    k, weight = F.coalesce("top_k", F.lit(TOP_K)), F.coalesce("vector_weight", F.lit(0.7))
    changed = rows.filter("retry < 3").select(
        "run_id", "step", "id", F.coalesce("new_tool", "tool").alias("tool"), F.when(F.col("whose") == "original", F.col("original")).otherwise(F.col("query")).alias("query"),
        F.when(F.col("more") > 0, F.least(k + F.col("more"), F.col("most"))).otherwise(k).cast("int").alias("top_k"),
        F.when(F.col("less") > 0, F.greatest(F.round(weight - F.col("less"), 6), F.lit(0.3))).otherwise(weight).alias("vector_weight"), "depends_on",
    )
    kinds = dict(steps.dtypes)
    last = verdicts.filter("retry >= 3").select("run_id", F.lit(0).alias("step"), F.lit("q1").alias("id"), F.lit(HYBRID).alias("tool"), F.col("original").alias("query"), F.lit(MOST_K).alias("top_k"), F.lit(0.5).alias("vector_weight"), F.array().cast("array<string>").alias("depends_on"))
    return changed.unionByName(last.withColumn("step", F.col("step").cast(kinds["step"])))


def warning(result: Column, lowest_name: Column, value: Column, retry: Column) -> Column:
    """The graded note on an answer that did not pass, by its lowest dimension."""
    return (
        F.when(result == "parse_failed", F.lit(WARN_PARSE))
        .when(lowest_name.isNull(), F.format_string(WARN_NO_SCORES, retry))
        .when(value <= 1, F.format_string(WARN_FACTS, lowest_name, value))
        .when(value <= 2, F.format_string(WARN_SUPPORT, lowest_name, value))
        .when(value <= 3, F.format_string(WARN_FAIR, value))
        .otherwise(F.format_string(WARN_GOOD, value))
    )


def _balanced(text: str, opening: str, closing: str) -> str | None:
    start, depth = text.find(opening), 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += (text[i] == opening) - (text[i] == closing)
        if not depth:
            return text[start : i + 1]
    return None


def extract_json(text: str) -> str | None:
    """The JSON in a model's answer: all of it, else a fenced block, else the first balanced braces or brackets."""
    fenced = text.split("```")[1].removeprefix("json").strip() if text.count("```") > 1 else None
    for part in (text, fenced, _balanced(text, "{", "}"), _balanced(text, "[", "]")):
        try:
            return json.dumps(json.loads(part), ensure_ascii=False)
        except (TypeError, ValueError):
            continue
    return None


def json_in(answer: str) -> Column:
    @F.pandas_udf("string")
    def found(answers: pd.Series) -> pd.Series:
        return answers.map(extract_json, na_action="ignore")

    return found(answer)


PLAN = "struct<sub_queries:array<struct<id:string,tool:string,query:string,args:struct<query:string,top_k:int,vector_weight:double>,depends_on:array<string>>>>"


def plan_steps(answers: DataFrame) -> DataFrame:
    """run_id, step, id, tool, query, top_k, vector_weight, depends_on of answers(run_id, query, answer).

    A plan has at most three steps with known tools; without one the question is a hybrid step. What a step's own
    arguments say counts, up to ``MOST_K`` results.
    """
    steps = F.filter(F.slice(F.col("p.sub_queries"), 1, MOST_STEPS), lambda s: s.isNotNull())
    planned = answers.withColumn("p", F.from_json(json_in("answer"), PLAN)).withColumn("steps", F.when(F.size(steps) > 0, steps))
    kind = PLAN.removeprefix("struct<sub_queries:").removesuffix(">")
    each = planned.select("run_id", F.col("query").alias("whole"), F.posexplode(F.coalesce("steps", F.array(F.lit(None).cast(kind.removeprefix("array<").removesuffix(">"))))).alias("step", "s"))
    text = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("s.args.query", "s.query")), "whole")
    return each.select(
        "run_id", "step", F.coalesce("s.id", F.concat(F.lit("q"), (F.col("step") + 1).cast("string"))).alias("id"), F.when(F.col("s.tool").isin(HYBRID, FULLTEXT), F.col("s.tool")).otherwise(HYBRID).alias("tool"),
        text.alias("query"), F.least(F.coalesce("s.args.top_k", F.lit(TOP_K)), F.lit(MOST_K)).alias("top_k"), F.coalesce("s.args.vector_weight", F.lit(0.7)).alias("vector_weight"), F.coalesce("s.depends_on", F.array().cast("array<string>")).alias("depends_on"),
    )


def execute(steps: DataFrame, tools: dict[str, Search], scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (run_id, place, chunk_id, content) and calls (run_id, step, tool, result_count) of all steps, in their runs'
    scope(run_id, user_id, collection_id).

    Tools are functions of a table asked(ask_id, user_id, collection_id, query, top_k, vector_weight) to
    found(ask_id, rank, chunk_id, content). Steps go in list order, so in as many rounds as the longest plan has steps; a
    step's query gets up to 100 characters of what it depends on; a step without results is asked once more by full
    text; a chunk counts where it is found first.
    """
    found, calls = [], []
    rows = steps.join(scope, "run_id")
    for step in range(MOST_STEPS):
        now = rows.filter(F.col("step") == step).withColumn("ask_id", F.col("run_id").cast("string"))
        if found:
            before = found[0]
            for more in found[1:]:
                before = before.unionByName(more)
            said = before.filter("rank <= 3").groupBy("run_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.left("content", F.lit(100)).alias("c")))), lambda x: x["c"]), "; ").alias("said"))
            need = now.select("ask_id", "run_id", F.posexplode("depends_on").alias("n", "id")).join(said, ["run_id", "id"]).groupBy("ask_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("["), "id", F.lit("]: "), F.left("said", F.lit(200)), F.lit("\n")).alias("t")))).alias("t"))
            need = need.select("ask_id", F.left(F.array_join(F.transform("t", lambda x: x["t"]), ""), F.lit(100)).alias("context"))
            now = now.join(need, "ask_id", "left").withColumn("query", F.when(F.col("context").isNotNull(), F.concat("query", F.lit(" ("), "context", F.lit(")"))).otherwise(F.col("query"))).drop("context")
        asked = ("ask_id", "user_id", "collection_id", "query", "top_k", "vector_weight")
        got = None
        for tool, search in tools.items():
            one = search(now.filter(F.col("tool") == tool).select(*asked)).select("ask_id", "rank", "chunk_id", "content", F.lit(tool).alias("tool"))
            got = one if got is None else got.unionByName(one)
        got = kept(got, "found")
        empty = now.join(got.select("ask_id"), "ask_id", "left_anti")
        again = kept(tools[FULLTEXT](empty.withColumn("top_k", F.lit(SECOND_K)).select(*asked)).select("ask_id", "rank", "chunk_id", "content", F.lit(FULLTEXT).alias("tool")), "found")
        both = got.withColumn("second", F.lit(False)).unionByName(again.withColumn("second", F.lit(True))).join(now.select("ask_id", "run_id", "step", "id"), "ask_id")
        found.append(both.select("run_id", "step", "id", "rank", "chunk_id", "content"))
        count = both.groupBy("run_id", "second").agg(F.count(F.lit(1)).alias("n"))
        of = lambda second: count.filter(F.col("second") == second).select("run_id", F.col("n").alias("result_count"))
        calls.append(now.select("run_id", "step", "tool").join(of(False), "run_id", "left").unionByName(empty.select("run_id", "step", F.lit(FULLTEXT).alias("tool")).join(of(True), "run_id", "left")))
    all_found, all_calls = found[0], calls[0]
    for f, c in zip(found[1:], calls[1:], strict=True):
        all_found, all_calls = all_found.unionByName(f), all_calls.unionByName(c)
    first = F.row_number().over(Window.partitionBy("run_id", "chunk_id").orderBy("step", "rank"))
    chunks = all_found.withColumn("n", first).filter("n = 1").withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("step", "rank", "chunk_id")))
    return chunks.select("run_id", "place", "chunk_id", "content"), all_calls.select("run_id", "step", "tool", F.coalesce("result_count", F.lit(0)).cast("long").alias("result_count"))


def reflect(rows: DataFrame) -> DataFrame:
    """rows(run_id, retry, answer, verdict) with again, result, relevance, groundedness, consistency and the new retry."""
    v = F.from_json(json_in("verdict"), "struct<pass:boolean,reason:string,scores:struct<relevance:int,groundedness:int,consistency:int>>")
    judged = rows.withColumn("v", F.when(F.get_json_object(json_in("verdict"), "$").startswith("{"), v))
    result = (
        F.when(F.coalesce("answer", F.lit("")) == "", "skip").when(F.col("retry") >= TRIES, "max_retries_exhausted").when(F.col("v").isNull(), "parse_failed")
        .when(F.col("v.pass"), "passed").otherwise(F.coalesce("v.reason", F.lit("low quality")))
    )
    failed = (F.coalesce("answer", F.lit("")) != "") & (F.col("retry") < TRIES) & F.col("v").isNotNull() & ~F.coalesce("v.pass", F.lit(False))
    scores = [F.when(F.col("v").isNotNull() & (F.col("retry") < TRIES), F.col(f"v.scores.{d}")).alias(d) for d in ("relevance", "groundedness", "consistency")]
    return judged.select("run_id", "answer", failed.alias("again"), result.alias("result"), *scores, (F.col("retry") + failed.cast("int")).alias("retry"))


TRACE = "run_id, intent, plan_steps, tools_called, result, relevance, groundedness, consistency, retry, chunk_count, answer"


def run(questions: DataFrame, tools: dict[str, Search], planner: LanguageModel, writer: LanguageModel, judge: LanguageModel) -> DataFrame:
    """One trace row (``TRACE``) for each of questions(run_id, user_id, collection_id, query, intent).

    Simple questions end at once: the fixed path answers them. The others are planned, searched, answered and judged; those
    that fail are adjusted and tried again, at most ``TRIES`` times.
    """
    scope = questions.select("run_id", "user_id", "collection_id")
    simple = questions.filter("intent = 'simple'").select("run_id", "intent")
    live = kept(questions.filter("intent <> 'simple'").select("run_id", "intent", F.col("query").alias("original"), F.lit(0).alias("retry")), "runs")
    steps = kept(plan_steps(live.select("run_id", F.col("original").alias("query"), ask(F.col("original"), planner).alias("answer"))), "steps")
    done, calls = [], None
    for attempt in range(TRIES):
        chunks, made = execute(steps, tools, scope)
        chunks, made = kept(chunks, "chunks"), kept(made, "calls")
        made = made.withColumn("try", F.lit(attempt))
        calls = made if calls is None else calls.unionByName(made)
        text = chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: F.concat(F.lit("["), x["place"].cast("string"), F.lit("] "), x["content"])), "\n\n").alias("context"))
        ready = live.join(text, "run_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        answered = ready.withColumn("answer", F.when(F.col("context") == "", F.lit(NO_DATA)).otherwise(ask(F.concat("original", F.lit("\n\n"), "context"), writer)))
        judged = answered.withColumn("verdict", ask(F.concat("original", F.lit("\n\n"), F.coalesce("answer", F.lit("")), F.lit("\n\n"), "context"), judge))
        n_steps = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("plan_steps"))
        whole = kept(reflect(judged.select("run_id", "retry", "answer", "verdict")).join(live.select("run_id", "intent", "original"), "run_id").join(n_steps, "run_id").join(text.select("run_id", "chunk_count"), "run_id", "left"), "judged")
        open_, ended = whole.filter(F.col("again") & (F.col("retry") < TRIES)), whole.filter(~F.col("again") | (F.col("retry") >= TRIES))
        spent = F.col("again")
        done.append(ended.withColumns({"result": F.when(spent, "max_retries_exhausted").otherwise(F.col("result")), "answer": F.when(spent, F.lit(NO_DATA)).otherwise(F.col("answer"))}))
        if open_.isEmpty():
            break
        steps = kept(adjust(steps, open_), "steps")
        live = open_.select("run_id", "intent", "original", "retry")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    order = F.struct("try", "step", F.col("tool").alias("tool"), "result_count")
    used = calls.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["tool"].alias("tool"), x["result_count"].alias("result_count"))).alias("tools_called"))
    names = TRACE.split(", ")
    traced = out.join(used, "run_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).select(*names)
    return traced.unionByName(simple, allowMissingColumns=True).select(*names)


def event_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, seq, type, data: many answers' events, numbered in order; an append sink (``foreachBatch``) sends them on."""
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.select(key, seq.cast("int").alias("seq"), "type", "data")


def answer_events(traces: DataFrame, citations: DataFrame) -> DataFrame:
    """run_id, seq, type, data: the events that each answer's client is streamed, in order.

    traces(run_id, answer, error[, tools_called]); citations(run_id, place, chunk_id, score, snippet). A failed answer
    (``error`` not null) has an error event in place of citations, token and done.
    """
    data = lambda kind, **cols: F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in cols.items())))
    key = F.col("run_id").cast("string")
    event = lambda order, kind, **cols: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("type"), data(kind, **cols).alias("data"))
    cited = citations.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "score", "snippet"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), x["snippet"].alias("snippet"))).alias("cited"))
    rows = traces.join(cited, "run_id", "left")
    none = F.array().cast(dict(rows.dtypes)["cited"])
    steps = F.transform(F.coalesce("tools_called", F.array().cast("array<struct<tool:string,result_count:long>>")), lambda c: F.struct(F.lit(2).alias("o"), F.lit("agent_step").alias("type"), F.to_json(F.struct(F.lit("agent_step").alias("type"), c["tool"].alias("tool"), c["result_count"].alias("result_count"))).alias("data"))) if "tools_called" in traces.columns else F.array()
    head = F.array(event(0, "conversation", conversation_id=key), event(1, "status", message=F.lit("Searching...")))
    good = F.array(event(3, "citations", data=F.coalesce("cited", none)), event(4, "token", content=F.col("answer")), event(5, "done", conversation_id=key))
    bad = F.array(event(3, "error", message=F.col("error")))
    body = F.when(F.col("error").isNull(), good).otherwise(bad)
    all_ = F.concat(head, steps, body) if "tools_called" in traces.columns else F.concat(head, body)
    return rows.select("run_id", F.posexplode(all_).alias("seq", "e")).select("run_id", "seq", "e.type", "e.data")
