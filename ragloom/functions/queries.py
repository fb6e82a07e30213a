"""Query understanding as column expressions: rewriting, classes, decomposition, weights, coreference.

A model's answers are columns too (see ``operators.clients.ask``): null where the model failed or was not asked.
History columns are arrays of struct(role, content) in order of time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.text import SPACE, strip

#: Openers and closing particles that a rewrite drops.
OPENERS = "请问|请教一下|我想知道|帮我|告诉我|能说下|可以说下|说说|讲讲"
PARTICLES = "吗|呢|吧|啊|呀|哈|嘛|哦"
#: Quoted spans and identifiers that ask for exact words.
EXACT = r""""[^\n]+?"|'[^\n]+?'|[\p{L}\p{N}_]{8,}-[\p{L}\p{N}_]{4,}"""
#: What the rules take for a comparison and for several entities.
COMPARISON = r"对比|区别|不同|差异|比较|分别|各自|vs|versus|和[^\n]*的区"
ENTITIES = r"(和|与|以及|跟|同)[^\n]*(的|之间|关系|联系)"
#: Connectors, in the order they are tried.
COMPARE_JOINTS = ("对比", "比较", "vs", "versus", "和", "与", "跟")
MULTI_JOINTS = ("和", "与", "以及", "跟")
#: Words that refer back, those that do so at the start, and those that are replaced there.
PRONOUNS = "它|他|她|这个|那个|这|那|其|此|上面|前面|刚刚"
LEADING = "它|他|她|这个|那个|这|那|其|此"
REPLACED = "它|他|她|这个|那个"
#: Entities before a possessive mark, and terms that a rewrite may not invent.
TOPIC = r"([一-鿿A-Za-z0-9\x09-\x0d\x1c-\x20\x85\p{Z}\-\.]{2,15})(?:的|之)"
TERMS = r"[一-鿿]{2,8}|[A-Z][a-zA-Z0-9\-]+"
KINDS = ("keyword", "semantic", "compare", "multi_hop")
CLASS = "struct<kind:string,sub_types:array<string>,has_keyword:boolean>"


def rewrite(query: Column) -> Column:
    """One leading opener and one trailing particle after white space go."""
    opened = F.regexp_replace(strip(query), rf"^({OPENERS}){SPACE}*", "")
    return strip(F.regexp_replace(opened, rf"{SPACE}+({PARTICLES}){SPACE}*\z", ""))


def is_keyword(query: Column) -> Column:
    return query.rlike(EXACT)


def _class(kind: str, subs: list[str], keyword: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*map(F.lit, subs)).alias("sub_types"), F.lit(keyword).alias("has_keyword"))


def fallback_class(query: Column) -> Column:
    """struct(kind, sub_types, has_keyword) by rules alone."""
    compare, multi = query.rlike(COMPARISON), query.rlike(ENTITIES)
    return (
        F.when(compare & multi, _class("multi_hop", ["compare", "multi_hop"], False))
        .when(compare, _class("compare", ["compare"], False))
        .when(multi, _class("multi_hop", ["multi_hop"], False))
        .otherwise(_class("semantic", ["semantic"], False))
    )


def parsed_class(answer: Column) -> Column:
    """The class in a model's JSON answer, which may stand in a fence; null unless it is a JSON object."""
    fenced = F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)```", 1)
    text = strip(F.when(answer.rlike(r"```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(answer))
    whole = F.get_json_object(text, "$")
    x = F.from_json(text, "query_type string, sub_types array<string>, has_keyword boolean")
    named = F.coalesce(x["query_type"], F.lit("semantic"))
    kind = F.when(named.isin(*KINDS), named).otherwise("semantic")
    out = F.struct(kind.alias("kind"), F.coalesce(x["sub_types"], F.array(named)).alias("sub_types"), F.coalesce(x["has_keyword"], F.lit(False)).alias("has_keyword"))
    return F.when(whole.isNotNull() & whole.startswith("{"), out)


def classify(query: Column, answer: Column | None = None) -> Column:
    """Exact words decide first, then the model's answer, then the rules."""
    rules = fallback_class(query).cast(CLASS)
    other = rules if answer is None else F.coalesce(parsed_class(answer).cast(CLASS), rules)
    return F.when(is_keyword(query), _class("keyword", ["keyword"], True).cast(CLASS)).otherwise(other)


def rule_class(query: Column) -> Column:
    return classify(query)


def _split_at(query: Column, joints: tuple[str, ...]) -> Column:
    tries = []
    for j in joints:
        at = F.instr(query, j)
        left, right = strip(F.substring(query, F.lit(1), at - 1)), strip(F.substring(query, at + len(j), F.length(query)))
        tries.append(F.when((at > 0) & (F.length(left) > 1) & (F.length(right) > 1), F.array(left, right)))
    return F.coalesce(*tries)


def decompose(query: Column, kind: Column, sub_types: Column) -> Column:
    """array of sub-queries: a comparing or multi-hop query of several types is cut at the first connector of its list
    that leaves two parts of over one character; any other query is its rewritten self."""
    parts = F.when(kind == "compare", _split_at(query, COMPARE_JOINTS)).when(kind == "multi_hop", _split_at(query, MULTI_JOINTS))
    gate = kind.isin("compare", "multi_hop") & (F.size(sub_types) > 1)
    return F.when(gate, F.coalesce(parts, F.array(query))).otherwise(F.array(rewrite(query)))


def weights(has_keyword: Column) -> Column:
    one = lambda v, t: F.struct(F.lit(v).alias("vector_weight"), F.lit(t).alias("text_weight"))
    return F.when(has_keyword, one(0.3, 0.7)).otherwise(one(0.7, 0.3))


def topics(text: Column) -> Column:
    """Distinct topic entities: 2-15 characters before a possessive mark."""
    found = F.regexp_extract_all(text, F.lit(TOPIC), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: F.length(x) >= 2))


def last_user(history: Column, window: int | None = None) -> Column:
    """The content of the last user turn (among the last ``window`` turns), null without one."""
    some = history if window is None else F.slice(history, F.greatest(F.size(history) - window + 1, F.lit(1)), F.lit(window))
    return F.try_element_at(F.transform(F.filter(some, lambda m: m["role"] == "user"), lambda m: m["content"]), F.lit(-1))


def as_users(history: Column) -> Column:
    """The last three of an array of texts, all taken for user turns."""
    return F.transform(F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), F.lit(3)), lambda t: F.struct(F.lit("user").alias("role"), t.alias("content")))


def fast_resolve(query: Column, history: Column) -> Column:
    """A leading pronoun becomes the only topic of the last user turn of the last four; else the query as it is."""
    t = topics(last_user(history, 4))
    named = F.regexp_replace(query, F.lit(f"^({REPLACED})"), F.regexp_replace(F.get(t, F.lit(0)), r"([\\$])", r"\\$1"))
    return F.when(query.rlike(f"^({REPLACED})") & (F.size(t) == 1), named).otherwise(query)


def needs_context(query: Column, history: Column) -> Column:
    return F.coalesce(F.size(history) > 0, F.lit(False)) & query.rlike(PRONOUNS)


def history_lines(history: Column, turns: int = 6, chars: int = 200) -> Column:
    """The last turns as a model is shown them, one line each."""
    some = F.slice(history, F.greatest(F.size(history) - turns + 1, F.lit(1)), F.lit(turns))
    return F.array_join(F.transform(some, lambda m: F.concat(F.when(m["role"] == "user", "Q: ").otherwise("A: "), F.left(m["content"], F.lit(chars)))), "\n")


def model_rewrite(answer: Column) -> Column:
    """The first line of a model's answer, if it has over two characters."""
    line = strip(F.split(strip(answer), "\n")[0])
    return F.when(F.length(line) > 2, line)


def valid_rewrite(original: Column, new: Column, history: Column) -> Column:
    """There are new terms, each occurs in the history, and the text is at most three times as long."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(TERMS), F.lit(0)))
    added = F.array_except(terms(new), terms(original))
    said = F.array_join(F.transform(history, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    return (F.size(added) > 0) & F.forall(added, lambda w: F.contains(said, w)) & (F.length(new) <= 3 * F.length(original))


def fallback(query: Column, user: Column) -> Column:
    return F.when(user.isNotNull(), F.concat(user, F.lit("，"), query)).otherwise(query)


def resolve(query: Column, history: Column, answer: Column | None = None) -> Column:
    """The query with its references resolved: fast rule, then a model's valid rewrite, then the last user turn put before it."""
    fast = fast_resolve(query, history)
    out = fallback(query, last_user(history))
    if answer is not None:
        new = model_rewrite(answer)
        out = F.when(new.isNotNull() & valid_rewrite(query, new, history), new).otherwise(out)
    return F.when(~needs_context(query, history), query).when(fast != query, fast).otherwise(out)


def analyse(query: Column, history: Column | None = None, answer: Column | None = None) -> Column:
    """struct(original, resolved, rewritten, kind, sub_types, has_keyword, sub_queries, vector_weight, text_weight).

    ``history`` holds texts, of which the last three count as user turns; ``answer`` is a model's class of the query.
    """
    q = strip(query)
    q = q if history is None else F.when(F.coalesce(F.size(history) > 0, F.lit(False)), fast_resolve(q, as_users(history))).otherwise(q)
    c = classify(q, answer)
    w = weights(c["has_keyword"])
    return F.struct(
        query.alias("original"), q.alias("resolved"), rewrite(q).alias("rewritten"), c["kind"].alias("kind"), c["sub_types"].alias("sub_types"), c["has_keyword"].alias("has_keyword"),
        decompose(q, c["kind"], c["sub_types"]).alias("sub_queries"), w["vector_weight"].alias("vector_weight"), w["text_weight"].alias("text_weight"),
    )
