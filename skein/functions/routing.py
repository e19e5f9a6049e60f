"""Labels, routes and plans of queries, as columns: every branch is data, so that batches of queries run as one plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions import text as T

# Signals are substrings of the lower-cased query, tested in this order of groups.
ITERATIVE = ("compare", "versus", "vs", "difference between", "analyze", "trend", "over time", "both", "all quarters")
STANDARD = ("our", "we", "company", "policy", "plan", "revenue", "customer", "product", "api", "enterprise", "q1", "q2", "q3", "q4", "2024")
DIRECT = ("what is", "define", "explain", "how does", "what are", "tell me about", "describe", "meaning of")
STRUCTURED_WORDS = ("revenue", "employee", "count", "how many", "metrics", "latency", "uptime", "number", "stats", "data")
WEB_WORDS = ("latest", "recent", "current", "2024", "news", "today", "now")
VECTOR_WORDS = ("what", "how", "explain", "why", "rag")
#: Cosines from which a hit is correct or ambiguous.
CORRECT, AMBIGUOUS = 0.75, 0.45
#: Weights of relevance, support and use, and what their labels are worth.
WEIGHTS = (0.2, 0.5, 0.3)
SUPPORT = {"fully": 1.0, "partially": 0.5, "no": 0.0}
USE = {"high": 1.0, "medium": 0.6, "low": 0.2}


def strategy(query: Column) -> Column:
    """iterative, standard or direct; standard where nothing matches."""
    return F.when(T.has_any(query, ITERATIVE), "iterative").when(T.has_any(query, STANDARD), "standard").when(T.has_any(query, DIRECT), "direct").otherwise("standard")


def routes(query: Column) -> Column:
    """The retrievers of a query, in order: structured, web, vector."""
    structured, web = T.has_any(query, STRUCTURED_WORDS), T.has_any(query, WEB_WORDS)
    vector = ~(structured | web) | T.has_any(query, VECTOR_WORDS)
    return F.array_compact(F.array(F.when(structured, "structured"), F.when(web, "web"), F.when(vector, "vector")))


def relevance(score: Column) -> Column:
    return F.when(score >= CORRECT, "correct").when(score >= AMBIGUOUS, "ambiguous").otherwise("wrong")


def is_relevant(score: Column) -> Column:
    return F.when(score > 0.5, "relevant").otherwise("irrelevant")


def support(passage: Column, doc: Column) -> Column:
    return T.let(T.overlap_share(passage, doc), lambda share: F.when(share > 0.3, "fully").when(share > 0.1, "partially").otherwise("no"))


def usefulness(passage: Column) -> Column:
    return T.let(T.word_count(passage), lambda n: F.when(n > 20, "high").when(n > 10, "medium").otherwise("low"))


def composite(isrel: Column, issup: Column, isuse: Column) -> Column:
    def worth(label: Column, table: dict[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for name, value in table.items():
            out = F.when(label == name, F.lit(value)).otherwise(out)
        return out

    return WEIGHTS[0] * F.when(isrel == "relevant", 1.0).otherwise(0.0) + WEIGHTS[1] * worth(issup, SUPPORT) + WEIGHTS[2] * worth(isuse, USE)


def retrieves(query: Column) -> Column:
    """Whether a query is worth a retrieval: always, if there is one."""
    return F.when(query.isNotNull(), "yes").otherwise("no")


def action(n_correct: Column, n_ambiguous: Column) -> Column:
    """What the labels of a query's hits ask for: correct with a correct one, else ambiguous with such, else wrong."""
    return F.when(n_correct > 0, "correct").when(n_ambiguous > 0, "ambiguous").otherwise("wrong")


def appended(history: Column, role: Column, text: Column, most: int = 6) -> Column:
    """A history, an array of (role, text), with one message more, cut to the last `most` ones."""
    whole = F.concat(F.coalesce(history, F.array().cast("array<struct<role:string,text:string>>")), F.array(F.struct(role.alias("role"), text.alias("text"))))
    return F.slice(whole, F.greatest(F.lit(1), F.size(whole) - most + 1), F.lit(most))


def rewritten(query: Column, prefix: str = "detailed explanation of ") -> Column:
    return F.concat(F.lit(prefix), query)


def in_conversation(query: Column, last_answer: Column, empty: Column) -> Column:
    """The query with the start of the last answer; unchanged where there is no history."""
    return F.when(empty, query).otherwise(F.concat(query, F.lit(" (in the context of: "), F.substring(F.coalesce(last_answer, F.lit("")), 1, 80), F.lit("...)")))


def calculate(expression: str | None) -> str:
    """Value of an arithmetic expression over numbers, + - * / // % ** and brackets; anything else is an error text.

    So are, for safety, expressions of more than 200 characters, powers above 64 and powers of numbers above a million.
    """
    import ast
    import operator as op

    binary = {ast.Add: op.add, ast.Sub: op.sub, ast.Mult: op.mul, ast.Div: op.truediv, ast.Mod: op.mod, ast.FloorDiv: op.floordiv}

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            base, power = value(node.left), value(node.right)
            if abs(power) > 64 or abs(base) > 1e6:
                raise ValueError("power out of range")
            return base**power
        if isinstance(node, ast.BinOp) and type(node.op) in binary:
            return binary[type(node.op)](value(node.left), value(node.right))
        raise ValueError("not arithmetic")

    try:
        if expression is None or len(expression) > 200:
            raise ValueError("no expression of usable length")
        return f"Calculation result: {expression} = {value(ast.parse(expression.strip(), mode='eval'))}"
    except Exception as e:
        return f"Calculation error: {e}"


@F.pandas_udf(StringType())
def calculated(expressions: pd.Series) -> pd.Series:
    """calculate() over a column, in Arrow batches."""
    return expressions.map(lambda e: calculate(None if e is None else str(e)))
