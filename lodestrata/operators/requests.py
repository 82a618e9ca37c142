"""What a user types: modes, fields, and the rows that answer without the catalog.

Modes and answers are column expressions, so a table of inputs is handled at once; the
fields of one file search are split on the driver, for they shape the plan.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import search_url
from .search import FileQuery

#: Prefixes of the modes; web engines by prefix, with name and template.
REGEX, COMMAND = "re:", ">"
ENGINES = {
    "bd": ("Baidu", "https://www.baidu.com/s?wd={query}"),
    "ddg": ("DuckDuckGo", "https://duckduckgo.com/?q={query}"),
    "g": ("Google", "https://www.google.com/search?q={query}"),
}
#: Scores of answers.
CALCULATOR, COMMAND_ROW, WEB, DISABLED = 900, 850, 800, 700

_QUOTES = '"“”'
_TOKEN = re.compile(f"(?:[{_QUOTES}][^{_QUOTES}]*(?:[{_QUOTES}]|\\Z)|[^\\s{_QUOTES}])+")
_FIELDS = {"type": "types", "name": "names", "dir": "dirs", "content": "contents"}


def file_query(text: str) -> FileQuery:
    """The constraints of a file search: ``field:value``, ``field: value``, quoted words, and plain terms."""
    tokens = [t for t in (re.sub(f"[{_QUOTES}]", "", t) for t in _TOKEN.findall(text)) if t]
    found: dict[str, list[str]] = {"terms": [], **{v: [] for v in _FIELDS.values()}}
    waiting = None  # a field whose value is the next token
    for k, token in enumerate(tokens):
        name, _, value = token.partition(":")
        field = _FIELDS.get(name.lower()) if ":" in token else None
        if waiting:
            found[waiting].append(token)
            waiting = None
        elif field and value:
            found[field].append(value)
        elif field and k + 1 < len(tokens):
            waiting = field
        else:
            found["terms"].append(token)
    found["types"] = [t for t in (x.lstrip(".").lower() for x in found["types"]) if t]
    return FileQuery(**{k: tuple(v) for k, v in found.items()})


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def request(text: Column, engines: tuple[str, ...] = tuple(ENGINES)) -> Column:
    """mode (regex, command, web or normal), prefix (of a web search) and text of what was typed."""
    typed = _trimmed(text)

    def parts(mode: str, rest: Column, prefix: str | None = None) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(prefix).cast("string").alias("prefix"), _trimmed(rest).alias("text"))

    def after(prefix: str) -> Column:
        return F.substring(typed, len(prefix) + 1, 1 << 30)

    out = parts("normal", typed)
    for p in reversed(engines):
        out = F.when(typed.rlike(rf"^{re.escape(p)}\s"), parts("web", after(p), p)).when(typed.startswith(f"{p}:"), parts("web", after(f"{p}:"), p)).otherwise(out)
    return F.when(typed.startswith(REGEX), parts("regex", after(REGEX))).when(typed.startswith(COMMAND), parts("command", after(COMMAND))).otherwise(out)


_NUMBER = re.compile(r"\d+\.?\d*|\.\d+")


def calculated(text: str) -> float | None:
    """Value of an expression of + - * / ^ ( ) sqrt and hexadecimal numbers, null if it is none.

    A per cent sign divides by 100 where it stands; a minus sign binds before a power.
    """
    text = text.strip()
    if not re.search(r"[0-9+\-*/^().%]", text) or not re.fullmatch(r"[0-9a-fA-F\s+\-*/^().%xXsqrt]+", text):
        return None
    text = re.sub(r"\s+", " ", re.sub(r"0[xX]([0-9a-fA-F]+)", lambda m: str(int(m[1], 16)), text).replace("%", "/100"))
    at = 0

    def taken(*signs: str) -> str | None:
        nonlocal at
        while text[at : at + 1] == " ":
            at += 1
        for s in signs:
            if text.startswith(s, at):
                at += len(s)
                return s
        return None

    def chain(operand, operators: dict) -> float:
        value = operand()
        while sign := taken(*operators):
            value = operators[sign](value, operand())
        return value

    def total() -> float:
        return chain(product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def product() -> float:
        return chain(power, {"*": lambda a, b: a * b, "/": lambda a, b: a / b})

    def power() -> float:
        base = factor()
        return math.pow(base, power()) if taken("^") else base

    def factor() -> float:
        nonlocal at
        if taken("-"):
            return -factor()
        root = taken("sqrt")
        if taken("("):
            value = total()
            if not taken(")"):
                raise ValueError("no closing bracket")
            return math.sqrt(value) if root else value
        found = _NUMBER.match(text, at)
        if root or not found:
            raise ValueError("no number")
        at = found.end()
        return float(found[0])

    try:
        value = total()
    except (ValueError, ArithmeticError, RecursionError):
        return None
    return value if at == len(text.rstrip()) and math.isfinite(value) else None


def number_text(value: float) -> str:
    """A whole number without a point, else ten decimals at most."""
    whole = abs(math.fmod(value, 1)) < 2.0**-52
    return f"{value:.0f}" if whole else f"{value:.10f}".rstrip("0").rstrip(".")


@F.pandas_udf(StringType())
def calculator(text: pd.Series) -> pd.Series:
    """The value of each expression as text, null where it is none."""
    values = text.map(lambda t: None if t is None else calculated(t))
    return values.map(lambda v: None if v is None or v != v else number_text(v))


def answers(requests: DataFrame, commands: bool = False, engines: dict[str, tuple[str, str]] = ENGINES) -> DataFrame:
    """key, id, title, detail, kind, provider, action, score: rows that answer (key, mode, prefix, text) themselves.

    A calculator's for normal requests, a web search for those with an engine's prefix, a
    command's (or, where commands are off, a hint) for commands.
    """

    def rows(of: DataFrame, id_: Column, title: Column, detail: Column, kind: str, provider: str, action: Column, score: int) -> DataFrame:
        return of.select("key", id_.alias("id"), title.alias("title"), detail.alias("detail"), F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), action.alias("action"), F.lit(score).cast("long").alias("score"))

    text = F.col("text")
    sums = requests.where("mode = 'normal'").where(text.rlike(r"^[0-9a-fA-F\s+\-*/^().%xXsqrt]+$")).withColumn("value", calculator("text")).where("value is not null")
    found = [rows(sums, F.concat(F.lit("calculator:"), "text"), F.col("value"), text, "calculator", "calculator", F.concat(F.lit("copy:"), "value"), CALCULATOR)]
    known = requests.sparkSession.createDataFrame([(p, *e) for p, e in engines.items()], "prefix string, name string, template string")
    web = requests.where("mode = 'web'").join(F.broadcast(known), "prefix")  # a row for each engine
    url = reduce(lambda out, p: F.when(F.col("prefix") == p, search_url(engines[p][1], text)).otherwise(out), engines, F.lit(None).cast("string"))
    found.append(rows(web, F.concat(F.lit("web:"), "prefix", F.lit(":"), "text"), F.concat("name", F.lit(": "), "text"), F.col("template"), "web_search", "web-search", F.concat(F.lit("open_url:"), url), WEB))
    run = requests.where("mode = 'command' and text != ''")
    if commands:
        found.append(rows(run, F.concat(F.lit("command:"), "text"), text, F.lit("runs in a terminal once confirmed"), "command", "commands", F.concat(F.lit("confirm:"), "text"), COMMAND_ROW))
    else:
        found.append(rows(run, F.lit("commands:disabled"), F.lit("commands are off"), F.concat(F.lit(f"{COMMAND} "), "text"), "feedback", "commands", F.lit("copy:turn commands on in the settings"), DISABLED))
    return reduce(DataFrame.unionByName, found)
