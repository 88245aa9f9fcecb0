"""The SQL console: read-only statements over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Rows that the console shows of a result.
SHOWN = 2000
#: Plans that only tell something of tables or plans.
_TELLS = re.compile(r"(?:Show|Describe|Explain)\w*")


def statements(text: str) -> list[str]:
    """The statements of a text, cut at semicolons outside quotes and comments."""
    out, part, i = [], [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|[/-]", text, re.S):
        if m.group() == ";":
            out.append("".join(part))
            part = []
        else:
            part.append(m.group())
        i = m.end()
    return [s.strip() for s in [*out, "".join(part) + text[i:]] if s.strip()]


def reads_only(spark: SparkSession, statement: str) -> bool:
    """Whether Spark's own parser finds nothing in the statement that writes, changes or sets."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    loader = plan.getClass().getClassLoader()
    barred = [loader.loadClass(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in ("Command", "ParsedStatement", "CompoundPlanStatement")]
    if _TELLS.fullmatch(plan.getClass().getSimpleName()):
        return True
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if any(c.isInstance(node) for c in barred):
            return False
        for below in (node.children(), node.innerChildren()):
            # Inner children may be expressions, which hold no statements.
            nodes += [x for x in (below.apply(i) for i in range(below.size())) if hasattr(x, "innerChildren")]
    return True


def console(spark: SparkSession, tables: dict[str, DataFrame], text: str, shown: int | None = SHOWN) -> DataFrame:
    """The result of the last statement. Only statements that read are run; others raise ValueError before any is run."""
    parts = statements(text)
    parts = [s for s in parts if re.sub(r"--[^\n]*|/\*.*?\*/", " ", s, flags=re.S).strip()]
    for s in parts:
        if not reads_only(spark, s):
            raise ValueError(f"only statements that read are run: {s.split()[0]}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    result = None
    for s in parts:
        result = spark.sql(s)
    if result is None:
        raise ValueError("no statement")
    return result.limit(shown) if shown is not None else result
