"""Program text, commands and tool outputs, made from the tables' columns row by row and read back by the functions that parse them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import code
from tallyloom.plans.catalogue import query
from tallyloom.plans.tables import USAGE
from tallyloom.plans.tables import usage as usage_rows


def columns() -> tuple[Column, Column, Column]:
    return F.col("n"), F.col("k"), F.col("input").cast("string")


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def one_of(by: Column, *cases: Column) -> Column:
    return F.element_at(F.array(*cases), (by % len(cases) + 1).cast("int"))


@query("f15_mcp_output_gate", f"""WITH {USAGE} SELECT source, n%6 AS form, count(*) AS n, count(*) FILTER (WHERE n%6 IN (0,4)) AS worked FROM usage GROUP BY 1,2""")
def f15(spark, d):
    """Plain text, error text, error flags at the top and inside, an empty error field, nothing."""
    n, k, value = columns()
    output = one_of(n, text("value ", value), text("Error: ", value), text('{"isError":true,"v":', value, "}"), text('{"content":[{"text":"error: ', value, '"}]}'), text('{"error":"","v":', value, "}"), F.lit(""))
    rows = usage_rows(spark, d).select("source", (n % 6).alias("form"), code.mcp_worked(output).alias("ok"))
    return rows.groupBy("source", "form").agg(F.count("*").alias("n"), F.count_if("ok").alias("worked"))


@query("f16_skill_reads", f"""WITH {USAGE} SELECT skill, count(*) AS n FROM (SELECT CASE n%4 WHEN 0 THEN 'skill'||k WHEN 1 THEN 'b'||(n%7) ELSE 'q'||(k%5) END AS skill FROM usage WHERE n%4<>2) GROUP BY 1""")
def f16(spark, d):
    """A read, a read behind a search and a wrapper, an edit in place, a read behind a redirection to a skill."""
    n, k, value = columns()
    command = one_of(
        n, text("cat /s/skill", k, "/SKILL.md"), text("rg x /s/none/SKILL.md; sudo head -3 a/b", n % 7, "/SKILL.md"), text("sed -i s/a/b/ /s/skill", k, "/SKILL.md"), text("cat x > /s/none/SKILL.md && FOO=1 sed -n 1p /q", k % 5, "/SKILL.md")
    )
    read = code.skill_reads(text('{"cmd": "', F.replace(command, F.lit("/q"), F.lit("/x/q")), '"}'))
    return usage_rows(spark, d).select(F.explode(read).alias("skill", "times")).groupBy("skill").agg(F.sum("times").alias("n"))


@query("f18_script_tools", f"""WITH {USAGE} SELECT server, CAST(sum(times) AS BIGINT) AS n FROM (SELECT 'srv'||k AS server, n%4*2 AS times FROM usage WHERE n%4>0 UNION ALL SELECT 'each', 1 FROM usage UNION ALL SELECT 'idle', 1 FROM usage WHERE n%5=0) GROUP BY 1""")
def f18(spark, d):
    """A function that is called by another none to six times, one that runs at once, one that is called in a fifth of the scripts, and names in strings and comments."""
    n, k, value = columns()
    script = text(
        "// tools.mcp__none__x()\nasync function t() { await tools.mcp__srv", k, "__x({}); }\nfunction twice() { t(); t(); }\nconst s = \"tools.mcp__none__x()\";\n", F.repeat(F.lit("twice();\n"), (n % 4).cast("int")),
        "items.map(i => { tools.mcp__each__y(i); });\nconst idle = () => tools.mcp__idle__x({});\n", F.when(n % 5 == 0, "idle();\n").otherwise(""),
    )
    return usage_rows(spark, d).select(F.explode(code.script_tools(script)).alias("server", "times")).groupBy("server").agg(F.sum("times").alias("n"))


@query("f19_script_patch", f"""WITH {USAGE} SELECT n, CASE n%4 WHEN 3 THEN NULL ELSE '*** Begin Patch'||chr(10)||'+'||input||chr(10)||'*** End Patch' END AS patch FROM usage""")
def f19(spark, d):
    """A patch in a constant, as a literal, as a template, and one that only a function would apply."""
    n, k, value = columns()
    body = text("*** Begin Patch\\n+", value, "\\n*** End Patch")
    script = one_of(n, text('const p = "', body, '";\nawait tools.apply_patch(p);'), text('await tools.apply_patch("', body, '");'), text("await tools.apply_patch(`", body, "`);"), text('async function never() { await tools.apply_patch("', body, '"); }'))
    return usage_rows(spark, d).select("n", code.script_patch_body(script).alias("patch"))
