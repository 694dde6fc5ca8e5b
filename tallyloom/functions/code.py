"""Functions that read program text: the few that no built-in expression can stand for.

All are Arrow UDFs over plain Python helpers. Callers filter on a cheap ``contains`` first, so that most rows never reach Python.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.exprs import GENERATED_FOLDERS, GENERATED_NAMES, GENERATED_SUFFIXES
from tallyloom.schemas import EDIT_LINE_CAP, MAX_LONG, NAME_CAP

DELTA = T.StructType([T.StructField("added", T.LongType()), T.StructField("deleted", T.LongType())])
COUNTS_MAP = T.MapType(T.StringType(), T.LongType())


# -- edits ---------------------------------------------------------------------------------------


def split_lines(text: str) -> list[str]:
    """Lines without the empty one after a final line feed."""
    lines = text.split("\n")
    return lines[:-1] if lines and lines[-1] == "" else lines


def line_diff(old: str, new: str) -> tuple[int, int]:
    """(added, deleted) against a longest common subsequence of lines. Common ends are cut off first."""
    a, b = split_lines(old), split_lines(new)
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    end = 0
    while end < most - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    # one bit for each line of b: a zero says that the common subsequence grows there
    places: dict[str, int] = defaultdict(int)
    for k, y in enumerate(b):
        places[y] |= 1 << k
    whole = row = (1 << len(b)) - 1
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & whole
    common = len(b) - row.bit_count()
    return len(b) - common, len(a) - common


def capped(added: int, deleted: int) -> tuple[int, int]:
    return (0, 0) if added + deleted > EDIT_LINE_CAP else (added, deleted)


def is_generated(path: str) -> bool:
    parts = path.lower().replace("\\", "/").split("/")
    return bool(path) and (parts[-1] in GENERATED_NAMES or parts[-1].endswith(tuple(GENERATED_SUFFIXES)) or not set(parts).isdisjoint(GENERATED_FOLDERS))


def tool_edit(name: str, arguments: str | None) -> tuple[int, int]:
    try:
        args = json.loads(arguments or "")
    except ValueError:
        return 0, 0
    if not isinstance(args, dict) or is_generated(str(args.get("file_path") or "")):
        return 0, 0
    get = lambda d, k: d.get(k) if isinstance(d.get(k), str) else ""
    if name == "Write":
        return capped(len(split_lines(get(args, "content"))), 0)
    if name == "MultiEdit":
        each = [line_diff(get(e, "old_string"), get(e, "new_string")) for e in args.get("edits") or [] if isinstance(e, dict)]
        return capped(sum(x for x, _ in each), sum(y for _, y in each))
    part = {"Edit": ("old_string", "new_string"), "NotebookEdit": ("old_source", "new_source")}.get(name)
    return capped(*line_diff(*(get(args, k) for k in part))) if part else (0, 0)


def patch_edit(command: str) -> tuple[int, int]:
    """Lines that a patch adds and deletes, without those of generated files; a moved file counts by where it goes."""
    _, begun, body = command.partition("*** Begin Patch")
    if not begun:
        return 0, 0
    counts, skip = Counter(), False
    for line in body.partition("*** End Patch")[0].split("\n"):
        head = re.match(r"\*\*\* (?:Update File|Add File|Delete File|Move to):(.*)", line)
        if head:
            skip = is_generated(head[1].strip())
        elif not skip and line[:1] in "+-" and line[:3] not in ("+++", "---"):
            counts[line[:1]] += 1
    return capped(counts["+"], counts["-"])


@F.pandas_udf(DELTA)
def edit_lines(name: pd.Series, arguments: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tool_edit(n, a) for n, a in zip(name, arguments)], columns=["added", "deleted"])


@F.pandas_udf(DELTA)
def patch_lines(command: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([patch_edit(c or "") for c in command], columns=["added", "deleted"])


@F.pandas_udf(DELTA)
def text_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_diff(a or "", b or "") for a, b in zip(old, new)], columns=["added", "deleted"])


# -- outputs of commands -------------------------------------------------------------------------


def first_line(output: Column | str) -> Column:
    """The first line that isn't blank, trimmed."""
    c = F.col(output) if isinstance(output, str) else output
    return F.coalesce(F.get(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def exec_applied(output: Column | str) -> Column:
    """A wrapper's status decides where there is one; otherwise the marks of success."""
    c, first = F.col(output) if isinstance(output, str) else output, first_line(output)
    marks = c.contains("exited with code 0") | c.contains("Exit code: 0") | c.contains("Success. Updated the following files")
    return F.when(first.startswith("Script "), first == "Script completed").otherwise(marks)


def programmatic_state(output: Column | str) -> Column:
    first = first_line(output)
    return F.when(first == "Script completed", "completed").when(first == "Script failed", "failed").when(first.startswith("Script running with cell ID "), "running").otherwise("unknown")


def running_cell(output: Column | str) -> Column:
    return F.trim(F.regexp_extract(first_line(output), "^Script running with cell ID (.*)$", 1))


# How an output says that it failed.
FAILED = re.compile(r'(?:error|failed|unsupported)$|(?:error|failed|failure|unsupported):|(?:error|unsupported) |.*"is_?error":true', re.S)


def output_worked(value) -> bool:
    """Whether a tool's output, as parsed JSON or text, says that the call worked."""
    if isinstance(value, dict):
        error = value.get("error")
        if value.get("is_error") is True or value.get("isError") is True or value.get("supported") is False:
            return False
        if isinstance(value.get("status"), str) and not output_worked(value["status"]):
            return False
        if error is not None:
            return isinstance(error, str) and not error.strip()
        return all(output_worked(value[k]) for k in ("content", "output", "result", "text", "message") if k in value)
    if isinstance(value, list):
        return bool(value) and all(map(output_worked, value))
    if isinstance(value, str):
        text = value.strip().lower()
        return bool(text) and not FAILED.match(text)
    return value is not None


@F.pandas_udf(T.BooleanType())
def mcp_worked(output: pd.Series) -> pd.Series:
    def one(text):
        text = (text or "").strip()
        try:
            return output_worked(json.loads(text))
        except ValueError:
            return output_worked(text)

    return output.map(one)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no spaces; null where it isn't JSON."""

    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


# -- shell commands ------------------------------------------------------------------------------

# Programs that read a file, and words before a program that aren't it.
READERS = frozenset("bat cat fold head less more nl od sed strings tac tail view xxd".split())
WRAPPERS = frozenset("\\ command env exec nohup sudo time".split())


def skills_read(arguments: str | None) -> dict[str, int]:
    """Skills whose SKILL.md a command reads; searching, listing, writing and editing in place don't count."""
    try:
        args = json.loads(arguments or "")
    except ValueError:
        return {}
    if not isinstance(args, dict):
        return {}
    command = args.get("cmd") or args.get("command") or ""
    command = " ".join(x for x in command if isinstance(x, str)) if isinstance(command, list) else command
    found: Counter[str] = Counter()
    for part in re.split(r"\|\||&&|[|&;\n]", command if isinstance(command, str) else ""):
        words = [w for w in (x.lstrip("({") for x in part.split()) if w]
        program = next((w for w in words if w not in WRAPPERS and not re.match(r"[^/.=][^=]*=", w)), "")
        if program.rpartition("/")[2] not in READERS or "/SKILL.md" not in part:
            continue
        if program.rpartition("/")[2] == "sed" and any(re.match(r"-[^-]*i", w) for w in words):
            continue
        kept = re.sub(r"\d*>{1,2}\|?\s*(?:'[^']*'|\"[^\"]*\"|[^\s;&|]+)", " ", part)
        found.update(n[:NAME_CAP] for n in re.findall(r"/([A-Za-z0-9_.:+-]+)/SKILL\.md", kept))
    return dict(found)


@F.pandas_udf(COUNTS_MAP)
def skill_reads(arguments: pd.Series) -> pd.Series:
    return arguments.map(skills_read)


# -- scripts that call tools ---------------------------------------------------------------------

SCRIPT = re.compile(
    r"//[^\n]*|/\*.*?\*/|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|(?P<regex>(?<=[=(,:;!&|?{}\n])\s*/(?:\\.|\[(?:\\.|[^\]])*\]|[^/\n\\])+/[a-z]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>=>|[^\s\w])", re.S
)
CLOSES = {"(": ")", "[": "]", "{": "}"}
CONTROL = frozenset("if for while switch catch with".split())
# Methods that call the function they are given at once.
EAGER = frozenset("map flatMap forEach filter some every find findIndex findLast findLastIndex reduce reduceRight sort".split())


def script_tokens(script: str) -> list[tuple[str, str]]:
    """(kind, text); comments are gone, strings and patterns are one token each."""
    return [(m.lastgroup, m[0]) for m in SCRIPT.finditer(script) if m.lastgroup and m.lastgroup != "regex"]


def matching(t: list[tuple[str, str]]) -> dict[int, int]:
    """Place of each bracket's partner."""
    pair, stack = {}, []
    for k, (kind, x) in enumerate(t):
        if kind == "mark" and x in CLOSES:
            stack.append(k)
        elif kind == "mark" and x in CLOSES.values() and stack:
            pair[k] = stack.pop()
            pair[pair[k]] = k
    return pair


def functions(t: list[tuple[str, str]], pair: dict[int, int]) -> list[tuple[int, int, str, bool]]:
    """(first token of the body, last, name, runs at once) of every function: its name is what calls it, ``object.property`` for a property."""
    word = lambda k: t[k][1] if 0 <= k < len(t) else ""
    out = []

    def named(k: int) -> str:
        """Name that the value beginning at k is given."""
        k -= word(k - 1) == "async"
        if word(k - 1) == "=" and t[k - 2][0] == "word":
            return word(k - 2)
        if word(k - 1) == ":" and t[k - 2][0] == "word":
            return owner(k) + word(k - 2)
        return ""

    def owner(k: int) -> str:
        """``object.`` of the literal around k, if it is assigned to a name."""
        around = [o for o, c in pair.items() if o < k < c and word(o) == "{"]
        o = max(around, default=-1)
        return word(o - 2) + "." if o > 1 and word(o - 1) == "=" and t[o - 2][0] == "word" else "?."

    def at_once(begin: int, end: int) -> bool:
        """Called where it stands, or handed to a method that calls it where it stands."""
        begin -= word(begin - 1) == "async"
        if word(begin - 1) == "(" and (word(end + 1), word(end + 2)) == (")", "("):
            return True
        return word(begin - 1) == "(" and word(begin - 2) in EAGER and word(begin - 3) == "."

    for k, (kind, x) in enumerate(t):
        if kind == "mark" and x == "=>":
            begin = pair.get(k - 1, k - 1) if word(k - 1) == ")" else k - 1
            if word(k + 1) == "{":
                end = pair.get(k + 1, len(t) - 1)
            else:
                end = k + 1
                while end + 1 < len(t) and word(end + 1) not in (",", ";", ")", "]", "}"):
                    end = pair.get(end + 1, end + 1) if word(end + 1) in CLOSES else end + 1
            out.append((k + 1, end, named(begin), at_once(begin, end)))
        elif kind == "mark" and x == "{" and word(k - 1) == ")" and k - 1 in pair:
            head = pair[k - 1]
            end = pair.get(k, len(t) - 1)
            if word(head - 1) == "function" or word(head - 2) == "function" and t[head - 1][0] == "word":
                at = head - 1 if word(head - 1) == "function" else head - 2
                out.append((k, end, (word(head - 1) if at == head - 2 else "") or named(at), at_once(at, end)))
            elif head > 0 and t[head - 1][0] == "word" and word(head - 1) not in CONTROL and word(head - 1) != "await":
                out.append((k, end, owner(head) + word(head - 1), False))
    return out


def innermost(spans: list[tuple[int, int]], n: int) -> list[int]:
    """For each of ``n`` places the nested span that begins last around it, -1 outside of all."""
    at = defaultdict(list)
    for f, (begin, end) in sorted(enumerate(spans), key=lambda s: (s[1][0], -s[1][1])):
        at[begin].append(f)
    out, open_ = [], []
    for k in range(n):
        while open_ and spans[open_[-1]][1] < k:
            open_.pop()
        open_ += at.get(k, ())
        out.append(open_[-1] if open_ else -1)
    return out


MOST_IN_CYCLE = 8


def cycles(edges: dict[int, Counter]) -> list[list[int]]:
    """The functions reached from -1, those that call each other in one group, callers' groups first."""
    index, low, stack, work, out = {}, {}, [], [(-1, None)], []
    while work:
        f, rest = work.pop()
        if rest is None:
            if f in index:
                continue
            index[f] = low[f] = len(index)
            stack.append(f)
            rest = iter(list(edges.get(f, ())))
        for g in rest:
            if g not in index:
                work += [(f, rest), (g, None)]
                break
            if g in low and g in stack:
                low[f] = min(low[f], index[g])
        else:
            if low[f] == index[f]:
                group = stack[stack.index(f) :]
                del stack[len(stack) - len(group) :]
                out.append(group)
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[f]) if f in stack else low[work[-1][0]]
    return out[::-1]


def runs(edges: dict[int, Counter]) -> Counter:
    """How often each function runs if -1 runs once: counts go down from callers to called. Among functions that call each other every chain of calls without a repetition counts; in a
    group of more than ``MOST_IN_CYCLE`` each runs once for each call from outside."""
    times = Counter({-1: 1})
    for group in cycles(edges):
        inside = set(group)
        if len(group) > 1 or group[0] in edges.get(group[0], ()):
            entered = {f: times[f] for f in group if times[f]}
            for f in group:
                times[f] = 0
            if len(group) > MOST_IN_CYCLE:
                for f in group:
                    times[f] = sum(entered.values())
            else:
                chains = [(f, n, frozenset([f])) for f, n in entered.items()]
                while chains:
                    f, n, seen = chains.pop()
                    times[f] += n
                    chains += [(g, n * m, seen | {g}) for g, m in edges.get(f, Counter()).items() if g in inside and g not in seen]
        for f in group:
            for g, m in edges.get(f, Counter()).items():
                if g not in inside:
                    times[g] += times[f] * m
    return times


def tools_reached(script: str) -> dict[str, int]:
    """MCP servers that a script's executed code calls, with how often: at the top, in functions that run at once, and in named functions by their calls.

    Text in strings, patterns and comments, and the bodies of functions that nothing calls, don't count. Nothing is run.
    """
    if "tools.mcp__" not in script:
        return {}
    t = script_tokens(script)
    pair = matching(t)
    fs = functions(t, pair)
    inner = innermost([(begin, end) for begin, end, *_ in fs], len(t))
    by_name = defaultdict(list)
    for f, x in enumerate(fs):
        if x[2]:
            by_name[x[2]].append(f)
    uses, edges = defaultdict(Counter), defaultdict(Counter)
    for f, (begin, _, _, eager) in enumerate(fs):
        if eager:  # it runs whenever what it stands in does
            edges[inner[begin - 1] if begin else -1][f] += 1
    for k, (kind, x) in enumerate(t):
        if kind != "word" or k + 1 >= len(t) or t[k + 1][1] != "(" or k + 1 not in pair:
            continue
        before = [y for _, y in t[max(0, k - 2) : k]]
        if before == ["tools", "."] and (m := re.match(r"mcp__(.*?)__(.*\S.*)$", x)):
            uses[inner[k]][m[1].strip()] += 1
        elif before[-1:] not in (["function"], ["new"]):
            known = by_name.get(f"{before[0]}.{x}" if before[-1:] == ["."] and len(before) == 2 else x, [])
            if len(known) == 1 and fs[known[0]][0] != pair[k + 1] + 1:  # not where it is declared
                edges[inner[k]][known[0]] += 1
    total: Counter[str] = Counter()
    for f, n in runs(edges).items():
        for server, m in uses[f].items() if n else ():
            total[server] = min(total[server] + n * m, MAX_LONG)
    return dict(total)


@F.pandas_udf(COUNTS_MAP)
def script_tools(script: pd.Series) -> pd.Series:
    return script.map(lambda s: tools_reached(s or ""))


def script_patch(script: str) -> str | None:
    """The patch that a top-level ``await tools.apply_patch(...)`` gets, where it is a literal or a name that a top-level literal was given."""
    t = script_tokens(script)
    depth, names = 0, {}

    def literal(k: int) -> str | None:
        kind, x = t[k]
        if kind != "string" or x[0] == "`" and "${" in x or x[0] == "'":
            return None
        if x[0] == "`":
            return re.sub(r"\\([`$\\])", r"\1", x[1:-1]).replace("\\n", "\n")
        try:
            return json.loads(x)
        except ValueError:
            return None

    for k, (_, x) in enumerate(t):
        depth += (x == "{") - (x == "}" and depth > 0)
        rest = [y for _, y in t[k : k + 7]]
        if depth == 0 and x in ("const", "let", "var") and len(rest) > 3 and rest[2] == "=" and literal(k + 3) is not None:
            names[rest[1]] = literal(k + 3)
        if depth == 0 and len(rest) == 7 and rest[:5] == ["await", "tools", ".", "apply_patch", "("] and rest[6] == ")":
            body = literal(k + 5) if t[k + 5][0] == "string" else names.get(rest[5])
            if body and "*** Begin Patch" in body:
                return body
    return None


@F.pandas_udf(T.StringType())
def script_patch_body(script: pd.Series) -> pd.Series:
    return script.map(lambda s: script_patch(s or ""))
