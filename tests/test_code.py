"""Functions over program text: golden cases."""

from tallyloom.functions import code


def test_line_diff():
    assert code.line_diff("a\nb\nc", "a\nx\nc\nd\n") == (2, 1)
    assert code.line_diff("", "a\nb\n") == (2, 0)
    assert code.line_diff("a\nb", "") == (0, 2)
    assert code.line_diff("same\n", "same") == (0, 0)


def test_tool_edits():
    assert code.tool_edit("Edit", '{"file_path":"a.py","old_string":"x","new_string":"y\\nz"}') == (2, 1)
    assert code.tool_edit("Write", '{"file_path":"a.py","content":"1\\n2\\n3\\n"}') == (3, 0)
    assert code.tool_edit("MultiEdit", '{"file_path":"a","edits":[{"old_string":"a","new_string":"b"},{"old_string":"","new_string":"c"}]}') == (2, 1)
    assert code.tool_edit("NotebookEdit", '{"old_source":"a","new_source":"a\\nb"}') == (1, 0)
    assert code.tool_edit("Edit", '{"file_path":"node_modules/a.js","old_string":"x","new_string":"y"}') == (0, 0)
    assert code.tool_edit("Write", '{"file_path":"a","content":"' + "x\\n" * 2001 + '"}') == (0, 0)
    assert code.tool_edit("Other", "{}") == code.tool_edit("Edit", None) == code.tool_edit("Edit", "[1]") == (0, 0)


def test_patches():
    patch = "cd x && apply_patch <<E\n*** Begin Patch\n*** Update File: a.py\n@@\n-x\n+y\n+z\n--- no\n*** Update File: yarn.lock\n+skip\n*** Update File: dist/a\n*** Move to: src/a\n+moved\n*** End Patch\n+after"
    assert code.patch_edit(patch) == (3, 1)
    assert code.patch_edit("no patch +a") == (0, 0)


def test_outputs():
    assert [code.output_worked(x) for x in ("ok", "", "Error: no", "failed", {"isError": True}, {"content": [{"text": "error: x"}]}, {"error": ""}, {"error": {"c": 1}}, [], None, {"status": "done"})] == [True, False, False, False, False, False, True, False, False, False, True]


def test_skill_reads():
    read = lambda c: code.skills_read('{"cmd": "%s"}' % c)
    assert read("cat /s/deploy/SKILL.md") == {"deploy": 1}
    assert read("rg x /s/deploy/SKILL.md; sudo head -3 a/b/SKILL.md") == {"b": 1}
    assert read("sed -i s/a/b/ /s/deploy/SKILL.md") == {}
    assert read("cat x > /s/deploy/SKILL.md && FOO=1 sed -n 1p /q/SKILL.md") == {"q": 1}
    assert code.skills_read('{"command": ["bash", "-lc", "x"]}') == code.skills_read(None) == {}


SCRIPT = """
// tools.mcp__comment__x()
const text = "tools.mcp__quoted__x()";
await tools.mcp__top__a({});
function never() { tools.mcp__never__x({}); }
async function twice() { await tools.mcp__twice__x({}); }
await twice(); await twice();
const arrow = async () => await tools.mcp__arrow__x({ a: 1 });
await arrow();
const idle = () => tools.mcp__idle__x({});
const o = { run: async () => { await tools.mcp__prop__x({}); }, method() { tools.mcp__method__x({}); }, not() { tools.mcp__not__x({}); } };
o.run(); o.method();
(async () => { await tools.mcp__iife__x({}); })();
items.map(async item => await tools.mcp__mapped__x({ item }));
if (enabled) await tools.mcp__cond__x({});
await Promise.all([tools.mcp__all__x({}), tools.mcp__all__y({})]);
function outer() { twice(); }
"""


def test_script_reachability():
    assert code.tools_reached(SCRIPT) == {"top": 1, "twice": 2, "arrow": 1, "prop": 1, "method": 1, "iife": 1, "mapped": 1, "cond": 1, "all": 2}
    assert code.tools_reached(SCRIPT + "outer(); outer();")["twice"] == 4
    assert code.tools_reached("function r() { r(); tools.mcp__rec__x(); } r();") == {"rec": 1}


def test_script_patches():
    body = "*** Begin Patch\n*** Update File: a\n@@\n-x\n+y\n*** End Patch"
    assert code.script_patch('const p = "*** Begin Patch\\n*** Update File: a\\n@@\\n-x\\n+y\\n*** End Patch"; await tools.apply_patch(p);') == body
    assert code.script_patch(f"await tools.apply_patch(`{body}`);") == body
    assert code.script_patch('const p = "noop"; text(p);') is None
    assert code.script_patch('function f() { await tools.apply_patch("*** Begin Patch"); }') is None
    assert code.script_patch("await tools.apply_patch(`*** Begin Patch ${x}`);") is None


def test_methods_that_call_at_once():
    for name in "map flatMap forEach filter some every find findIndex findLast findLastIndex reduce reduceRight sort".split():
        assert code.tools_reached(f"xs.{name}(() => {{ tools.mcp__srv__go(); }});") == {"srv": 1}, name
    for name in "all allSettled any race then".split():
        assert code.tools_reached(f"xs.{name}(() => {{ tools.mcp__srv__go(); }});") == {}, name
    assert code.line_diff("a\n" * 20_000 + "x", "a\n" * 20_000 + "y") == (1, 1)
    assert code.line_diff("a\nb\na", "a\nb\na\nb\na") == (2, 0)


def test_line_diff_equals_a_longest_common_subsequence():
    import random
    import time

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        text = lambda rows: "".join(r + "\n" for r in rows)
        assert code.line_diff(text(a), text(b)) == (len(b) - table[-1][-1], len(a) - table[-1][-1])
    big = ["\n".join(str(rng.randrange(50)) for _ in range(20_000)) for _ in range(2)]
    start = time.perf_counter()
    code.line_diff(*big)
    assert time.perf_counter() - start < 3


def brute_runs(edges):
    from collections import Counter

    times = Counter()
    todo = [(-1, 1, ())]
    while todo:
        f, n, path = todo.pop()
        times[f] += n
        todo += [(g, n * m, (*path, g)) for g, m in edges.get(f, {}).items() if g not in path]
    return {f: n for f, n in times.items() if n}


def test_runs_of_functions_that_call_each_other():
    import random
    import time
    from collections import Counter

    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 7)
        edges = {f: Counter({g: rng.randrange(1, 3) for g in range(n) if rng.random() < 0.3}) for f in range(-1, n)}
        assert {f: k for f, k in code.runs(edges).items() if k} == brute_runs(edges), edges
    layers = 40  # 2^40 ways down
    script = "".join(f"function a{k}() {{ a{k + 1}(); a{k + 1}(); }}\n" for k in range(layers)) + f"function a{layers}() {{ tools.mcp__deep__x(); }}\na0();"
    start = time.perf_counter()
    assert code.tools_reached(script) == {"deep": 2**layers}
    ring = "".join(f"function r{k}() {{ tools.mcp__ring__x(); r{(k + 1) % 30}(); r{(k + 7) % 30}(); }}\n" for k in range(30)) + "r0();"
    assert code.tools_reached(ring) == {"ring": 30} and time.perf_counter() - start < 1
