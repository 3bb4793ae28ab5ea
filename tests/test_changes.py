"""Plans of frontmatter changes, normalised notes and generated regions against plain versions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quillspark.operators import frontmatter as FM
from quillspark.operators import regions as RG

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
START, END = (re.compile(rf"^<!-- GENERATED:([a-z0-9_]+):{k}", re.M) for k in (r"START -->\r?\n", r"END -->\r?\n?"))


def plain_regions(text):
    """By offsets in the text: (key, begin, after its START line, begin of its END), or None if something is malformed."""
    starts, ends = list(START.finditer(text)), list(END.finditer(text))
    if {m[1] for m in ends} - {m[1] for m in starts}:
        return None
    out = []
    for m in starts:
        e = next((e for e in ends if e[1] == m[1] and e.start() > m.end()), None)
        if e is None:
            return None
        out.append((m[1], m.start(), m.end(), e.start()))
    return out


def plain_replaced(text, key, body, force):
    found = plain_regions(text)
    if found is None:
        return text, "malformed_markers"
    r = next((r for r in found if r[0] == key), None)
    if r is None:
        return text, "marker_not_found"
    content = text[r[2] : r[3]]
    m = re.match(r"<!-- checksum:([a-f0-9]+) -->\r?\n", content)
    if m and not force and sha(content[m.end() :]) != m[1]:
        return text, "checksum_mismatch"
    return f"{text[: r[2]]}<!-- checksum:{sha(body)} -->\n{body}{text[r[3] :]}", None


def plain_issues(text):
    line = lambda m: text.count("\n", 0, m.start()) + 1
    found, starts, ends = plain_regions(text), {m[1]: line(m) for m in START.finditer(text)}, {m[1]: line(m) for m in END.finditer(text)}
    if found is None:
        alone = [(k, "malformed_markers", n) for k, n in starts.items() if k not in ends] + [(k, "malformed_markers", n) for k, n in ends.items() if k not in starts]
        return sorted(alone) or [(None, "malformed_markers", None)]
    seen, out = set(), []
    for m in START.finditer(text):
        if m[1] in seen:
            out.append((m[1], "duplicate_markers", line(m)))
        seen.add(m[1])
    return sorted(out)


def texts():
    r = random.Random(3)
    bits = ["<!-- GENERATED:a:START -->\n", "<!-- GENERATED:a:END -->\n", "<!-- GENERATED:b:START -->\r\n", "<!-- GENERATED:b:END --> x\n", "<!-- checksum:ab -->\n", f"<!-- checksum:{sha(chr(120) + chr(10))} -->\n", "x\n", "é", "\n", " "]
    return ["".join(r.choice(bits) for _ in range(r.choice((2, 5, 9)))) for _ in range(300)] + ["".join(bits[i] for i in (0, 6, 6, 1, 2, 4, 6, 3)), "".join(bits[i] for i in (0, 5, 6, 1)), "", "".join(bits[i] for i in (0, 2, 6, 1, 3)), "".join(bits[i] for i in (0, 6, 1, 0, 6, 1))]


def test_regions_equal_offsets(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(-1, None)], "i int, text string")
    given = [RG.replaced(F.col("text"), F.lit("a"), F.lit("new\n"), f) for f in (False, True)]
    got = {x.i: x for x in df.select("i", RG.region_issues(F.col("text")).alias("issues"), given[0].alias("kept"), given[1].alias("forced")).collect()}
    assert got[-1].issues is None
    for i, t in enumerate(rows):
        assert sorted((tuple(x) for x in got[i].issues), key=str) == sorted(plain_issues(t), key=str), t
        assert tuple(got[i].kept) == plain_replaced(t, "a", "new\n", False), t
        assert tuple(got[i].forced) == plain_replaced(t, "a", "new\n", True), t


def test_rendered_notes(spark):
    rows = texts()
    notes = spark.createDataFrame([(f"p{i}", ("t", "u", None)[i % 3], t) for i, t in enumerate(rows)] + [("null", "t", None)], "path string, type string, text string")
    templates = {("t", "a"): "A\n", ("t", "b"): "B", ("u", "a"): "U\n"}
    got = {x.path: (x.text, x.sections, x.error) for x in RG.rendered(notes, spark.createDataFrame([(*k, v) for k, v in templates.items()], "type string, section string, body string")).collect()}
    want = {}
    for i, t in enumerate(rows):
        keys = list(dict.fromkeys(m[1] for m in START.finditer(t)))
        if not keys:
            continue
        kind, new, error = ("t", "u", None)[i % 3], t, None
        if any((kind, k) not in templates for k in keys):
            error = "template_not_found"
        for k in keys if error is None else ():
            new, error = plain_replaced(new, k, templates[kind, k], False)
            if error:
                break
        want[f"p{i}"] = (t if error else new, len(keys), error)
    assert got == want and {e for _, _, e in want.values()} > {None, "template_not_found", "malformed_markers"}
    assert RG.rendered(notes.limit(0), spark.createDataFrame([], "type string, section string, body string")).count() == 0


def test_normalised_notes(spark):
    # lines without a key belong to the key before them; a quoted key keeps its quotes
    cases = [
        ("---\nzeta: 1\naliases: one\ndueAt: x\nid: a\ncreated: 2024-01-02T00:00:00Z\n---\n\n\nbody\n", "---\nid: a\naliases:\n  - one\ncreated: \"2024-01-02\"\ndue_at: x\nzeta: 1\n---\n\nbody\n"),
        ("---\r\ntags: [a, b]\r\ntype: t\r\n---\r\nbody", "---\r\ntype: t\r\ntags: [a, b]\r\n---\r\nbody"),
        ("---\ntags:\n  - a\n\"title\": x: y\n# about dates\ncreated: 2024-03-01T01:02:03Z\nupdated: '2024-03-01T00:00:00+02:00'\ndue: 2024-13-01\n---", '---\n"title": x: y\n# about dates\ntags:\n  - a\ncreated: 2024-03-01T01:02:03Z\nupdated: "2024-02-29"\ndue: 2024-13-01\n---'),
        ("no front", None),
        ("---\nid: a\nno end", None),
        ("", None),
        (None, None),
        ("---\nid: a\n---\n", "---\nid: a\n---\n"),
        ("---\ntags:\nid: a\n---x\n---\nb", "---\nid: a\n---x\ntags:\n---\nb"),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", FM.normalised(F.col("c")).alias("n")).collect()
    for x in got:
        want = cases[x.i][1]
        assert x.n == want, cases[x.i][0]
    day = spark.createDataFrame([("---\ncreated: 2024-03-01T23:30:00-01:00\n---\n",)], "c string").select(FM.normalised(F.col("c"), strip_time=True).alias("n")).first().n
    assert day == '---\ncreated: "2024-03-02"\n---\n'


TYPES = [("t", ["status", "x", "y"], ["x"], ["new", "done"]), ("u", [], ["summary"], [])]
ALIASES = {"x": ["ex", "eks"], "summary": ["abstract"]}
CORE = ("id", "type", "status", "title", "aliases", "tags", "created", "updated")


def plain_plan(notes, ops):
    """Operations one by one over ordered dicts."""
    files, types = {}, {t[0]: t[1:] for t in TYPES}
    started = {p: dict(re.findall(r"^(\w+): (.*)$", c.split("\n---\n")[0], re.M)) if c and c.startswith("---\n") else None for p, c in notes}
    for seq in sorted({o[0] for o in ops}):
        errors = []
        for _, op, path, key, value in sorted((o for o in ops if o[0] == seq), key=lambda o: str(o[3])):
            note = started.get(path)
            fields, required, statuses = types.get((note or {}).get("type"), ([], [], []))
            known = {*CORE, *fields, *required}
            if op not in (FM.SET, FM.UNSET, FM.MERGE):
                error = "unknown_operation"
            elif not path or not key or (op != FM.UNSET and value is None):
                error = "missing_field"
            elif path not in started:
                error = "unresolved_target"
            elif not note:
                error = "parse_error"
            elif not note.get("id") or not note.get("type"):
                error = "not_domain_note"
            elif key in ("id", "type"):
                error = "immutable_field"
            elif op != FM.UNSET and key not in known and not any(key in a and c in known for c, a in ALIASES.items()):
                error = "unknown_key"
            elif op != FM.UNSET and key == "status" and statuses and value not in statuses:
                error = "invalid_status"
            else:
                name = key if key in required else next((c for c, a in ALIASES.items() if key in a and c in required), key)
                others = {name, *ALIASES.get(name, ())} - {key}
                error = "missing_required_field" if op == FM.UNSET and name in required and not others & note.keys() else None
            errors.append(error)
            if error is None:
                now = files.setdefault(path, dict(note))
                if op == FM.UNSET:
                    now.pop(key, None)
                else:
                    now[key] = value
        if any(errors):
            return seq, next(e for e in errors if e), {}
    return None, None, files


def test_plans_equal_replay(spark):
    r = random.Random(11)
    notes = [(f"n{i}", f"---\nid: n{i}\ntype: {'tu'[i % 2]}\n" + "".join(f"{k}: {k}{i}\n" for k in ("status", "x", "ex", "abstract", "summary", "tags") if r.random() < 0.6) + f"---\nbody {i}\n") for i in range(8)]
    notes += [("bare", "no front"), ("nope", "---\nid: q\n---\n"), ("void", None)]
    ops = []
    for plan in range(120):
        paths = [p for p, _ in notes] + ["gone", None] if plan % 4 == 0 else [p for p, _ in notes[:8]]
        keys = ["status", "x", "ex", "tags", "title", "summary", "zz", "id"] if plan % 5 == 0 else ["tags", "title", "created", "updated"]
        for seq in range(r.choice((1, 3, 8))):
            kind, path = r.choice([FM.SET, FM.SET, FM.UNSET, FM.MERGE, "other"] if plan % 7 == 0 else [FM.SET, FM.UNSET, FM.MERGE]), r.choice(paths)
            for key in r.sample(keys, 2) if kind == FM.MERGE else [r.choice(keys)]:
                ops.append((plan, seq, kind, path, key, None if kind == FM.UNSET else r.choice(["new", "done", "[a]"])))
    n = spark.createDataFrame(notes, "path string, content string")
    o = spark.createDataFrame([*ops, (None, 1, FM.SET, "n1", "title", "x"), (3, None, FM.SET, "n1", "title", "x")], "plan int, seq int, op string, path string, key string, value string")
    types = spark.createDataFrame(TYPES, "type string, fields array<string>, required array<string>, statuses array<string>")
    results = FM.checked(n, o, types, ALIASES)
    told = {}
    for x in results.collect():
        told.setdefault(x.plan, []).append(x)
    files = {}
    for x in FM.applied(n, o, results).collect():
        files.setdefault(x.plan, {})[x.path] = x
    errors = set()
    for plan in range(120):
        mine = [x[1:] for x in ops if x[0] == plan]
        at, error, want = plain_plan(notes, mine)
        errors.add(error)
        assert len(told[plan]) == len(mine)
        for x in told[plan]:
            assert (x.status, x.error) == (("ok", None) if at is None or x.seq < at else ("error", error) if x.seq == at else ("skipped", None)), (plan, x, at, error)
        got = files.get(plan, {})
        assert got.keys() == want.keys()
        for path, fields in want.items():
            content = dict(notes)[path]
            assert got[path].content == "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + "---\n" + content.split("\n---\n", 1)[1]
            assert got[path].before == sha(content) and got[path].changed == (got[path].content != content)
    assert len(errors) > 6 and None in errors
    absent = {(x.plan, x.seq, x.path, x.key) for x in FM.absent_keys(n, o).collect()}
    plain = set()
    for plan, seq, op, path, key, _ in ops:
        if op == FM.UNSET and path:
            before = [b for b in ops if b[0] == plan and b[3] == path and b[4] == key and b[1] < seq]
            there = before[-1][2] != FM.UNSET if before else bool(re.search(rf"^{key}: ", dict(notes).get(path) or "", re.M))
            plain |= set() if there else {(plan, seq, path, key)}
    assert {x for x in absent if x[2]} == plain
    assert FM.checked(n.limit(0), o.limit(0), types, ALIASES).count() == 0
