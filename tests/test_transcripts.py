"""Growing, torn and truncated transcripts read once, and episodes against hand-made ones."""

import json

import pytest

from pyspark.sql import functions as F

from quillspark.sources import episodes as E
from quillspark.streaming import transcripts as T


def user(text, ts="2024-03-01T10:00:00Z", **more):
    return json.dumps({"type": "user", "sessionId": "abcdefghij", "timestamp": ts, "message": {"role": "user", "content": text}, **more})


def assistant(*blocks, ts="2024-03-01T10:01:00Z"):
    return json.dumps({"type": "assistant", "sessionId": "abcdefghij", "timestamp": ts, "message": {"role": "assistant", "content": list(blocks)}})


def call(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


def values(spark, out):
    rows = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    return sorted((r.path.split("/")[-1], r.start, r.content.count("### ")) for r in rows)


@pytest.mark.parametrize("size", [1 << 26, 50])
def test_batches_have_each_complete_line_once(spark, tmp_path, size):
    (tmp_path / "d").mkdir()
    text = ["first", "", "é" * 40, "x" * 300, "last"]
    (tmp_path / "d/a.jsonl").write_text("\n".join(text) + "\ntorn")
    (tmp_path / "b.jsonl").write_text("no line feed")
    (tmp_path / "c.txt").write_text("other\n")
    rows = T.lines(spark, str(tmp_path), range=size).collect()
    at = [len("\n".join([*text[:i], ""]).encode()) if i else 0 for i in range(5)]
    assert sorted((r.offset, r.value, r.start) for r in rows) == [(a, x, 0) for a, x in zip(at, text, strict=True)]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    (tmp_path / "src").mkdir()
    one, two = tmp_path / "src/one.jsonl", tmp_path / "src/two.jsonl"
    go = lambda: (T.capture(spark, src, out, ckpt), values(spark, out))[1]
    half = user("c")[:30]
    one.write_text(user("a") + "\n" + user("b") + "\n" + half)
    first = go()
    assert first == [("one.jsonl", 0, 2)]
    cursor = len((user("a") + "\n" + user("b") + "\n").encode())
    one.write_text(user("a") + "\n" + user("b") + "\n" + user("c") + "\n")  # the torn line is whole now
    two.write_text(user("<system-reminder> x") + "\n")  # noise alone gives no episode
    assert go() == [*first, ("one.jsonl", cursor, 1)]
    assert go() == [*first, ("one.jsonl", cursor, 1)]  # nothing new
    one.write_text(user("z") + "\n")  # truncated and written anew
    two.write_text(user("<system-reminder> x") + "\n" + user("real") + "\n")
    noise = len((user("<system-reminder> x") + "\n").encode())
    assert go() == [("one.jsonl", 0, 1), *first, ("one.jsonl", cursor, 1), ("two.jsonl", noise, 1)]


def test_ranges_start_again_when_a_file_is_replaced():
    got = lambda a, b, n=100: [(r.path, r.start, r.low, r.high) for r in T.ranges(a, b, n)]
    assert got({}, {"p": [250, "h"]}) == [("p", 0, 0, 100), ("p", 0, 100, 200), ("p", 0, 200, 250)]
    assert got({"p": [250, "h"]}, {"p": [250, "h"]}) == []
    assert got({"p": [250, "h"]}, {"p": [280, "h"]}) == [("p", 250, 250, 280)]
    assert got({"p": [250, "h"]}, {"p": [90, "h"]}) == [("p", 0, 0, 90)]
    assert got({"p": [250, "h"]}, {"p": [300, "other"]}, 300) == [("p", 0, 0, 300)]
    assert got({"p": [250, "h"], "gone": [5, "x"]}, {"p": [251, "h"]}) == [("p", 250, 250, 251)]


def lines_of(spark, files):
    rows, made = [], []
    for path, values_ in files.items():
        at = 0
        for v in values_:
            made.append((path, 0, at, v))
            at += len(v.encode()) + 1
    return spark.createDataFrame(made + rows, "path string, start long, offset long, value string").repartition(3)


def test_episodes(spark):
    heredoc = "git add . && git commit -m \"$(cat <<'EOF'\n\n  Fix it  \nmore\nEOF\n)\""
    files = {
        "a": [
            "{torn",
            user("hi\nthere", cwd="/w", gitBranch="main"),
            user([{"type": "tool_result"}]),
            user("  "),
            user(5),
            user("<task-notification> no"),
            assistant({"type": "text", "text": "one"}, call("Bash", command=heredoc), call("Bash", command="git commit -m 'two words'"), call("Edit", file_path="/z"), {"type": "text", "text": " "}),
            assistant({"type": "text", "text": "two"}, call("Read", file_path="/a"), call("Edit", file_path="/z"), call("Bash", command="ls"), call("Bash", command='git commit -m ""'), ts="2024-03-01T11:00:00Z"),
            json.dumps({"type": "pr-link", "prNumber": 7, "prUrl": "u7", "prRepository": "r"}),
            json.dumps({"type": "pr-link", "prNumber": 7, "prUrl": "again"}),
            json.dumps({"type": "pr-link", "prNumber": 0}),
            json.dumps({"type": "assistant", "message": {"role": "assistant", "content": "plain"}}),
            "[1]",
        ],
        "b": [json.dumps({"type": "x", "agentId": "q", "sessionId": "abcdefgh99", "timestamp": "2024-03-01"})],
        "c": [user("same id", ts="2024-03-01T00")],
        "d": [json.dumps({"type": "user", "message": {"content": "no session"}})],
        "e": ["", "null"],
    }
    found = E.episodes(lines_of(spark, files))
    got = {r.path: r for r in found.withColumn("content", E.render(found, today="2020-02-02")).collect()}
    a = got["a"]
    assert (a.id, a.segment_id, a.session_id, a.started_at, a.ended_at, a.cwd, a.git_branch) == ("episode-2024-03-01-abcdefgh", "episode-2024-03-01-abcdefgh-part00000000", "abcdefghij", "2024-03-01T10:00:00Z", "2024-03-01T11:00:00Z", "/w", "main")
    assert [m.text for m in a.user_messages] == ["hi\nthere"] and [m.text for m in a.assistant_messages] == ["one", "two"]
    assert a.tool_counts == {"Bash": 4, "Edit": 2, "Read": 1} and a.commits == ["Fix it", "two words", 'git commit -m ""'] and a.files_touched == ["/a", "/z"]
    assert [(p.number, p.url) for p in a.prs] == [(7, "u7")] and not a.sidechain and got["b"].sidechain
    assert {(r.path, r.outcome, r.first_path) for r in E.captured(found).collect()} == {("a", "captured", None), ("b", "sidechain", None), ("c", "collision", "a"), ("d", "skipped", None), ("e", "skipped", None)}
    assert {r.path for r in E.capturable(found).collect()} == {"a", "c", "d"}
    assert a.content == (
        "---\nid: episode-2024-03-01-abcdefgh\ntype: episode\nsession_id: abcdefghij\nstarted_at: 2024-03-01T10:00:00Z\nended_at: 2024-03-01T11:00:00Z\ncwd: /w\ngit_branch: main\ntags:\n  - episode\ncreated: 2024-03-01\n---\n\n"
        "# Episode — episode-2024-03-01-abcdefgh\n\n## Metadata\n\n- User messages: 1\n- Assistant text blocks: 2\n- Tool calls: Bash=4, Edit=2, Read=1\n- Files touched: 2\n\n"
        '## Commits made\n\n- `Fix it`\n- `two words`\n- `git commit -m ""`\n\n## PRs opened\n\n- #7 — u7\n\n## Files touched\n\n- `/a`\n- `/z`\n\n'
        "## User messages (verbatim)\n\n### 1 — 2024-03-01T10:00:00Z\n\n> hi\n> there\n\n## Assistant responses (verbatim)\n\n### 1 — 2024-03-01T10:01:00Z\n\none\n\n### 2 — 2024-03-01T11:00:00Z\n\ntwo\n\n"
    )
    assert "created: 2020-02-02\n" in got["e"].content and "Tool calls: none\n" in got["e"].content and "_(none)_" in got["e"].content


def test_commit_subjects(spark):
    cases = {
        'git commit -m "one"': "one",
        "git commit -m 'it is' -m \"b\"": "b",
        "git commit --amend": "git commit --amend",
        "git commit -m \"a\nb\"": "a",
        "x <<'EOF'\nEOF\n": "x <<'EOF'\nEOF\n",
        "git commit -m \"" + "y" * 200 + "\"": "y" * 120 + "…",
        "git commit -m \"$(cat <<'EOF'\n\tSubject\n\nbody\nEOF\n)\"": "Subject",
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", E.commit_subject(F.col("c")).alias("s"))
    assert {r.c: r.s for r in df.collect()} == cases
