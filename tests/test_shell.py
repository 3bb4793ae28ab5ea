"""Quoted parts of commands against a plain automaton."""

import random
import string

from pyspark.sql import functions as F

from quillspark.functions.shell import outside_quotes

WORD = set(string.ascii_letters + string.digits + "_")


def plain(c):
    out, i = [], 0
    while i < len(c):
        if c[i] == "'":
            k = c.find("'", i + 1)
            i = len(c) if k < 0 else k + 1
        elif c[i] == '"':
            i += 1
            while i < len(c) and c[i] != '"':
                i += 2 if c[i] == "\\" else 1
            i += 1
        elif c.startswith("<<", i) and (m := marker(c, i)):
            word, tabs, line_end = m
            out.append(c[i:line_end])
            i = line_end
            while i < len(c):
                k = c.find("\n", i)
                k = len(c) if k < 0 else k + 1
                line, i = c[i:k], k
                if (line.lstrip("\t") if tabs else line).removesuffix("\n") == word:
                    out.append(line)
                    break
        else:
            out.append(c[i])
            i += 1
    return "".join(out)


def marker(c, i):
    j = i + 2
    tabs = c[j : j + 1] == "-"
    j += tabs
    while c[j : j + 1] in (" ", "\t") and j < len(c):
        j += 1
    j += c[j : j + 1] in ("'", '"') and j < len(c)
    k = j
    while k < len(c) and c[k] in WORD:
        k += 1
    end = c.find("\n", k)
    return (c[j:k], tabs, len(c) if end < 0 else end + 1) if k > j else None


def test_only_what_the_shell_acts_on_stays(spark):
    r = random.Random(4)
    bits = ["'", '"', "\\", "\\\"", "<<", "<<-", "EOF", "E", "\n", "\t", " ", "git", ";", "|", "<<'EOF'\n", "\nEOF\n", "<<-\"E\"\n", "\n\t\tE\n", "é", "-"]
    cases = ["".join(r.choice(bits) for _ in range(r.choice((4, 15, 50)))) for _ in range(600)]
    cases += ["", "plain", "git commit -m \"a; rm 'x'\" && ls", "cat <<'EOF'\n; rm\nEOF\necho 'x", "cat <<-X\n\ta\n\tX\nls", "cat <<<EOF\na\nEOF", "a <<\nb", '"' + "\\x" * 3000 + '" end', "<<E\n" + "line\n" * 20_000 + "E\nafter"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, c string").select("i", outside_quotes(F.col("c")).alias("s"))
    got = {x.i: x.s for x in df.collect()}
    for i, c in enumerate(cases):
        assert got[i] == plain(c), repr(c)
    assert got[len(cases)] is None
