"""Changes of notes' frontmatter, one file at a time, with dry runs."""

from __future__ import annotations

import difflib
import hashlib
import re

from ..sources.markdown import parse_yaml

_FRONT = re.compile(r"\A---\r?\n(.*?)(?<=\n)---(?=[\r\n]|\Z)(?:\r\n)?\n?", re.S)
# The canonical order of keys.
ORDER = ("id", "type", "status", "title", "aliases", "tags", "created", "updated")


def _render(fields: dict[str, list[str]]) -> str:
    keys = sorted(fields, key=lambda k: (ORDER.index(k) if k in ORDER else len(ORDER), k))
    lines = [f"{k}:" + (f" {fields[k][0]}" if len(fields[k]) == 1 and k not in ("aliases", "tags") else "".join(f"\n  - {x}" for x in fields[k])) for k in keys]
    return "---\n" + "\n".join(lines) + "\n---\n"


def mutate(content: str, put: dict[str, list[str]] | None = None, drop: tuple[str, ...] = (), expect_hash: str | None = None) -> tuple[str, str]:
    """(new content, diff). With expect_hash, a file that has changed since is an error; keys come in canonical order."""
    if expect_hash and hashlib.sha256(content.encode()).hexdigest() != expect_hash:
        raise ValueError("the file has changed since it was read")
    m = _FRONT.match(content)
    fields = parse_yaml(m[1]) if m else {}
    fields.update(put or {})
    for k in drop:
        fields.pop(k, None)
    new = _render(fields) + (content[m.end() :] if m else content)
    return new, "".join(difflib.unified_diff(content.splitlines(True), new.splitlines(True), "before", "after"))


def replace_region(content: str, key: str, body: str, force: bool = False) -> str:
    """The generated region of that key with another body; a body that no longer has its checksum was edited by hand and needs force."""
    pattern = re.compile(rf"<!-- region:{re.escape(key)} ([0-9a-f]{{64}}) -->\n(.*?)<!-- endregion:{re.escape(key)} -->", re.S)
    m = pattern.search(content)
    if not m:
        raise KeyError(key)
    if not force and hashlib.sha256(m[2].encode()).hexdigest() != m[1]:
        raise ValueError(f"region {key} was edited")
    return content[: m.start()] + f"<!-- region:{key} {hashlib.sha256(body.encode()).hexdigest()} -->\n{body}<!-- endregion:{key} -->" + content[m.end() :]


def apply_plan(files: dict[str, str], plan: list[dict]) -> dict[str, str]:
    """All operations {path, set, unset} of a plan on a copy; if one fails none is applied."""
    out = dict(files)
    for op in plan:
        if op["path"] not in out:
            raise KeyError(op["path"])
        out[op["path"]], _ = mutate(out[op["path"]], op.get("set"), tuple(op.get("unset", ())))
    return out
