"""Columns over file paths and repository addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each file suffix.
LANGUAGES = {".py": "python", ".js": "typescript", ".mjs": "typescript", ".cjs": "typescript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go"}
# Directory names that a scan leaves out unless it is given others.
EXCLUDED = (".git", ".hg", ".svn", "tmp", ".venv", "venv", "node_modules", "dist", "build", "target", "__pycache__", ".mypy_cache", ".pytest_cache", ".idea", ".vscode")


def suffix(rel: Column) -> Column:
    """The last ``.suffix`` of a path's last part in lower case, empty without one or where the name begins with it."""
    return F.lower(F.regexp_extract(rel, r"[^/](\.[^./]+)$", 1))


def language(rel: Column) -> Column:
    """The language of a path by its suffix; null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, suffix(rel))


def excluded(rel: Column, names: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a part of the path, the file's name too, is a left-out name; without names the usual ones are meant."""
    return F.arrays_overlap(F.split(rel, "/"), F.array(*[F.lit(x) for x in sorted(set(names) or set(EXCLUDED))]))


def module_name(rel: Column, names: list[str] | tuple[str, ...] = ()) -> Column:
    """Dotted module of a Python file as a trace names it: a package without __init__; null for other files, for left-out
    folders and for a package at the root."""
    stem = F.regexp_replace(F.regexp_replace(rel, r"\.py$", ""), r"(^|/)__init__$", "")
    good = rel.endswith(".py") & ~excluded(rel, names) & (F.length(stem) > 0)
    return F.when(good, F.replace(stem, F.lit("/"), F.lit(".")))


def hosted_repository(url: Column) -> Column:
    """Clone address of an http(s) address of a repository on github.com, else null."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    m = r"^https?://[^/]+/+([^/?#]+)/+([^/?#]+?)(?:\.git)?/?(?:[/?#].*)?$"
    owner, repo = F.regexp_extract(url, m, 1), F.regexp_extract(url, m, 2)
    good = host.isin("github.com", "www.github.com") & (F.length(owner) > 0) & (F.length(repo) > 0)
    return F.when(good, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(".git")))


def hosted(url: str) -> str | None:
    """As hosted_repository, for one address on the driver."""
    m = re.match(r"(?i)https?://(?:www\.)?github\.com/+([^/?#]+)/+([^/?#]+)", url)
    if not m:
        return None
    repo = m[2][:-4] if m[2].endswith(".git") else m[2]
    return f"https://github.com/{m[1]}/{repo}.git" if repo else None
