"""Source files that were not written by hand: generated, minified, copied from another project, or data saved as code."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bloom
from ..runtime import partitions_for, stage

# What tools and copied files say of themselves in a header. One of these is enough.
NOTICES = {
    "generated": [
        "code generated by", "this code was generated", "this file was generated", "this file is generated", "file generated by", "autogenerated by",
        "autogenerated (", "autogenerated file", "auto-generated by", "auto generated by", "auto generated,", "auto-generated file", "automatically generated by",
        "automatically generated file", "automatically generated from", "was automatically generated", "is automatically generated", "automatically produced from",
        "automatically produced by", "machine generated by", "machine-generated by", "@generated", "<auto-generated", "generated by the protocol buffer compiler",
        "do not modify by hand", "do not edit by hand", "do not edit manually", "do not edit this file", "changes made here will be lost", "changes will be lost",
        "manual changes will be overwritten", "any modifications will be overwritten", "automatisch erzeugt von", "automatisch generiert", "nicht von hand",
        "fichier généré", "généré automatiquement", "ne pas modifier", "archivo generado", "generado automáticamente", "no editar a mano",
    ],
    "copied": [
        "vendored: ", "vendored from", "taken from", "copied from", "upstream:", "imported from upstream", "third-party code", "third party code",
    ],
}
#: Said also of other files by hand-written ones; two of them together are enough.
WEAK = ["do not edit", "auto-generated", "autogenerated", "generated from", "built with:", "source: "]
#: Words of notices that name a tool or a release; the patterns below read what stands about them.
TOLD = ["by ", "with ", "using ", "von ", "mit ", "par ", "avec ", "por ", "con ", "(c)", "©", "copyright", "license"]
_MAKER = re.compile(
    r"\b(?:generated|produced|written|created|built|emitted|compiled|rendered|transpiled|erzeugt|generiert|erstellt|généré|produit|créé|generado|producido|creado)e? (?:automatically )?(?:by|with|using|von|mit|par|avec|por|con) (?:the )?[\w@/.+-]*[a-z][\w@/.+-]*,? (?:version )?v?\d+(?:\.\d+)+"
    r"|\bdiese datei (?:wird|wurde|ist) (?:\S+ ){0,6}(?:erzeugt|generiert|erstellt)\b|\bce fichier (?:est|a été) (?:\S+ ){0,3}(?:généré|produit|créé)\b|\beste (?:archivo|fichero) (?:es|fue|ha sido) (?:\S+ ){0,3}(?:generado|producido|creado)\b"
)
#: The banner of a released package: its name, a version and a claim of rights.
_BANNER = re.compile(r"([a-z@][\w@./-]*)(?: -)? v?\d+\.\d+(?:\.\d+)?\b[^.;]{0,3}[ ,|-]+(?:(?:released|licensed|license|under|all rights)[^.;]{0,30})?(?:\(c\)|©|copyright|licen[sc]e)")
# Directories below which a package directory holds another project's files.
PACKAGE_DIRS = {"node_modules", "site-packages", "dist-packages", "bower_components", "jspm_packages", "vendor", "vendored", "_vendored", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "extern", "external", "deps", "pods"}
# Files that package managers write, and suffixes of minified or bundled scripts.
LOCKFILES = {"package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "npm-shrinkwrap.json"}
MINIFIED = re.compile(r"(?i)[.\-_](?:min|bundle|packed|prod)\.(?:js|mjs|cjs|css|ts|py)$")

#: Five-word shingles; hashes of a signature's bands and rows; containment that makes a copy.
SHINGLE, BANDS, ROWS, SIMILAR = 5, 40, 6, 0.8
#: Files of a partition.
FILES = 1500

_JUDGED = "rel string, repo long, reason string, route string, other boolean, own boolean, body long, shingles array<int>, bands array<long>, modules array<long>"
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|%|\"\"\"|''')")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
# names of functions by a keyword, by an access modifier, and of methods before a brace
_BY_KEYWORD = r"\b(?:def|function|func|fn)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)"
_BY_ACCESS = r"\b(?:public|private|protected|static)\s+(?:[\w<>\[\],]+\s+)+?([A-Za-z_]\w*)\s*\("
_BY_BRACE = r"^[ \t]+(?:async[ \t]+)?(?!(?:if|for|while|switch|catch|return|function|with)\b)([A-Za-z_]\w*)[ \t]*\([^()\n]*\)[ \t]*(?::[^={}\n]+)?\{"
_DEFINED = {(a, b): re.compile("|".join([_BY_KEYWORD, *[_BY_ACCESS] * a, *[_BY_BRACE] * b]), re.M) for a in (False, True) for b in (False, True)}
_ACCESS = re.compile(r"public|private|protected|static")
_COUNTED = re.compile(r"^[^=\n(]*?\b[A-Za-z]\w*?(\d+)\b[^=\n(]*:?=\s*(\d+)\s*[;,]?\s*$", re.M)
_TYPE = re.compile(r"\b(?:class|interface|struct|enum)\s+[A-Za-z_]")
_INNER = re.compile(r"^\s*(?:from\s+([A-Za-z_]\w*)\.([\w.]+)\s+import\b|import\s+([A-Za-z_]\w*)\.([\w.]+)\s*;?\s*$|(?:import\s+)?\"([A-Za-z_]\w*)/([\w/]+)\"\s*$)", re.M)
_PACKAGE = re.compile(r"^\s*package\s+([A-Za-z_]\w*)\.[\w.]+\s*;", re.M)
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"[\s*/#]+")


def automaton():
    """One automaton for all notices."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, notes in [*NOTICES.items(), ("weak", WEAK), ("told", TOLD)]:
        for n in notes:
            a.add_word(n, (kind, n))
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The comment lines before and about the first code, in lower case, runs of space and comment signs made one space."""
    out, code = [], 0
    for i, line in enumerate(text.split("\n")):
        if _COMMENT.match(line) or not line.strip():
            out.append(line)
        else:
            code += 1
            if code > 3 and i > 8:
                break
    return _SPACE.sub(" ", " ".join(out)).casefold()


def shape(text: str, script: bool) -> str | None:
    """minified, data or generated where the shape of the code alone tells it."""
    strings = _STRING.sub(" ", text)
    names = _NAME.findall(strings)
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    short = len([x for x in names if len(x) <= 2]) / max(1, len(names))
    mean = len(text) / len(lines)
    longest = max(map(len, lines))
    if len(names) >= 20 and short > 0.5 and (mean > 60 or script):
        return "minified"
    if longest > 1000 and sum(len(x) for x in lines if len(x) > 500) > 0.8 * len(text) and len(names) > 0.05 * len(text) and sum(x.isspace() for x in text) < 0.1 * len(text):
        return "minified"
    defined = _DEFINED[bool(_ACCESS.search(strings)), "{" in strings].findall(strings)
    found = [x if isinstance(x, str) else next(filter(None, x)) for x in defined]
    typed = bool(_TYPE.search(strings))
    literal = sum(map(len, _STRING.findall(text))) + sum(map(len, _NUMBER.findall(strings)))
    if not found and not typed and literal > 0.5 * len(text) and len(text) > 200:
        return "data"
    if len(lines) >= 12 and not found and not typed:
        cells = [x.count(",") for x in lines]
        if min(cells) >= 2 and max(cells) == min(cells) and "(" not in text:
            return "data"
    # lines of more than 20 signs that are half literals make at least 5 signs a line if they are half of all lines
    bare = 0 if literal < 5 * len(lines) else sum(1 for x in lines if len(x) > 20 and sum(map(len, _STRING.findall(x))) + sum(map(len, _NUMBER.findall(_STRING.sub(" ", x)))) > 0.5 * len(x.strip()))
    if bare >= 12 and bare > 0.5 * len(lines):
        return "data" if not found else "generated"
    counted = sum(a == b for a, b in _COUNTED.findall(text)) if text.count("=") > 0.5 * len(lines) else 0
    if counted >= 8 and counted > 0.5 * len(lines):
        return "generated"
    ends = [re.search(r"(\d+)$", x) for x in found]
    numbers = {int(m[1]) for m in ends if m}
    if len(numbers) >= 4 and len(numbers) >= 0.6 * len(found) and max(numbers) - min(numbers) < 2 * len(numbers):
        return "generated"
    return None


def modules(rel: str, repo: str, text: str) -> list[str]:
    """Modules within packages that the file imports or declares as its own, other than its repository's and the language's."""
    out = {"package " + m for m in _PACKAGE.findall(text) if m != repo}
    for a, b, c, d, e, f in _INNER.findall(text):
        root, rest = a or c or e, (b or d or f).replace("/", ".")
        if root != repo and root not in sys.stdlib_module_names:
            out.add(f"{root}.{rest}")
    return sorted(out)


def origin(rel: str, repo: str, text: str) -> tuple[bool, bool]:
    """(other, own): whether the path says that the file is another project's, or its words that it is this repository's own."""
    own = bool(repo) and repo in text
    parts = rel.lower().split("/")
    packaged = any(d in PACKAGE_DIRS and i < len(parts) - 2 for i, d in enumerate(parts[1:], 1))
    return packaged and not own, own


_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words of a text without its header."""
    lines = text.split("\n")
    k = 0
    while k < len(lines) and (_COMMENT.match(lines[k]) or not lines[k].strip()):
        k += 1
    w = pd.util.hash_array(np.array(_WORD.findall("\n".join(lines[k:])) or [""], dtype=object))
    if len(w) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(w) - SHINGLE + 1, dtype=np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - SHINGLE + 1 + i]
    return np.unique(h)


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of the minimum-hash signature."""
    x = s ^ (s >> np.uint64(29))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 512):
        least = np.minimum(least, ((x[i : i + 512, None] * _A + _B) >> np.uint64(11)).min(axis=0))
    out = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS]
    return out ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def judge(rel: str, repo: str, text: str, notices) -> tuple[str | None, str | None, bool, bool]:
    """(reason, route, other, own) of one file by its header, path and content; reason is null for one that seems hand-written.
    route: what told it - notice, path or shape."""
    kinds: dict[str, set] = {}
    head, name = header(text), rel.rsplit("/", 1)[-1]
    for _, (kind, note) in notices.iter(head):
        kinds.setdefault(kind, set()).add(note)
    if "generated" in kinds or len({n.replace("-", "") for n in kinds.get("weak", ())}) > 1 or ("told" in kinds and _MAKER.search(head)):
        return "generated", "notice", False, False
    if name.lower() in LOCKFILES:
        return "generated", "path", False, False
    form = shape(text, bool(MINIFIED.search(name)) or name.endswith((".js", ".mjs", ".cjs")))
    if form:
        return form, "shape", False, False
    other, own = origin(rel, repo or "", text)
    marks = len(kinds.get("copied", ()))
    if "told" in kinds and any(m != (repo or "").lower() for m in _BANNER.findall(head)):
        marks += 1
    if marks and (not own or marks > 1 or other):
        return "copied", "notice", True, own
    return ("copied" if other else None), ("path" if other else None), other, own


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    notices = automaton()
    for b in batches:
        out = []
        for rel, repo, text in zip(b["rel"], b["repo"], b["content"]):
            reason, route, other, own = judge(rel, repo, text, notices)
            open_ = reason in (None, "copied")
            s = shingles(text) if open_ else np.zeros(0, dtype=np.uint64)
            body = _hash(s.tobytes()) if len(s) else None
            # 32 bits of a shingle's hash are enough to compare two files
            low = np.unique(s.astype(np.uint32)).view(np.int32) if len(s) else None
            inner = modules(rel, repo or "", text) if open_ else []
            out.append((rel, _hash((repo or "").encode()), reason, route, other, own, body, low, bands(s).view(np.int64) if len(s) else None, [_hash(m.encode()) for m in inner] if inner else None))
        yield pd.DataFrame(out, columns=["rel", "repo", "reason", "route", "other", "own", "body", "shingles", "bands", "modules"]).astype({"body": "Int64"})


def _containment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) / max(1, min(len(x), len(y))) for x, y in zip(a, b)])


def _inner(judged: DataFrame) -> DataFrame:
    """(rel): files that do not name their repository and use a module that files known to be copied use and no file that
    names its repository uses: they come from within the copied project."""
    m = judged.filter(F.col("modules").isNotNull()).select("rel", "reason", "other", "own", F.explode("modules").alias("module"))
    told = m.groupBy("module").agg(F.max(F.col("other")).alias("copied"), F.max(F.col("own") & ~F.col("other")).alias("used"))
    free = m.filter(F.col("reason").isNull() & ~F.col("own"))
    return free.join(told.filter(F.col("copied") & ~F.col("used")), "module", "left_semi").select("rel").distinct()


def _leaders(keys: DataFrame) -> DataFrame:
    """(band, known, first, last) of the bands that bodies of several repositories or of another project share: the leaders."""
    who = F.struct("repo", "body")
    free = F.when(~F.col("own"), who)
    lead = keys.groupBy("band").agg(F.min(F.when(F.col("other"), F.col("body"))).alias("known"), F.min(free).alias("first"), F.max(free).alias("last"), F.count("*").alias("n"))
    return lead.filter((F.col("n") > 1) & (F.col("known").isNotNull() | (F.col("first.repo") != F.col("last.repo")))).drop("n")


def _near(bodies: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(body): bodies of pairs (body, y) that are similar enough. A Bloom filter of the bodies in pairs, sized to them, keeps
    the shingles of all others from being shuffled."""
    pairs = stage(pairs.distinct(), f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("body", "y")).alias("body")).distinct()
    h1, h2 = bloom.hashes(F.col("body"))
    n = ids.count()
    if not n:
        return pairs.select("body")
    s = bodies.select("body", "shingles")
    if bloom.slices(n) == 1:
        words = bloom.build(ids.select(h1.alias("h1"), h2.alias("h2")), "h1", "h2", n)
        s = s.filter(bloom.might_contain(bodies.sparkSession.sparkContext.broadcast(words), h1, h2))
    both = pairs.join(s.select(F.col("body").alias("y"), F.col("shingles").alias("sy")), "y").join(s.select("body", F.col("shingles").alias("sx")), "body")
    return stage(both.filter(F.pandas_udf(_containment, "double")("sx", "sy") >= SIMILAR).select("body").distinct(), name)


def not_handwritten(files: DataFrame) -> DataFrame:
    """(rel, reason), one row for each file that was not written by hand for its repository; see reasons()."""
    return reasons(files).groupBy("rel").agg(F.min("reason").alias("reason"))


def reasons(files: DataFrame) -> DataFrame:
    """(rel, reason, route): what the files that were not written by hand are, and what told it.

    reason: generated, minified, data or copied. route: notice (one automaton for all notices reads the header: phrases of
    tools and copies, a tool with its version, the banner of a release), path (a lockfile, a package directory below one for
    other projects' code), shape (minified, numbered or tabled code, literals only), import (a module that only copied files
    use), near (at least 0.8 of its five-word shingles in a file of another project). What talks of generated or vendored
    files is not one. Files that lie in vendored directories without a package or that name their own repository are judged
    by content alone; a suffix like .min.js is evidence for the shape only. Rows with null content or rel are no case; a file
    with several versions is a case if one of them is.

    Copies: distinct bodies, not files, are compared, so a body copied everywhere is one row. Candidates share a band of
    their minimum-hash signature. A body first meets only the leaders of its bands (one of another project, two of the
    farthest repositories), so a group of very many variants makes no more pairs than it has bands; bands within one
    repository are left out, as nothing there can be a copy; only a body that no leader explains then meets the others of
    its bands that are of other repositories.
    """
    text = files.select("rel", "repo", "content").filter(F.col("rel").isNotNull() & (F.length("content") > 0))
    # spread by turns, whatever the keys: the work is in Python, and one large partition would be one slow task
    text = text.repartition(partitions_for(files.sparkSession, files.count(), FILES))
    judged = stage(text.mapInPandas(_judge, _JUDGED), "files-judged")
    inner = stage(_inner(judged), "files-inner")
    told = judged.join(inner.withColumn("inner", F.lit(True)), "rel", "left").withColumn("other", F.col("other") | F.coalesce("inner", F.lit(False)))
    some = told.filter(F.col("body").isNotNull())
    bodies = some.groupBy("body").agg(F.max("other").alias("other"), F.max("own").alias("own"), F.min("repo").alias("repo"), F.max("repo").alias("repo2"))
    bodies = stage(bodies, "bodies")
    sets = judged.filter(F.col("body").isNotNull()).select("body", "shingles", "bands")
    first = sets.select("body", "bands").dropDuplicates(["body"])
    keys = stage(first.join(bodies.drop("repo2"), "body").select("body", "other", "own", "repo", F.explode("bands").alias("band")), "bands")
    lead = stage(_leaders(keys), "leaders")
    x = keys.filter(~F.col("other")).join(lead, "band")
    apart = lambda c: F.when(~F.col("own") & (F.col(f"{c}.repo") != F.col("repo")), F.col(f"{c}.body"))
    pairs = x.select("body", F.explode(F.array_compact(F.array("known", apart("first"), apart("last")))).alias("y")).filter(F.col("body") != F.col("y"))
    sets = sets.dropDuplicates(["body"])
    near = _near(sets, pairs, "copies-1")
    # what no leader of its bands explains meets the others of its bands
    shared = keys.join(lead.select("band"), "band", "left_semi")
    rest = shared.filter(~F.col("other")).join(near, "body", "left_anti")
    met = F.col("other_y") | ((F.col("repo") != F.col("repo_y")) & ~F.col("own") & ~F.col("own_y"))
    right = shared.select("band", F.col("body").alias("y"), F.col("repo").alias("repo_y"), F.col("other").alias("other_y"), F.col("own").alias("own_y"))
    close = near.unionByName(_near(sets, rest.join(right, "band").filter((F.col("body") != F.col("y")) & met).select("body", "y"), "copies-2"))
    spread = bodies.filter(~F.col("own") & ~F.col("other") & (F.col("repo") != F.col("repo2"))).select("body")
    same = bodies.filter(F.col("other")).select("body")  # the very body elsewhere is known to be another project's
    copied = close.unionByName(spread).unionByName(same).distinct()
    free = judged.filter(F.col("reason").isNull())
    more = free.join(copied, "body", "left_semi").select("rel", F.lit("copied").alias("reason"), F.lit("near").alias("route"))
    used = inner.select("rel", F.lit("copied").alias("reason"), F.lit("import").alias("route"))
    return judged.filter(F.col("reason").isNotNull()).select("rel", "reason", "route").unionByName(used).unionByName(more)


def handwritten_symbols(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``symbols`` whose file was written by hand; rows without a file stay."""
    return symbols.join(found.select(F.col("rel").alias("file")).distinct(), "file", "left_anti").select(*symbols.columns)


def by_directory(found: DataFrame, excluded: DataFrame) -> DataFrame:
    """(reason, in_excluded_dir, n_files): whether the files lie below a directory that a scan leaves out; the list is of a
    fixed size."""
    dirs = F.broadcast(excluded.filter(F.col("dir_name").isNotNull()).agg(F.collect_set("dir_name").alias("dirs")))
    at = found.select("reason", F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1).alias("parts"))
    # one row joined to all: the list of directories
    flagged = at.withColumn("k", F.lit(1)).join(dirs.withColumn("k", F.lit(1)), "k").select("reason", F.arrays_overlap("parts", "dirs").alias("in_excluded_dir"))
    return flagged.groupBy("reason", "in_excluded_dir").agg(F.count("*").alias("n_files"))
