"""Discovery of source files: what belongs in the index, by extension, folder, user patterns and ignore files."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from callweave.functions.text import glob_regex
from callweave.plans.graph import when_any
from callweave.sources.parsers import language_of

#: Folders that are never indexed.
EXCLUDED = "node_modules .venv venv __pycache__ vendor target build dist .git .svn .hg .tox .mypy_cache .pytest_cache .next .nuxt coverage .cache".split()
#: Marker files of the root and what they tell.
MARKERS = {
    "package.json": "node", "requirements.txt": "pip", "Pipfile": "pipenv", "pyproject.toml": "python-project", "go.mod": "go-modules", "Cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "Gemfile": "bundler",
    "composer.json": "composer", "next.config.js": "nextjs", "next.config.ts": "nextjs", "nuxt.config.js": "nuxt", "nuxt.config.ts": "nuxt", "angular.json": "angular", "vue.config.js": "vue", "svelte.config.js": "svelte",
    "tailwind.config.js": "tailwind", "tailwind.config.ts": "tailwind", "tsconfig.json": "typescript-project", "Dockerfile": "docker", "docker-compose.yml": "docker-compose", "docker-compose.yaml": "docker-compose",
}
#: Dependencies of a JS manifest, and starts of lines of a Python requirements file, that name a framework.
DEPENDENCIES = {
    "next": "nextjs", "nuxt": "nuxt", "@angular/core": "angular", "@sveltejs/kit": "svelte", "vue": "vue", "express": "express", "fastify": "fastify", "@nestjs/core": "nestjs", "hono": "hono", "koa": "koa", "remix": "remix",
    "@remix-run/node": "remix", "astro": "astro",
}
REQUIREMENTS = {"flask": ("flask", "Flask"), "django": ("django", "Django"), "fastapi": ("fastapi", "FastAPI")}


@dataclass(frozen=True)
class IgnoreRule:
    base: str  # folder of the ignore file, "" for the root
    pattern: str  # regular expression over the path below the base
    keep: bool
    folders_only: bool


def ignore_rules(base: str, text: str) -> list[IgnoreRule]:
    """The rules of one ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        folders, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        line, body, i = line.lstrip("/"), "", 0
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                body, i = body + "/.*", i + 3
            elif c == "*":
                body, i = body + "[^/]*", i + 1
            elif c == "?":
                body, i = body + "[^/]", i + 1
            elif c == "[" and "]" in line[i + 1 :]:
                end = line.index("]", i + 1)
                body, i = body + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                body, i = body + re.escape(c), i + 1
        out.append(IgnoreRule(base, f"^{'' if anchored else '(?:.*/)?'}{body}$", keep, folders))
    return out


def ignored(path: str, rules: list[IgnoreRule]) -> bool:
    """Whether the file at ``path`` is ignored: the deepest ignore file with a verdict on it or a folder above it decides,
    within a file the last matching rule, and nothing inside an ignored folder can be taken back by the same file."""
    for base in sorted({r.base for r in rules}, key=lambda b: (-b.count("/") - bool(b), b)):
        if base and not path.startswith(base + "/"):
            continue
        rel = path[len(base) + 1 :] if base else path
        parts, own = rel.split("/"), [r for r in rules if r.base == base]
        for k in range(1, len(parts) + 1):
            part, folder, verdict = "/".join(parts[:k]), k < len(parts), None
            for r in own:
                if (folder or not r.folders_only) and re.match(r.pattern, part):
                    verdict = r.keep
            if verdict is False:
                return True
            if verdict is True and not folder:
                return False
    return False


def ignored_column(path: Column, rules: list[IgnoreRule]) -> Column:
    @pandas_udf(T.BooleanType())
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: ignored(p, rules))

    return run(path)


def accepted(path: Column, exclude: list[str] = (), rules: list[IgnoreRule] = ()) -> Column:
    """The acceptance test that discovery and the watcher share."""
    names = F.split(path, "/")
    plain = [e for e in exclude if "/" not in e and "*" not in e]
    ok = language_of(path).isNotNull() & ~F.arrays_overlap(names, F.array(*map(F.lit, [*EXCLUDED, *plain])))
    globs = [path.rlike(glob_regex(e)) for e in exclude if e not in plain]
    if globs:
        ok = ok & ~when_any(globs)
    return ok & ~ignored_column(path, list(rules)) if rules else ok


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, mtime): the files below ``root`` outside excluded folders; paths are relative to it.

    The driver lists names, hidden ones included; tasks read the contents. Undecodable bytes are replaced, and a file
    that can't be read has a null content."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", root)
    store, base = fs.FileSystem.from_uri(uri)
    base, found, todo = base.rstrip("/"), [], [base.rstrip("/")]
    while todo:
        for info in store.get_file_info(fs.FileSelector(todo.pop())):
            if info.type == fs.FileType.Directory and info.base_name not in EXCLUDED:
                todo.append(info.path)
            elif info.type == fs.FileType.File:
                found.append((info.path[len(base) + 1 :], info.mtime.timestamp() if info.mtime else 0.0))

    def run(batches):
        own, top = fs.FileSystem.from_uri(uri)
        for b in batches:
            texts = []
            for path in b.path:
                try:
                    with own.open_input_stream(f"{top.rstrip('/')}/{path}", compression=None) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield pd.DataFrame({"path": b.path, "content": texts, "mtime": b.mtime})

    names = spark.createDataFrame(sorted(found), "path string, mtime double")
    return names.repartition(max(1, min(len(found) // 64 + 1, 10_000)), "path").mapInPandas(run, "path string, content string, mtime double")


def tree_rules(tree: DataFrame) -> list[IgnoreRule]:
    """The rules of all ignore files; one inside an ignored or excluded folder doesn't count."""
    found = tree.where(F.col("path").rlike(r"(?:^|/)\.gitignore$") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED)))).select("path", "content").collect()
    rules: list[IgnoreRule] = []
    for path, content in sorted(found, key=lambda r: (r[0].count("/"), r[0])):
        if not ignored(path, rules):
            rules += ignore_rules(path.rpartition("/")[0], content or "")
    return rules


def discover(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """(path, language, content, mtime) of the files that belong in the index."""
    tree = read_tree(spark, root)
    return tree.where(accepted(F.col("path"), exclude, tree_rules(tree))).withColumn("language", language_of(F.col("path")))


#: Files of a service's root from which frameworks and import aliases are told.
ROOT_FILES = sorted({*MARKERS, "package.json", "requirements.txt", "tsconfig.json"})


def root_files(tree: DataFrame) -> dict[str, str]:
    """The contents of the ``ROOT_FILES`` that a tree has."""
    return {r.path: r.content or "" for r in tree.where(F.col("path").isin(ROOT_FILES)).select("path", "content").collect()}


def frameworks_of(top: dict[str, str]) -> list[str]:
    """Frameworks by marker files, the JS manifest and the Python requirements among ``root_files``, sorted."""
    import json

    out = {MARKERS[p] for p in top if p in MARKERS}
    try:
        manifest = json.loads(top.get("package.json") or "{}")
    except ValueError:
        manifest = {}
    for part in ("dependencies", "devDependencies"):
        out |= {DEPENDENCIES[d] for d in (manifest.get(part) or {}) if d in DEPENDENCIES}
    for name, starts in REQUIREMENTS.items():
        if any(line.strip().startswith(starts) for line in (top.get("requirements.txt") or "").splitlines()):
            out.add(name)
    return sorted(out)


def detect_frameworks(tree: DataFrame) -> list[str]:
    return frameworks_of(root_files(tree))


def source_slice(content: Column, line_start: Column, line_end: Column, context: int = 0) -> Column:
    """The lines of a symbol with ``context`` lines around it."""
    lines = F.split(content, "\n")
    first = F.greatest(line_start - context, F.lit(1))
    last = F.least(line_end + context, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
