"""API schemas and project files: OpenAPI, protobuf, tsconfig and version history."""

from __future__ import annotations

import json
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")
OPENAPI = r"(?i)(?:^|/)[^/]*(?:openapi|swagger)[^/]*\.(?:ya?ml|json)$"


def _yaml_paths(text: str) -> list[tuple[str, str, str | None]]:
    """(method, path, operationId) of the ``paths`` block of a YAML document, by indentation."""
    out, inside, base, path, method = [], False, 0, None, None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if indent == 0:
            inside, path, method = body.startswith("paths:"), None, None
            continue
        if not inside:
            continue
        key = re.match(r"""["']?([^"':]+(?:\{[^}]*\}[^"':]*)*)["']?\s*:(.*)$""", body)
        if not key:
            continue
        name = key[1].strip()
        if name.startswith("/") and (path is None or indent <= base):
            base, path, method = indent, name, None
        elif path is not None and name.lower() in METHODS and (method is None or indent <= method[1]):
            method = (name.upper(), indent)
            out.append((name.upper(), path, None))
        elif method and name == "operationId" and out:
            out[-1] = (*out[-1][:2], key[2].strip().strip("\"'"))
    return out


def openapi_paths(text: str | None) -> list[tuple[str, str, str | None]]:
    """(method, path, operationId); referenced path items are skipped, what can't be read is empty."""
    try:
        doc = json.loads(text or "")
    except ValueError:
        return _yaml_paths(text or "")
    out = []
    for path, item in (doc.get("paths") or {}).items() if isinstance(doc, dict) else []:
        if isinstance(item, dict) and "$ref" not in item:
            out += [(m.upper(), path, op.get("operationId")) for m, op in item.items() if m in METHODS and isinstance(op, dict)]
    return out


def proto_rpcs(text: str | None) -> list[tuple[str, int]]:
    """(/Service/Rpc, line) of the service blocks of a proto file."""
    out, service, depth = [], None, 0
    for n, line in enumerate((text or "").splitlines(), 1):
        body = line.strip()
        if body.startswith("service ") and "{" in body:
            service, depth = re.split(r"[{\s]", body[8:].strip())[0] or None, 1
            continue
        if service is None:
            continue
        for c in body:
            depth += (c == "{") - (c == "}")
            if depth <= 0:
                service, depth = None, 0
                break
        if service and body.startswith("rpc ") and (name := body[4:].split("(")[0].strip()):
            out.append((f"/{service}/{name}", n))
    return out


@udtf(returnType="method string, path_pattern string, operation_id string, protocol string, line int, schema_source string")
class SchemaEndpoints:
    """The endpoints of one file, by its path."""

    def eval(self, path: str, content: str):
        if path.endswith(".proto"):
            for p, n in proto_rpcs(content):
                yield "POST", p, None, "grpc", n, "proto"
        else:
            for m, p, op in openapi_paths(content):
                yield m, p, op, "http", None, "openapi"


def schema_endpoints(tree: DataFrame) -> DataFrame:
    """Endpoints of all OpenAPI and protobuf files of a tree (path, content), each once."""
    files = tree.where(F.col("path").rlike(OPENAPI) | F.col("path").endswith(".proto")).select("path", "content")
    found = files.lateralJoin(SchemaEndpoints(F.col("path").outer(), F.col("content").outer()))
    return found.dropDuplicates(["method", "path_pattern", "protocol"]).drop("content")


def tsconfig_aliases(text: str | None) -> list[tuple[str, str]]:
    """(pattern, first target below baseUrl), longest pattern first; comments and trailing commas are allowed."""
    clean = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text or "", flags=re.S)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", clean)).get("compilerOptions") or {}
    except ValueError:
        return []
    base = (options.get("baseUrl") or ".").strip("/").removeprefix("./")
    base = "" if base in (".", "") else base + "/"
    out = [(p, base + t[0].removeprefix("./")) for p, t in (options.get("paths") or {}).items() if t]
    return sorted(out, key=lambda a: (-len(a[0]), a[0]))


def git_commit_files(spark: SparkSession, repo: str, commits: int = 500) -> DataFrame:
    """(commit, ts, path) of the last commits that HEAD reaches, merged branches included, newest first, each against its
    first parent; deleted paths count, roots give no row. Empty without a repository. One call of git on the driver,
    whose output is bounded by ``commits``."""
    command = ["git", "-C", repo, "log", f"-{commits}", "--diff-merges=first-parent", "--no-renames", "--name-only", "-z", "--format=%x01%H %ct %P"]
    rows, commit, ts = [], None, 0
    for part in subprocess.run(command, capture_output=True, check=False).stdout.decode("utf-8", "replace").split("\0"):
        part = part.lstrip("\n")
        if part.startswith("\x01"):
            head = part[1:].rstrip("\n").split(" ")
            commit, ts = (head[0] if len(head) > 2 and head[2] else None), int(head[1])
        elif part and commit:
            rows.append((commit, ts, part))
    return spark.createDataFrame(rows, "commit string, ts long, path string")


def git_blame(spark: SparkSession, repo: str, paths: DataFrame) -> DataFrame:
    """(path, line, ts, author, commit) of all lines of ``paths`` (path), blamed by tasks that see ``repo``."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path in b.path:
                got = subprocess.run(["git", "-C", repo, "blame", "--line-porcelain", "HEAD", "--", path], capture_output=True, check=False).stdout.decode("utf-8", "replace")
                commit = author = None
                line = ts = 0
                for text in got.split("\n"):
                    if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", text):
                        commit, line = m[1], int(m[2])
                    elif text.startswith("author-mail "):
                        author = text[12:]
                    elif text.startswith("author-time "):
                        ts = int(text[12:])
                    elif text.startswith("\t"):
                        rows.append((path, line, ts, author, commit))
            yield pd.DataFrame(rows, columns=["path", "line", "ts", "author", "commit"])

    return paths.select("path").mapInPandas(run, "path string, line int, ts long, author string, commit string")
