"""Command line: index a tree into a store, ask a tool, check rules, export.

    python -m callweave index STORE NAME=FOLDER ...
    python -m callweave ask STORE TOOL [key=value ...]
    python -m callweave check-rules STORE CONFIG.toml      (exit code 1 if a rule of severity error is broken)
    python -m callweave export-scip STORE FOLDER
    python -m callweave topology STORE
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from callweave.operators import derive
from callweave.plans import indexing
from callweave.plans.store import Store
from callweave.tools import TOOLS, Workspace


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, "\nTools:", ", ".join(TOOLS))
        return 2
    command, store, *rest = args
    spark = SparkSession.builder.appName("callweave").getOrCreate()
    if command == "index":
        roots = dict(r.split("=", 1) for r in rest)
        found = [p for f in roots.values() if (p := Path(f, "callweave.toml")).exists()]
        tables = indexing.index(spark, roots, indexing.Config.read(found[0].read_text()) if found else None)
        print(json.dumps({"generation": Store(spark, store).write(tables)}))
        return 0
    w = Workspace.open(spark, store)
    if command == "ask":
        print(w.answer(rest[0], **{k: _value(v) for k, v in (x.split("=", 1) for x in rest[1:])}))
    elif command == "check-rules":
        rules = indexing.Config.read(Path(rest[0]).read_text()).rules
        broken = derive.check_rules(w.imports, w.files, rules)
        rows = [r.asDict() for r in derive.rule_summary(broken, rules).collect()]
        print(json.dumps(rows))
        return int(not broken.where("severity = 'error'").isEmpty())
    elif command == "export-scip":
        derive.scip_documents(w.symbols, w.calls, w.files).write.mode("overwrite").json(rest[0])
    elif command == "topology":
        print("graph LR", *(r.line for r in derive.mermaid_topology(w.service_edges, w.services).orderBy("line").limit(10_000).collect()), sep="\n")
    else:
        print(f"unknown command {command}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
