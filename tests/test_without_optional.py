"""The library without its optional subpackage: a copy lacking the folder still imports and runs."""

import ast
import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def _copy(tmp_path):
    away = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.json", "*.md")
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=away)


def _run(code, where):
    return subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, timeout=120)


def test_entry_without_the_subpackage(tmp_path):
    where = _copy(tmp_path)
    out = _run("import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()),"
               " any(k.startswith('op') or k == 'pipeline' for k in e.queries()))", where)
    assert out.returncode == 0, out.stderr
    n, sql, optional = out.stdout.split()
    assert int(n) >= 98 and int(sql) >= 81 and optional == "False"


def test_a_fault_inside_the_subpackage_is_not_hidden(tmp_path):
    where = _copy(tmp_path)
    os.makedirs(where / "panelwise" / "llm")
    (where / "panelwise" / "llm" / "__init__.py").write_text("")
    (where / "panelwise" / "llm" / "catalog.py").write_text("import a_library_that_is_missing\n")
    out = _run("import __spark_entry__ as e; e.queries()", where)
    assert out.returncode != 0 and "a_library_that_is_missing" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for d, _, names in os.walk(os.path.join(ROOT, "panelwise")):
        if os.path.basename(d) in ("llm", "__pycache__"):
            continue
        for name in (n for n in names if n.endswith(".py")):
            for node in ast.walk(ast.parse(open(os.path.join(d, name)).read())):
                if isinstance(node, ast.ImportFrom):
                    assert "llm" not in (node.module or "").split(".") and "llm" not in [a.name for a in node.names], name
                elif isinstance(node, ast.Import):
                    assert not any("llm" in a.name.split(".") for a in node.names), name
