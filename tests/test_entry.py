from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.abspath(contract.__file__))


def test_contract():
    names, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 90


def test_nothing_else_imports_the_optional_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "tessera")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "tessera.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f


def test_import_without_session():
    code = "import __spark_entry__ as e; assert e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
