"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_core_stands_without_the_optional_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('gridweave.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert {'p1_found', 'p2_found', 'p6_found', 'tile_process_e2e'} <= names and 'p7_ids' not in names\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_in_the_core_imports_the_optional_subpackage():
    for path in (ROOT / "gridweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
