"""The entry module keeps working when the training-data subpackage is not there."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_subpackage():
    code = (
        "import sys\nclass Block:\n    def find_spec(self, name, *a):\n        if name == 'chatloom.llm' or name.startswith('chatloom.llm.') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Block())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(k.startswith('op') or k == 'pipeline' for k in q)\nassert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "chatloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "chatloom.llm" not in p.read_text()
