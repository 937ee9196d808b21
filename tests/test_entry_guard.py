"""The driver's entry points without the corpus operators, or without a library that these need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(setup):
    code = f"import sys; {setup}; import __spark_entry__ as e; print('NAMES', len(e.oracle_sql()), *e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    return said.rpartition("NAMES ")[2].split()[1:]


def test_other_queries_stay():
    for missing in ("xxhash", "tapewright.llm", "tapewright.llm.queries", "corpus_pipeline"):
        found = names(f"sys.modules[{missing!r}] = None")
        assert "a1_flow_summary" in found and len(found) > 200 and "pipeline" not in found
