"""The entry point without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["corpus_pipeline", "touchline.llm"])
def test_other_queries_stay_without_the_training_data_folder(absent):
    code = (f"import sys; sys.modules[{absent!r}] = None\n"
            "import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert len(q) > 90 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q), sorted(q)\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]
