import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"d1_vectors", "d5_edges", "d11_diagnostics"} <= set(q)


def test_core_does_not_need_llm():
    code = "import sys; sys.modules['gleaner.llm'] = None; import __spark_entry__ as e; assert 'd1_vectors' in e.queries() and 'p8_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
