import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 50


def test_library_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['tramline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'link_time_slices' in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "tramline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry_gives_rows(spark):
    if Path("/root/testdata/sf0.001").is_dir():
        df = entry.entry(spark)
        assert df.columns == ["edge_id", "bin_s", "n", "tt_sum", "vc_ppm"] and df.count() > 0
