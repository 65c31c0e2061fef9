import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["segment", "year", "revenue_cents", "n_lines"]
    assert frame.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_subpackage():
    """Nothing but the entry's guard knows of it."""
    code = "import sys; sys.modules['loomhouse.llm'] = None; import __spark_entry__ as e; assert 'star_revenue' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_a_broken_subpackage_is_not_passed_over():
    """Only its absence is: what it needs and cannot import is told."""
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    sys.exit(0 if e.name == 'xxhash' else 1)\nsys.exit(2 if 'loomhouse.llm' in sys.modules else 0)"
    subprocess.run([sys.executable, "-c", code], check=True)
