import subprocess
import sys

import __spark_entry__ as entry


def test_names_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_imports_without_a_session_and_without_the_training_text_folder():
    block = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100; assert not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", block], check=True)


def test_flagship(spark):
    assert entry.entry(spark).count() >= 1
