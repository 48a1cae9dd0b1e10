"""The driver's contract, with and without the corpus operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for name in ("loomgraph", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    said = lambda: subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    with_file = said()
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said() == with_file and with_file[2] == "False" and int(with_file[0]) >= 47
